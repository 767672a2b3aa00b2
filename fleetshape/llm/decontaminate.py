"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of WINDOW words; a document is contaminated where a whole window
occurs in it. Tokens of the join are word shingles (SHINGLE words, or all words of a shorter
window). A window occurs only where all its tokens do, so one necessary token is enough as its
prefix: the one that is rarest over all documents. Documents join on that token; its offset in
the window gives the one place where the window could stand, which must lie inside the document,
and the words there are compared with the window's.

Documents are read twice (token counts, candidates) and leave nothing but counts and candidates.
What is broadcast is a bitmap of fixed size, whatever the benchmark; a chance hit in it is a
candidate that joins with nothing.

Defined results: null or wordless texts have no words, hits or windows; an item of fewer than
WINDOW words is one window; a null item_id counts as the item ''; repeated rows get one result
each; an empty benchmark hits nothing; further columns are carried by `drop_contaminated` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetshape.llm.frames import map_text, raw_text, stored, text_slices, whole_row, widened

WINDOW = 10
SHINGLE = 3
#: Bits of the token bitmap, as a power of two: 2 MB.
BITMAP_BITS = 24
PAGE = 1 << 15
#: Windows up to which their table is broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 100_000

#: A-Z to a-z; other ASCII that is no digit or letter to a blank.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or b > 0x7F or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MIX = np.random.default_rng(20).integers(1, 1 << 63, 256 + SHINGLE + 2, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2 ** 64, at least n of them."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of consecutive texts: byte positions, 64-bit hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.flat = data.tobytes().translate(FOLD)
        own = np.frombuffer(self.flat, np.uint8)
        inside = own != 0x20
        edge = np.zeros(len(own) + 1, bool)
        edge[ends] = True
        before = np.concatenate(([False], inside))[:-1] & ~edge[:-1]
        after = np.concatenate((inside, [False]))[1:] & ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.stop = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, ends)
        up, down = _powers(len(own) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_MIX[own] * up[:len(own)], dtype=np.uint64)))
        self.hash = _mixed((total[self.stop] - total[self.start]) * down[self.start])

    def tokens(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the shingles of `size` words inside one text, and their hashes."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(n) + size <= row_end)
        total = np.full(len(at), _MIX[256 + size], np.uint64)
        for k in range(size):
            total = _mixed(total * _MIX[256] + self.hash[at + k])
        return at, total

    def text(self, a: int, b: int) -> str:
        return " ".join(self.flat[s:e].decode() for s, e in zip(self.start[a:b].tolist(), self.stop[a:b].tolist()))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window: its words, how many, and the hashes of its tokens in order."""
    for part, data, ends in text_slices(batches):
        words, item, text, length, tokens = Words(data, ends), [], [], [], []
        by_size = {q: dict(zip(*(x.tolist() for x in words.tokens(q)))) for q in range(1, SHINGLE + 1)}
        for row in range(part.num_rows):
            a, b = int(words.first[row]), int(words.first[row + 1])
            for s in range(a, max(b - WINDOW, a) + 1) if b > a else ():
                n = min(WINDOW, b - a)
                q = min(SHINGLE, n)
                item.append(row)
                text.append(words.text(s, s + n))
                length.append(n)
                tokens.append([_signed(by_size[q][i]) for i in range(s, s + n - q + 1)])
        kept = part.take(pa.array(item, pa.int64()))
        yield widened(kept, {"window": pa.array(text, pa.string()), "len": pa.array(length, pa.int32()),
                             "tokens": pa.array(tokens, pa.list_(pa.int64()))})


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _bitmap(tokens: DataFrame) -> bytes:
    """Bits of the tokens' leading BITMAP_BITS bits: a result of fixed size."""
    bits = tokens.select(F.shiftrightunsigned("token", 64 - BITMAP_BITS).alias("bit"))
    pages = bits.groupBy(F.expr(f"cast(bit div {PAGE} as int)").alias("page")).agg(
        F.expr(f"bitmap_construct_agg(bit % {PAGE})").alias("bits"))
    out = bytearray(1 << (BITMAP_BITS - 3))
    for page, found in pages.toLocalIterator():
        out[page * PAGE // 8:page * PAGE // 8 + len(found)] = found
    return bytes(out)


def _marked(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    bit = (tokens >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _count_tokens(shared, sizes: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for _, data, ends in text_slices(batches):
            words = Words(data, ends)
            for size in sizes:
                tokens = words.tokens(size)[1]
                found, n = np.unique(tokens[_marked(bitmap, tokens)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])
    return count


CANDIDATES = "n_words long, found array<struct<token: long, at: int, start: int, around: string>>"


def _find(shared, sizes: list[int]):
    """Per document: its number of words, and each marked token with the words a window around it could cover."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("around", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for part, data, ends in text_slices(batches):
            words = Words(data, ends)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for size in sizes:
                at, tokens = words.tokens(size)
                hit = _marked(bitmap, tokens)
                rows = np.searchsorted(words.first, at[hit], "right") - 1
                # A token of fewer words than SHINGLE is a whole window; a longer window reaches this far on either side.
                span = WINDOW if size == SHINGLE else size
                for row, i, token in zip(rows.tolist(), at[hit].tolist(), tokens[hit].view(np.int64).tolist()):
                    first, last = int(words.first[row]), int(words.first[row + 1])
                    a = max(i - (span - size), first)
                    found[row].append({"token": token, "at": i - first, "start": a - first, "around": words.text(a, min(i + span, last))})
            yield widened(part, {"n_words": pa.array(np.diff(words.first), pa.int64()), "found": pa.array(found, kind)})
    return find


def item_windows(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """item_id, window (its words, blank between), len, tokens: one row per window of each item."""
    return map_text(benchmark, _windows, {"item_id": benchmark["item_id"]}, text, "window string, len int, tokens array<long>")


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items: one row per input row.

    `items` holds the ids, as sorted strings, of the benchmark items with a window in the document.
    """
    spark = df.sparkSession
    of_items = stored(item_windows(benchmark), "windows")
    windows = of_items.groupBy("window", "len").agg(F.first("tokens").alias("tokens"))
    offered = windows.select("window", "len", F.posexplode("tokens").alias("offset", "token"))
    sizes = sorted({min(SHINGLE, n) for n, in of_items.select("len").distinct().collect()})  # at most WINDOW rows
    few = of_items.count() <= BROADCAST_WINDOWS

    shared = spark.sparkContext.broadcast(_bitmap(offered))
    counts = map_counts(df, text, _count_tokens(shared, sizes)).groupBy("token").agg(F.sum("n").alias("n"))
    # A token that no document has rules its window out; a chance hit in the bitmap has no window.
    prefix = offered.join(counts, "token", "left").groupBy("window", "len").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("p"))
    prefix = stored(prefix.where("p.n > 0").select("window", "len", "p.offset", "p.token"), "prefixes")
    needed = spark.sparkContext.broadcast(_bitmap(prefix))
    keys = {"doc_id": df["doc_id"], "text_key": F.xxhash64(df[text])}
    seen = stored(map_text(df, _find(needed, sizes), keys, text, CANDIDATES), "candidates")

    places = seen.select("doc_id", "text_key", "n_words", F.explode("found").alias("f"))
    side = F.broadcast(prefix) if few else prefix
    begin = F.col("f.at") - F.col("offset")
    joined = places.join(side, places["f.token"] == side["token"]).withColumn("begin", begin)
    fits = (F.col("begin") >= F.col("f.start")) & (F.col("begin") + F.col("len") <= F.col("n_words"))
    there = F.array_join(F.slice(F.split("f.around", " "), F.col("begin") - F.col("f.start") + 1, F.col("len")), " ")
    hits = joined.where(fits).where(there == F.col("window")).select("doc_id", "text_key", "begin", "len", "window").distinct()
    hits = stored(hits, "hits")

    doc = ["doc_id", "text_key"]
    so_far = W.partitionBy(*doc).orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.groupBy(*doc, "begin").agg(F.max(F.col("begin") + F.col("len")).alias("end"))
    spans = spans.withColumn("covered", F.coalesce(F.max("end").over(so_far), F.lit(0)))
    covered = spans.groupBy(*doc).agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "covered"))).cast("long").alias("n_hit"))
    ids = of_items.select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    items = hits.select(*doc, "window").distinct().join(F.broadcast(ids) if few else ids, "window").groupBy(*doc).agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    result = _same(covered, items, "inner")
    out = _same(seen.select(*doc, "n_words"), result, "left")
    return out.select(*doc, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def map_counts(df: DataFrame, text: str, fn) -> DataFrame:
    return df.select(df[text].alias("__text")).mapInArrow(fn, "token long, n long")


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join of two tables on the document, whose id may be null."""
    r = right.withColumnsRenamed({"doc_id": "__doc", "text_key": "__key"})
    on = left["doc_id"].eqNullSafe(r["__doc"]) & (left["text_key"] == r["__key"])
    return left.join(r, on, how).drop("__doc", "__key")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` in which no benchmark window occurs, with all their columns."""
    hit = contamination(df, benchmark, text).where("n_hit > 0").select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    rows = df.select(whole_row(df).alias("__row"), df["doc_id"].alias("__id"), F.xxhash64(df[text]).alias("__text"))
    return rows.join(hit, rows["__id"].eqNullSafe(hit["__doc"]) & (rows["__text"] == hit["__key"]), "left_anti").select("__row.*")
