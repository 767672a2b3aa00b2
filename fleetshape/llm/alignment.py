"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline.

A slice of documents is cut at blanks between plain characters, where neither tokenizer can have a
token across the cut (its pattern, or a vocabulary without such an entry, forbids it), and each distinct
part is encoded once while it stays in a bounded table; a text with any other blank is one part. Lists are
flattened, a token's byte length comes from its vocabulary entry, and cumulative sums within each
document give the offset where it ends.
An Acero join of both sides on (document, end) tells which offsets both share: they cut the tokens
into groups. The same join, kept outer and filled backwards, has one row per link: between two
neighbouring ends of either side lies exactly one overlap of an A and a B token.

Links of a chunk (some slices of one task) are counted per id pair with Table.group_by; Spark adds the
chunks' counts. A document keeps its links as places in its chunk's list of pairs, so the second pass
brings each chunk the corpus-wide counts of its own pairs and reads no text again. Nothing is broadcast.

Defined results: null and empty texts, and texts whose tokens do not spell a blank and the text (as
where white space or characters are normalised away), have no tokens: all counts 0, '' as digest, and
no part in any count; repeated rows and null ids are aligned row by row, each with its own links; an
empty table gives an empty one; further columns do not matter. Strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetshape.llm.frames import map_text, raw_text, stored
from fleetshape.llm.token_counts import load

#: Text bytes of one pass of the pipeline, and of a chunk whose counts are kept apart, about; a longer text is its own.
SLICE, CHUNK = 1 << 20, 4 << 20
#: Letters of a part that a worker remembers, and how many parts it remembers before it starts anew.
SHORT, REMEMBERED = 10, 250_000
#: A blank at which a text is not cut: at its beginning or end, or beside anything but letters, digits and printable ASCII.
_UNCUT = r"(?:^|[^\p{L}\p{N}!-~]) | (?:$|[^\p{L}\p{N}!-~])"
#: A part that may stand between blanks, as those that texts are cut into do.
_PLAIN = re.compile(r"[\w!-~](?:[^ ]*[\w!-~])?")


def _byte_letters() -> np.ndarray:
    """The byte that each letter of a byte-level vocabulary stands for, by code point."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    table = np.full(1 << 9, -1)
    table[plain] = plain
    hidden = sorted(set(range(256)) - set(plain))
    table[256:256 + len(hidden)] = hidden
    return table


class ByteLevel:
    """A byte-level vocabulary (tokenizers' file)."""

    def __init__(self, path: str):
        self.tokenizer, letters = load(path), _byte_letters()
        self.tokenizer.encode_special_tokens = True
        spelled = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(spelled.values()) + 1)
        for entry, i in spelled.items():
            self.bytes[i] = bytes(letters[ord(c)] for c in entry) if all(ord(c) < len(letters) for c in entry) else entry.encode()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in parts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece vocabulary, which adds the blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = self.processor.id_to_piece(list(range(self.processor.get_piece_size())))
        hexed = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes.fromhex(m.group(1)) if (m := hexed.fullmatch(p)) else p.replace("▁", " ").encode() for p in entries]

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.processor.encode(parts, num_threads=1)


class Encoders:
    """Both tokenizers, and the token lists of the parts met so far."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides = (a, b)
        self.entries = tuple(pa.array(x.bytes, pa.binary()) for x in self.sides)
        # Without an entry that goes on behind an inner blank, no B token spans a cut.
        self.cuts = not any(b" " in e.lstrip(b" ") for e in b.bytes)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.lists = [pa.array([], pa.list_(pa.int32()))] * 2

    def _remember(self, new: list[str], lists: list[pa.ListArray]) -> None:
        """Keeps the short ones: they come again."""
        short = [i for i, p in enumerate(new) if len(p) <= SHORT]
        if len(self.place) + len(short) > REMEMBERED:
            self.forget()
            short = short[:REMEMBERED]
        self.place.update((new[i], len(self.place)) for i in short)
        self.lists = [pa.concat_arrays([known, x.take(pa.array(short, pa.int64()))]) for known, x in zip(self.lists, lists)]

    def _added(self, plain: list[str], other: list[str]) -> list[pa.ListArray]:
        """Token lists of new parts. A, which is slow for single words, takes plain ones as one text that is cut again where tokens end."""
        kind = pa.list_(pa.int32())
        ids = np.array(self.sides[0].encode([" ".join(plain)])[0] if plain else [], np.int32)
        ends = np.cumsum(_spelled(ids, self.entries[0])[1])
        until = np.cumsum([len(p.encode()) + 1 for p in plain], dtype=np.int64)
        at = np.searchsorted(ends, until)
        if (at == len(ends)).any() or (ends[at] != until).any():
            first = pa.array(self.sides[0].encode(plain), kind)
        else:
            first = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], at + 1)).astype(np.int32)), pa.array(ids))
        return [pa.concat_arrays([first, pa.array(self.sides[0].encode(other), kind)]), pa.array(self.sides[1].encode([*plain, *other]), kind)]

    def parts(self, texts: pa.Array) -> pa.Array:
        """Each text cut into its parts; an empty one is null."""
        whole = pa.LargeListArray.from_arrays(pa.array(np.arange(len(texts) + 1)), texts)
        if self.cuts:
            cut = pc.split_pattern(texts, " ").cast(whole.type)
            whole = pc.if_else(pc.match_substring_regex(texts, _UNCUT), whole, cut)
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), None, whole)

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side the ids of all texts (large_string) end to end, and the document of each."""
        split = self.parts(texts)
        doc = pc.list_parent_indices(split)
        coded = pc.list_flatten(split).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        place = np.fromiter((self.place.get(p, -1) for p in parts), np.int64, len(parts))
        at = np.flatnonzero(place < 0)
        new = [parts[i] for i in at.tolist()]
        plain = np.array([self.cuts and _PLAIN.fullmatch(p) is not None for p in new], bool)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        new = [new[i] for i in order.tolist()]
        added = self._added(new[:int(plain.sum())], new[int(plain.sum()):])
        place[at[order]] = len(self.place) + np.arange(len(new))
        rows = pa.array(place).take(coded.indices)
        lists_of = [pa.concat_arrays(x) for x in zip(self.lists, added)]
        self._remember(new, added)
        out = []
        for known in lists_of:
            lists = known.take(rows)
            out.append((pc.list_flatten(lists).to_numpy(zero_copy_only=False),
                        doc.take(pc.list_parent_indices(lists)).to_numpy(zero_copy_only=False).astype(np.int64)))
        return out


@lru_cache(maxsize=4)
def _both(path_a: str, path_b: str) -> Encoders:
    return Encoders(ByteLevel(path_a), Pieces(path_b))


def _spelled(ids: np.ndarray, entries: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all tokens end to end, and each token's length."""
    taken = entries.take(pa.array(ids))
    data, ends = raw_text(taken)
    return data.tobytes(), np.diff(ends)


class Aligned:
    """Alignment of some texts: per document counts and digests, per link its document and two ids."""

    def __init__(self, texts: pa.Array, encoders: Encoders):
        n = len(texts)
        flat, bounds = raw_text(texts)
        flat, bounds = flat.tobytes(), bounds.tolist()
        whole = np.diff(bounds) > 0
        sides = []
        for entries, (ids, doc) in zip(encoders.entries, encoders.encode(texts)):
            data, length = _spelled(ids, entries)
            size = np.bincount(doc, length, n).astype(np.int64)
            at = np.concatenate(([0], np.cumsum(size))).tolist()
            # The tokens must spell a blank and the text.
            whole &= [q - p == j - i + 1 and data[p] == 0x20 and data[p + 1:q] == flat[i:j] for i, j, p, q in zip(bounds, bounds[1:], at, at[1:])]
            sides.append((ids, doc, length))
        # Documents whose tokens spell something else have none. The others have the same bytes on both sides, so that
        # a sum over all their tokens gives the end of each within one text: no document's ends meet another's.
        kept = []
        for ids, doc, length in sides:
            stay = whole[doc]
            kept.append((ids[stay], doc[stay], np.cumsum(length[stay], dtype=np.int64)))
        (self.a, doc_a, end_a), (self.b, doc_b, end_b) = kept
        self.n_a, self.n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)

        left = pa.table({"end": end_a, "a": np.arange(len(doc_a))})
        right = pa.table({"end": end_b, "b": np.arange(len(doc_b))})
        ends = left.join(right, "end", join_type="full outer", use_threads=False)
        ends = ends.take(pa.array(np.argsort(ends["end"].to_numpy(), kind="stable")))
        shared = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"])).to_numpy()
        # The token that covers the bytes before an end is the next one to end there or later; a document's last end is shared.
        filled = [pc.fill_null_backward(ends[x].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64) for x in "ab"]
        self.doc = doc_a[filled[0]]
        self.link_a, self.link_b = self.a[filled[0]], self.b[filled[1]]
        self.n_links = np.bincount(self.doc, minlength=n)
        self.n_groups = np.bincount(self.doc[shared], minlength=n)
        self.sha = self._digests(shared, filled)

    def _digests(self, shared: np.ndarray, filled: list[np.ndarray]) -> list[str]:
        """SHA-256 of each document's groups, written out."""
        joined = []
        for ids, last in zip((self.a, self.b), filled):
            edges = np.concatenate(([0], last[shared] + 1))
            lists = pa.LargeListArray.from_arrays(pa.array(edges), pc.cast(pa.array(ids), pa.large_string()))
            joined.append(pc.binary_join(lists, pa.scalar(",", pa.large_string())))
        groups = pc.binary_join_element_wise(*joined, pa.scalar("|", pa.large_string()))
        edges = np.concatenate(([0], np.cumsum(self.n_groups)))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), groups), pa.scalar(";", pa.large_string())).to_pylist()
        return [hashlib.sha256(t.encode()).hexdigest() if g else "" for t, g in zip(texts, self.n_groups.tolist())]


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROW = f"is_pair boolean, chunk string, {_DOC}, links array<int>, place int, a int, b int, n long"


class _Chunk:
    """Documents of some slices, and the pairs that they link."""

    def __init__(self, name: str, ids: pa.DataType):
        self.name, self.kind, self.size = name, ids, 0
        self.rows, self.key, self.held = [], [], []

    def add(self, ids: pa.Array, size: int, found: Aligned) -> None:
        self.size += size
        counts = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        self.rows.append([ids, *counts, pa.array(found.sha, pa.string())])
        self.key.append(found.link_a.astype(np.int64) << 32 | found.link_b)
        self.held.append(found.n_links)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of documents, a slice at a time, then of pairs."""
        coded = pa.array(np.concatenate(self.key)).dictionary_encode()
        counted = pa.table({"place": coded.indices}).group_by("place", use_threads=False).aggregate([("place", "count")])
        # Frequent pairs get small places, which compress well.
        order = np.argsort(-counted["place_count"].to_numpy(), kind="stable")
        by_rank = counted["place"].to_numpy()[order]
        rank = np.empty(len(by_rank), np.int32)
        rank[by_rank] = np.arange(len(by_rank))
        places, start = rank[coded.indices.to_numpy()], 0
        for row, held in zip(self.rows, self.held):
            edges = np.concatenate(([0], np.cumsum(held))).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(edges), pa.array(places[start:start + edges[-1]]))
            start += int(edges[-1])
            n = len(held)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
            yield self._batch([row[0], pa.array([False] * n), pa.array([self.name] * n), *row[1:], links, *none])
        n = len(by_rank)
        key = coded.dictionary.to_numpy()[by_rank]
        none = [pa.nulls(n, t) for t in (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()))]
        pairs = [np.arange(n, dtype=np.int32), (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), counted["place_count"].to_numpy()[order]]
        yield self._batch([pa.nulls(n, self.kind), pa.array(np.ones(n, bool)), pa.array([self.name] * n, pa.string()), *none, *map(pa.array, pairs)])

    @staticmethod
    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in _ROW.split(", "))])


def _aligning(path_a: str, path_b: str, slice_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _both(path_a, path_b)
        task, n, chunk = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            ends = raw_text(batch.column(1))[1]
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(ends, ends[start] + slice_bytes, "right")) - 1
                stop = min(max(stop, start + 1), batch.num_rows)
                chunk = chunk or _Chunk(f"{task}-{n}", batch.column(0).type)
                texts = batch.column(1).slice(start, stop - start).cast(pa.large_string()).fill_null("")
                chunk.add(batch.column(0).slice(start, stop - start), int(ends[stop] - ends[start]), Aligned(texts, encoders))
                if chunk.size >= chunk_bytes:
                    yield from chunk.batches()
                    chunk, n = None, n + 1
                    pa.default_memory_pool().release_unused()
                start = stop
        if chunk:
            yield from chunk.batches()
        # Workers live on: later stages need the memory.
        encoders.forget()
        pa.default_memory_pool().release_unused()
    return run


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one chunk with what the corpus says of their pairs."""
    most = int(pc.max(pairs["place"]).as_py() or 0) + 1 if pairs.num_rows else 1
    total, best = np.zeros(most, np.int64), np.zeros(most, np.int64)
    place = pairs["place"].to_numpy()
    total[place] = pairs["total"].to_numpy()
    best[place] = pairs["best"].to_numpy().astype(np.int64)
    out = []
    for batch in docs.to_batches():
        links = batch.column("links")
        edges = links.offsets.to_numpy() - links.offsets[0].as_py()
        at = links.flatten().to_numpy(zero_copy_only=False)
        sums = [(lambda c: c[edges[1:]] - c[edges[:-1]])(np.concatenate(([0], np.cumsum(x[at], dtype=np.int64)))) for x in (best, total)]
        kept = [batch.column(x) for x in ("doc_id", *(c.split()[0] for c in _DOC.split(", ")))]
        out.append(pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums)], names=["doc_id", *(c.split()[0] for c in _DOC.split(", ")), "n_best", "count_sum"]))
    return pa.Table.from_batches(out) if out else _empty(docs)


def _empty(docs: pa.Table) -> pa.Table:
    kept = docs.select(["doc_id", *(c.split()[0] for c in _DOC.split(", "))]).slice(0, 0)
    return kept.append_column("n_best", pa.array([], pa.int64())).append_column("count_sum", pa.array([], pa.int64()))


def links(df: DataFrame, path_a: str, path_b: str, text: str = "text", slice_bytes: int = SLICE, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows of documents (doc_id, counts, digest, links) and of their chunks' pairs (place, a, b, n), told apart by `is_pair`."""
    return map_text(df, _aligning(path_a, path_b, slice_bytes, chunk_bytes), {"doc_id": df["doc_id"]}, text, _ROW)


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, total (links of the corpus that join them), best (no pair of this b has more)."""
    totals = found.where("is_pair").groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("b")))


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", slice_bytes: int = SLICE, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum: one row per input row. Both files are on all workers."""
    found = stored(links(df, path_a, path_b, text, slice_bytes, chunk_bytes), "links")
    pairs = found.where("is_pair").select("chunk", "place", "a", "b").join(pair_counts(found), ["a", "b"]).select(
        F.col("chunk").alias("of_chunk"), "place", "total", "best")
    docs = found.where("not is_pair").select("chunk", "doc_id", *(c.split()[0] for c in _DOC.split(", ")), "links")
    kind = dict(found.dtypes)["doc_id"]
    return docs.groupBy("chunk").cogroup(pairs.groupBy("of_chunk")).applyInArrow(_scored, f"doc_id {kind}, {_DOC}, n_best long, count_sum long")
