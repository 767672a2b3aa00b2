"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most DISTANCE = 2 bits link. A fingerprint is cut into two halves
(one fewer than exact matching needs), so a linked pair has a half with one differing bit at
most. Each half is indexed once per wildcard bit; equal keys meet in one shuffle. A key keeps
only count, least and greatest fingerprint: two members are a candidate pair that is verified;
three or more would be all pairs of a group, so their members take an exact linear way instead:
every one announces itself under its own value and its 64 one-bit neighbours. All fingerprints
that meet under one value are within two bits of each other, at most 65 of them, and are tied to
the least. No link is lost, no group is expanded into pairs, whatever the size of the group.

Everything runs on distinct fingerprints; exact copies never multiply.

Defined results: null or empty text has no words and fingerprint zero, linked like any other;
one or two words are hashed as one shingle; null ids belong to their fingerprint's component and
never name it while another id is there; repeated rows share a component; an empty table gives
an empty one; further columns are carried by `keep_one` alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetshape.llm.components import components
from fleetshape.llm.frames import map_text, rows_of, stored, text_slices, whole_row, widened

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Shingles whose bits are added up at a time.
CHUNK = 1 << 16


def fingerprint_of(text: bytes) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = xxhash.xxh64_digest(flat, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[:len(words) - SHINGLE + 1]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1:] - 1).tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(rows[i:i + CHUNK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(rows), CHUNK))
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, ends in text_slices(batches):
        yield widened(part, {"fp": pa.array([fingerprint_of(t) for t in rows_of(data, ends)], pa.int64())})


def fingerprints(df: DataFrame, text: str = "text", keys: dict[str, Column] | None = None) -> DataFrame:
    """`keys` (doc_id) and `fp`, one row per input row."""
    return map_text(df, _fingerprints, keys or {"doc_id": df["doc_id"]}, text, "fp long")


def _keys(distinct: DataFrame) -> DataFrame:
    """Each fingerprint under its 64 keys: half, wildcard bit, and the half without that bit."""
    each = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(64)])).alias("i"))
    key = """(case when i < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end)
             & ~shiftleft(1L, i % 32) | shiftleft(cast(i as long), 32)"""
    return each.select("fp", F.expr(key).alias("key"))


def _neighbours(distinct: DataFrame) -> DataFrame:
    """Each fingerprint under its own value and its 64 one-bit neighbours."""
    each = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(65)])).alias("i"))
    return each.select("fp", F.expr("case when i = 64 then fp else fp ^ shiftleft(1L, i) end").alias("near"))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that tie exactly what links at DISTANCE bits or fewer reach."""
    keys = _keys(distinct)
    met = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                 .where("n > 1"), "keys")
    pairs = met.where("n = 2").select("a", "b").distinct().where(F.expr(f"bit_count(a ^ b) <= {DISTANCE}"))
    # Crowded keys grow with the input: a sort-merge join at every size.
    crowded = keys.join(met.where("n > 2").select("key").hint("merge"), "key").select("fp").distinct()
    near = _neighbours(crowded).withColumn("a", F.min("fp").over(W.partitionBy("near")))
    stars = near.where("a != fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars)


def with_components(prints: DataFrame) -> DataFrame:
    """`prints` (doc_id, fp, ...) with root, a component's least fingerprint, and component_id, its least doc_id.

    Roots and classes are written before they are joined: a component or a class of exact copies
    with a third of all rows is then one side of two plain shuffles, which adaptive execution splits.
    """
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    linked = stored(reached.join(classes, "fp"), "linked")
    roots = stored(linked.groupBy("root").agg(F.min("least").alias("component")), "roots")
    named = linked.select("fp", "root").join(roots, "root")
    by_class = stored(classes.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")), "by-class")
    return prints.join(by_class, "fp")


def near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row."""
    prints = stored(fingerprints(df, text), "prints")
    return with_components(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id.

    Of rows that repeat that id, the one whose text hash is least; of wholly equal ones, any one.
    """
    own = {"doc_id": df["doc_id"], "text_key": F.xxhash64(df[text])}
    prints = stored(fingerprints(df, text, own), "prints")
    first = with_components(prints).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("__doc"), F.col("first.text_key").alias("__key"))
    rows = df.select(whole_row(df).alias("__row"), own["doc_id"].alias("__id"), own["text_key"].alias("__text"))
    kept = rows.join(first, rows["__id"].eqNullSafe(first["__doc"]) & (rows["__text"] == first["__key"]), "left_semi")
    order = W.partitionBy("__id", "__text").orderBy(F.xxhash64("__row"))
    return kept.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("__row.*")
