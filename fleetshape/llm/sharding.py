"""Sharding by minimax contiguous partition: shards of near-equal bytes, equal texts together.

Atomic groups are buckets of the text's hash, in hash order: equal texts share one, and their
number is fixed, so what reaches the driver is bounded whatever the input. The smallest capacity
that SHARDS contiguous runs of groups can keep is found by binary search with a greedy check;
cuts are then made within that capacity, each as near as it allows to an even share of the rest.
Rows learn their shard by comparing their bucket with the cuts, without a join or a sort.

Slots are numbered in buckets of the id and set off by the counts before them, so that no shard
is sorted in one task.

Only DataFrame functions. Defined results: null text has size 1 and its own group; repeated rows
get slots of their own; a group larger than an even share makes one large shard; an empty table
gives an empty one; further columns are carried by `sharded` alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetshape.llm.frames import stored, whole_row

SHARDS = 8
LAW = "bytes"
#: Atomic groups at most, as a power of two.
GROUP_BITS = 16
#: Rows that one numbering bucket holds on average, at most, and the least number of buckets per shard.
BUCKET_ROWS = 50_000
MIN_BUCKETS = 256


def capacity(prefix: list[int], shards: int) -> int:
    """Smallest capacity with which `shards` contiguous runs hold all groups; prefix: sums before each group, and the total."""
    largest = max((b - a for a, b in zip(prefix, prefix[1:])), default=0)
    low, high = max(largest, -(-prefix[-1] // shards)), prefix[-1]
    while low < high:
        middle, at = (low + high) // 2, 0
        for _ in range(shards):
            at = bisect_right(prefix, prefix[at] + middle) - 1
        low, high = (low, middle) if at == len(prefix) - 1 else (middle + 1, high)
    return low


def cuts(sizes: list[int], shards: int = SHARDS) -> list[int]:
    """Index of the first group of each shard after the first, for ordered group sizes."""
    prefix = [0, *accumulate(sizes)]
    room, last = capacity(prefix, shards), len(prefix) - 1
    least = [last] * (shards + 1)  # where shard j may start at the earliest, so that the rest fits
    for j in range(shards - 1, 0, -1):
        least[j] = bisect_left(prefix, prefix[least[j + 1]] - room)
    found, at = [], 0
    for j in range(1, shards):
        even = prefix[at] + (prefix[-1] - prefix[at]) / (shards - j + 1)
        right = min(bisect_left(prefix, even), last)
        near = right - 1 if right > at and even - prefix[right - 1] < prefix[right] - even else right
        at = min(max(near, least[j], at), bisect_right(prefix, prefix[at] + room) - 1)
        found.append(at)
    return found


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _group(text: Column) -> Column:
    return F.shiftright(F.xxhash64(text), 64 - GROUP_BITS)


def _placed(df: DataFrame, text: str, shards: int, **columns: Column) -> DataFrame:
    """`columns` with size, shard and slot."""
    own = {"__id": df["doc_id"], "__hash": F.xxhash64(df[text]), "__group": _group(df[text]), "size": size_of(df[text])}
    slim = stored(df.select(*[c.alias(k) for k, c in own.items()]), "sizes")
    groups = slim.groupBy("__group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("__group").collect()
    first = [groups[i]["__group"] if i < len(groups) else None for i in cuts([g["size"] for g in groups], shards)]
    shard = sum((F.when(F.col("__group") >= g, 1).otherwise(0) for g in first if g is not None), F.lit(0)).cast("int")
    buckets = max(MIN_BUCKETS, -(-sum(g["n"] for g in groups) // (shards * BUCKET_ROWS)))
    # By id and text, so that rows that share a null or a repeated id spread over buckets.
    bucket = F.pmod(F.xxhash64("__id", "__hash"), F.lit(buckets))
    counts = slim.groupBy(shard.alias("s"), bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("s").orderBy("b")) - F.col("n")
    starts = counts.select("s", "b", before.alias("__before"))

    rows = df.select(*[c.alias(k) for k, c in {**columns, **own}.items()])
    rows = rows.withColumns({"shard": shard, "__bucket": bucket})
    number = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy("__id", "__hash"))
    rows = rows.withColumn("__n", number).join(starts, (F.col("shard") == F.col("s")) & (F.col("__bucket") == F.col("b")))
    return rows.withColumn("slot", (F.col("__before") + F.col("__n") - 1).cast("long"))


def shard_rows(df: DataFrame, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row."""
    rows = _placed(df, text, shards, doc_id=df["doc_id"], text_crc32=F.crc32(df[text].cast("binary")))
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(df: DataFrame, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """All columns of `df` with shard and slot: ready to be written partitioned by shard."""
    rows = _placed(df, text, shards, __row=whole_row(df)).select("__row", "shard", "slot")
    own = [c for c in df.columns if c not in ("shard", "slot")]
    return rows.select(*[F.col(f"__row.`{c}`").alias(c) for c in own], "shard", "slot")
