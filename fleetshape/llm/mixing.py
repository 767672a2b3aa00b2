"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and stand in a queue, repeated up to REPEATS
times. An entry's virtual finish time is its source's words up to and with it, divided by the
source's target. All entries, in order of that time, are taken until the total budget is full.

Along a queue the finish time only grows, so what a source gives is a prefix of its shuffled
order: whole passes and one cut in the next. The plan is one row per source (its targets and
cuts); documents are then decided by comparing their own hash with it, without being sorted or
joined by id. Words up to a document are counted in hash buckets, each summed on its own and
set off by the sums before it, so a source with a third of all rows is spread like any other.
The cut is found by counting words per digit of the finish time, from the leading one down.

Only DataFrame functions. Defined results: null text has size 0 and is taken 0 words; a null
source is a source, the last; rows with one id stand together in the queue; null ids are
shuffled by their text; without any words all targets are 0; an empty table gives an empty one;
further columns are carried by `mix` alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetshape.llm.frames import stored, whole_row

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Ticks of one unit of virtual time, as a power of two, and bits of a tick that one count looks at.
TICK_BITS = 36
DIGIT_BITS = 16
#: Rows that one bucket of the shuffled order holds on average, at most.
BUCKET_ROWS = 50_000
#: Sources up to which the plan is broadcast (about 200 bytes each); beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(df: DataFrame, text: str) -> Column:
    """Where a document stands in its source's queue: 32 hex digits."""
    return F.md5(F.coalesce(df["doc_id"].cast("string"), df[text], F.lit("")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """`sources` (source, source_size) with weight and target words.

    Filling by weight up to a cap of `repeats` sizes: with sources ordered by cap over weight, the
    level is the most that any of them would get per weight, were those before it at their caps.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    which = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", which).withColumn("cap", repeats * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    leveled = ranked.withColumn("level", left / F.sum("weight").over(after))
    return leveled.withColumn("level", F.max("level").over(whole)).select(
        "source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _cut(entries: DataFrame, budget: int) -> int:
    """The largest tick up to which the words of `entries` (tick, size) fit the budget; -1: not even the first."""
    prefix, known = 0, 0
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = entries if shift == 64 - DIGIT_BITS else entries.where(F.shiftright("tick", shift + DIGIT_BITS) == prefix)
        digits = inside.groupBy(F.shiftright("tick", shift).alias("digit")).agg(F.sum("size").alias("size")).orderBy("digit").collect()
        for digit, size in digits:  # at most 2 ** DIGIT_BITS rows
            if known + size > budget:
                prefix = digit
                break
            known += size
        else:
            return (1 << 62) if shift == 64 - DIGIT_BITS else ((prefix + 1) << (shift + DIGIT_BITS)) - 1
    return prefix - 1


def plan(slim: DataFrame) -> DataFrame:
    """A row per source of `slim` (source, size, key): source_size, target, and cuts, the last key of each pass."""
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    of_source = stored(sums, "sources")
    total, rows = of_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    digits = max(2, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    wanted = stored(targets(of_source.select("source", "source_size")), "targets")

    bucket = F.substring("key", 1, digits).alias("bucket")
    units = slim.where("size > 0").groupBy("source", bucket, "key").agg(F.sum("size").alias("size"))
    sums = units.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    earlier = F.sum("sum").over(W.partitionBy("source").orderBy("bucket")) - F.col("sum")
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), earlier.alias("before"))
    inner = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key"))
    here = units.withColumn("inner", inner)
    placed = here.join(starts, here["source"].eqNullSafe(starts["s"]) & (here["bucket"] == starts["b"]))
    queue = placed.select("source", "key", "size", (F.col("before") + F.col("inner")).alias("upto"))
    of = wanted.withColumnsRenamed({"source": "s"})
    few = wanted.count() <= BROADCAST_SOURCES
    queue = queue.join(F.broadcast(of) if few else of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    turns = F.explode(F.array(*[F.lit(i) for i in range(REPEATS)])).alias("turn")
    tick = F.floor((F.col("upto") + F.col("turn") * F.col("source_size")) / F.col("target") * F.lit(float(1 << TICK_BITS)))
    entries = stored(queue.select("*", turns).select("source", "turn", "key", "size", tick.alias("tick")), "entries")

    last = _cut(entries, total)
    taken = entries.where(F.col("tick") <= last).groupBy(F.col("source").alias("s")).agg(
        *[F.max(F.when(F.col("turn") == i, F.col("key"))).alias(f"cut{i}") for i in range(REPEATS)])
    return wanted.join(taken, wanted["source"].eqNullSafe(taken["s"]), "left").drop("s")


def _planned(df: DataFrame, text: str, source: str, **columns: Column) -> DataFrame:
    """`columns` with __size, __times (how often the mix takes the row), source_size and target."""
    own = {"__source": df[source], "__size": word_count(df[text]), "__key": shuffle_key(df, text)}
    slim = stored(df.select(own["__source"].alias("source"), own["__size"].alias("size"), own["__key"].alias("key")), "sizes")
    chosen = stored(plan(slim), "plan")
    rows = df.select(*[c.alias(k) for k, c in {**columns, **own}.items()])
    few = chosen.count() <= BROADCAST_SOURCES
    times = sum((F.when(F.col("__key") <= F.col(f"cut{i}"), 1).otherwise(0) for i in range(REPEATS)), F.lit(0))
    joined = rows.join(F.broadcast(chosen) if few else chosen, F.col("__source").eqNullSafe(F.col("source")))
    return joined.withColumn("__times", times)


def taken(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per input row."""
    rows = _planned(df, text, source, doc_id=df["doc_id"])
    return rows.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__times")).alias("taken"))


def mix(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The mix: every row as often as it is taken (not at all, or up to REPEATS times), with all its columns."""
    rows = _planned(df, text, source, __row=whole_row(df))
    return rows.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__times"))).alias("__copy")).select("__row.*")
