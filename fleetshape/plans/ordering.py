"""Numbering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetshape.session import checkpoint_root, scratch_path

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written under the checkpoint root and read back: short lineage, column pruning intact."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Rows numbered 0, 1, 2 … in `order`.

    A range-partitioned sort, then each partition counts on from the rows before it. The
    last sort key makes ties splittable, so even one value shared by a third of the rows
    spreads over tasks. The sorted rows are checkpointed: a partition re-read after a lost
    executor must hold what was counted.
    """
    checkpoint_root(df.sparkSession)
    tie = "__tie"
    ordered = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*order, tie).drop(tie).checkpoint()
    marked = ordered.withColumn("__id", F.monotonically_increasing_id()).withColumn(
        "__part", F.shiftright("__id", _ROW_BITS))
    # One row per partition: bounded by the number of tasks, so one task may sum them up.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("__part").agg(F.count("*").alias("__rows")).withColumn(
        "__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    position = F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return marked.join(F.broadcast(offsets), "__part").withColumn(name, position).drop("__id", "__part", "__offset")


def lined(rows: DataFrame, keys: list[str], order: list[str], name: str = "line_no") -> DataFrame:
    """Rows numbered 0, 1, 2 … within each group of `keys`, in `order`.

    The groups are numbered as one sorted table, so a group with a third of all rows spreads
    over tasks like any other; what its rows are set off by is one number per group, written
    first, so that Spark knows its size and can split a large group's join.
    """
    placed = numbered(rows, [*keys, *order], "__position")
    starts = stored(placed.groupBy(*keys).agg(F.min("__position").alias("__start")), "starts")
    return placed.join(starts, keys).withColumn(name, F.col("__position") - F.col("__start")).drop("__position", "__start")
