"""Matching the two sides of a comparison on a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KNOWN_BIT = 16  # in `touched`: the side below 15 bits of truth values, and which of them are known above


def tag_sides(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both sides in one relation, marked by `is_source`."""
    return source.withColumn("is_source", F.lit(1)).unionByName(target.withColumn("is_source", F.lit(0)))


def match_sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pair every source row with the target row of its key, and keep target rows no source row claims.

    `rows` holds `is_source`, `ordinal` and a struct `row`; the result replaces them by
    structs `s` and `t` (one of them null for a one-sided row), `is_source` and `ordinal`.
    Where a key repeats on one side every row is kept, and a lookup into the other side
    finds the last one by ordinal.

    Both sides travel in one exchange and one sort, and each group is aggregated once.
    Groups are the repeats of one name inside one table, never a whole database.
    """
    whole = Window.partitionBy(*keys)
    is_target = F.col("is_source") == 0
    last_target = F.max_by(F.when(is_target, F.col("row")), F.when(is_target, F.col("ordinal")))
    return (
        rows.withColumns({"last_target": last_target.over(whole), "claimed": F.max("is_source").over(whole)})
        .where((F.col("is_source") == 1) | (F.col("claimed") == 0))
        .withColumn("s", F.when(F.col("is_source") == 1, F.col("row")))
        .withColumn("t", F.when(is_target, F.col("row")).otherwise(F.col("last_target")))
        .drop("row", "last_target", "claimed")
    )


def touched(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """pair_id, obj_key of the tables in which a column or item is on one side alone or differs.

    A row is `key` (hash of kind and name), its `ordinal`, and `row`: hashes a and b of what must agree, where a null agrees with
    anything, and truth values as bits `value`, of which those in `known` are not null. As in `match_sides` a source row meets
    the last target row of its key. What travels is flat, its bits and side in one number, and the rows of a key are
    aggregated: extremes of the source's hashes say whether any of them is unlike the target's.
    """
    bits = (F.shiftleft("row.known", _KNOWN_BIT) + F.shiftleft("row.value", 1) + F.col("is_source")).alias("bits")
    rows = tag_sides(src, tgt).select("pair_id", "obj_key", "key", "ordinal", "row.a", "row.b", bits).repartition("pair_id", "obj_key")
    is_source, known = F.col("bits").bitwiseAND(1) == 1, F.shiftright("bits", _KNOWN_BIT)
    value = F.shiftright("bits", 1).bitwiseAND((1 << _KNOWN_BIT - 1) - 1)

    def last_target(c: str) -> Column:
        return F.max_by(F.when(~is_source, F.col(c)), F.when(~is_source, F.col("ordinal")))

    def of_source(aggregate, c: Column) -> Column:
        return aggregate(F.when(is_source, c))

    groups = rows.groupBy("pair_id", "obj_key", "key").agg(
        F.max(F.col("bits").bitwiseAND(1)).alias("claimed"), *[f(c).alias(f"{name}_{c}") for c in ("a", "b") for name, f in (
            ("least", lambda c: of_source(F.min, F.col(c))), ("most", lambda c: of_source(F.max, F.col(c))), ("t", last_target))],
        last_target("bits").alias("t_bits"), of_source(F.bit_or, known.bitwiseAND(value)).alias("on"),
        of_source(F.bit_or, known.bitwiseAND(F.bitwise_not(value))).alias("off"))
    t_known, t_value = F.shiftright("t_bits", _KNOWN_BIT), F.shiftright("t_bits", 1)
    apart = F.col("on").bitwiseAND(F.bitwise_not(t_value)).bitwiseOR(F.col("off").bitwiseAND(t_value)).bitwiseAND(t_known)
    unlike = [F.col(f"{x}_{c}") != F.col(f"t_{c}") for c in ("a", "b") for x in ("least", "most")]
    differs = reduce(lambda x, y: x | y, [F.col("claimed") == 0, F.col("t_bits").isNull(), *unlike, apart != 0])
    return groups.where(differs).select("pair_id", "obj_key").distinct()


def last_wins(rows: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """One row per key: the last by `order`. Combines on the map side, so a repeated key stays cheap."""
    payload = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(order)).alias("kept"))
    return picked.select(*keys, *[F.col(f"kept.{c}").alias(c) for c in payload])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
