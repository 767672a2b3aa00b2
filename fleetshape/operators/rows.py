"""Row-level work on target tables: checks before a change, and the change itself.

Checks count offending rows in one pass or behind a map-side aggregate. Changes are
projections of the table, so existing rows survive by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetshape.plans.ordering import numbered, stored

# ---- changes


def add_column(df: DataFrame, name: str, dtype: str | T.DataType, default: Column | None = None, nullable: bool = True) -> DataFrame:
    """Added column. A NOT NULL one takes its default on every row; a nullable one starts out null."""
    value = default if default is not None and not nullable else F.lit(None)
    return df.withColumn(name, value.cast(dtype))


def alter_type(df: DataFrame, name: str, dtype: str | T.DataType) -> DataFrame:
    """Retyped column; run `check_narrowing` first, a value that does not fit fails the job."""
    return df.withColumn(name, F.col(name).cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def recompute(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Computed column dropped and added again from its expression, as the last column."""
    return df.drop(name).withColumn(name, expr)


def add_identity(df: DataFrame, name: str, order: list[Column | str], seed: int = 1, increment: int = 1) -> DataFrame:
    """Identity values over existing rows in `order`, numbered across tasks."""
    return numbered(df, order, "__n").withColumn(name, F.lit(seed) + F.col("__n") * increment).drop("__n")


def rebuild(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """DROP and CREATE: the new shape without any row."""
    return df.sparkSession.createDataFrame([], schema or df.schema)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns picked by name ignoring case and position, cast to `schema`; a missing one is null."""
    have = {c.upper(): c for c in df.columns}
    return df.select(*[
        (F.col(have[f.name.upper()]) if f.name.upper() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


# ---- checks


def check_add_notnull(df: DataFrame, table: str) -> DataFrame:
    """Rows that would make an added NOT NULL column without a default fail: all of them."""
    return df.agg(F.count("*").alias("offending")).select(F.lit(table).alias("table_name"), "offending")


def check_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs in columns about to become NOT NULL: one pass for all of them."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "offending")


@dataclass(frozen=True)
class Narrowing:
    """A planned narrowing: `max_chars` (UTF-16 units, nvarchar) or `max_bytes` (UTF-8, varchar) for text, else a target type."""

    column: str
    max_chars: int | None = None
    dtype: str | None = None
    max_bytes: int | None = None

    def lost(self) -> tuple[Column, Column]:
        """(value does not fit, value fits but loses digits). Text beyond the length does not fit."""
        c = F.col(self.column)
        if self.max_chars is not None:
            return F.coalesce(F.octet_length(F.encode(c, "UTF-16BE")) > 2 * self.max_chars, F.lit(False)), F.lit(False)
        if self.max_bytes is not None:
            return F.coalesce(F.octet_length(c) > self.max_bytes, F.lit(False)), F.lit(False)
        kept = c.try_cast(self.dtype)
        return c.isNotNull() & kept.isNull(), F.coalesce(kept != c, F.lit(False))


def check_narrowing(df: DataFrame, specs: list[Narrowing]) -> DataFrame:
    """Values a narrowing would lose, one row per column, in one pass."""
    lost = {s.column: s.lost() for s in specs}
    aggs = [F.count_if(fit).alias(f"{c}|0") for c, (fit, _) in lost.items()]
    aggs += [F.count_if(digits).alias(f"{c}|1") for c, (_, digits) in lost.items()]
    counts = df.agg(F.struct(*aggs).alias("n"))
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"n.`{c}|0`").alias("does_not_fit"),
                        F.col(f"n.`{c}|1`").alias("loses_digits")) for c in lost]
    return counts.select(F.inline(F.array(*entries)))


def folded(text: Column) -> Column:
    """Text as a case-insensitive collation compares it: without case and trailing blanks."""
    return F.upper(F.rtrim(text))


def check_unique(df: DataFrame, cols: list[str], where: Column | None = None, primary_key: bool = False,
                 ignore_case: tuple[str, ...] = ()) -> DataFrame:
    """Key values that occur more than once. NULLs group together: a unique constraint allows one such row.

    For a primary key a NULL in any key column offends by itself. Columns of `ignore_case` are
    compared, and shown, as `folded`.
    """
    rows = df if where is None else df.where(where)
    rows = rows.withColumns({c: folded(F.col(c)) for c in ignore_case}) if ignore_case else rows
    counted = rows.groupBy(*cols).agg(F.count("*").alias("copies"))
    has_null = F.lit(False)
    if primary_key:
        for c in cols:
            has_null = has_null | F.col(c).isNull()
    return counted.where((F.col("copies") > 1) | has_null)


def check_fk(child: DataFrame, parent: DataFrame, pairs: dict[str, str], trusted: bool = True,
             ignore_case: tuple[str, ...] = ()) -> DataFrame:
    """Child key values without a parent, with their row counts. A NULL in any key column passes.

    The child is reduced to distinct keys before it meets the parent, so a key shared by a
    third of the rows is one row in the join. An untrusted key is not checked. Child columns of
    `ignore_case`, and their parents', are compared, and shown, as `folded`.
    """
    keys = list(pairs)
    if ignore_case:
        child = child.withColumns({c: folded(F.col(c)) for c in ignore_case})
        parent = parent.withColumns({pairs[c]: folded(F.col(pairs[c])) for c in ignore_case})
    counted = child.groupBy(*keys).agg(F.count("*").alias("rows"))
    for key in keys:
        counted = counted.where(F.col(key).isNotNull())
    if not trusted:
        return counted.where("false")
    parents = parent.select(*[F.col(p).alias(c) for c, p in pairs.items()]).distinct()
    return counted.join(parents, keys, "left_anti")


def check_predicate(df: DataFrame, predicate: Column, name: str, trusted: bool = True) -> DataFrame:
    """Rows breaking a check constraint; an unknown result passes, an untrusted check is not run."""
    broken = F.count_if(~predicate) if trusted else F.lit(0).cast("bigint")
    return df.agg(broken.alias("offending")).select(F.lit(name).alias("check_name"), "offending")


def check_lost_to_computed(df: DataFrame, cols: list[str]) -> DataFrame:
    """Stored values that go when a plain column becomes computed."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "offending")


# ---- conservation and shape


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count and order-independent sum of row hashes: no row is shuffled."""
    return df.agg(F.count("*").alias("rows"),
                  F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"))


def conserved(before: DataFrame, after: DataFrame, cols: list[str], table: str) -> DataFrame:
    """Whether every row survived with the untouched `cols` unchanged."""
    b = fingerprint(before, cols).withColumnsRenamed({"rows": "rows_before", "hash_sum": "h1"})
    a = fingerprint(after, cols).withColumnsRenamed({"rows": "rows_after", "hash_sum": "h2"})
    one = F.lit(1).alias("one")
    both = b.select("*", one).join(a.select("*", one), "one")  # two single rows
    return both.select(F.lit(table).alias("table_name"), "rows_before", "rows_after",
                       ((F.col("rows_before") == F.col("rows_after")) & (F.col("h1") == F.col("h2"))).alias("conserved"))


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys whose rows differ between the two, found in one exchange of per-key sums."""
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    tagged = before.select(*keys, h.alias("h"), F.lit(1).alias("n")).unionByName(
        after.select(*keys, (-h).alias("h"), F.lit(-1).alias("n")))
    return tagged.groupBy(*keys).agg(F.sum("h").alias("h"), F.sum("n").alias("n")).where("h <> 0 or n <> 0").select(*keys)


#: Buckets of keys whose sums are compared first: what the second pass is told, and all that the first one shuffles per task.
BUCKETS = 1 << 16


def _bucketed(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("__bucket"),
                     F.xxhash64(*keys, *[x for c in cols for x in (F.col(c).isNull(), F.col(c))]).cast("decimal(38,0)").alias("__h"))


def unequal_buckets(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Buckets of keys whose rows are not the same on both sides. Sums are combined in the tasks: at most BUCKETS rows of each are shuffled."""
    sides = [_bucketed(df, keys, cols).groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("__h").alias("h")) for df in (before, after)]
    tagged = sides[0].unionByName(sides[1].select("__bucket", (-F.col("n")).alias("n"), (-F.col("h")).alias("h")))
    return tagged.groupBy("__bucket").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).where("n <> 0 or h <> 0").select("__bucket")


def lost_rows(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys whose rows differ: `keys`, rows_before, rows_after, change (lost, added, changed).

    Bucket sums say where to look; both tables are then read once more, but only rows of unequal buckets are shuffled, so a change
    that lost nothing costs two scans, and one that lost a few rows little more. Keys may repeat and be null.
    """
    # Stored, so that both scans below know its size; at most BUCKETS rows.
    where = stored(unequal_buckets(before, after, keys, cols), "unequal-buckets")
    sides = [_bucketed(df, keys, cols).join(F.broadcast(where), "__bucket").withColumn("__sign", F.lit(sign)) for df, sign in ((before, 1), (after, -1))]
    per_key = sides[0].unionByName(sides[1]).groupBy(*keys).agg(
        F.count_if(F.col("__sign") == 1).alias("rows_before"), F.count_if(F.col("__sign") == -1).alias("rows_after"), F.sum(F.col("__h") * F.col("__sign")).alias("__sum"))
    change = F.when(F.col("rows_after") < F.col("rows_before"), "lost").when(F.col("rows_after") > F.col("rows_before"), "added").otherwise("changed")
    return per_key.where("rows_before <> rows_after or __sum <> 0").select(*keys, "rows_before", "rows_after", change.alias("change"))


def same_shape(src: DataFrame, tgt: DataFrame, scope: list[str], ordered: bool = True) -> DataFrame:
    """Per table: columns that stand on one side only, by name and type and, if `ordered`, by place.

    `src` and `tgt` hold `scope`, `ordinal`, `name`, `type_text`. A signed count per row is
    EXCEPT ALL in both directions in one exchange.
    """
    cols = [*scope, *(["ordinal"] if ordered else []), "name_key", "type_text"]

    def rows(df: DataFrame, sign: int) -> DataFrame:
        return df.withColumn("name_key", F.upper("name")).select(*cols, F.lit(sign).alias("sign"))

    balance = rows(src, 1).unionByName(rows(tgt, -1)).groupBy(*cols).agg(F.sum("sign").alias("extra"))
    return balance.groupBy(*scope).agg(
        F.sum(F.greatest("extra", F.lit(0))).alias("only_source"), F.sum(F.greatest(-F.col("extra"), F.lit(0))).alias("only_target"))
