"""Object-level comparison: what was added, changed, removed or skipped in every pair.

`pairs` is one row per comparison: `pair_id`, the two snapshot ids, and the option columns
`include_drops, include_table_drops, allow_rebuild, add_only`. Its size is that of the
fleet, not of the catalogs; Spark broadcasts it while its measured size allows and splits
a database that dominates the join through AQE where it does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.functions.text import quote2, text_digest
from fleetshape.model import TABLE, identifier, obj_key

OPTIONS = ["include_drops", "include_table_drops", "allow_rebuild", "add_only"]

# Actions that put a source object into the script, hence pull in its prerequisites.
EMITTING = ["create", "recreate", "rebuild", "alter"]


def with_mode_defaults(pairs: DataFrame, mode: str) -> DataFrame:
    """Unset options take the defaults of `diff` (all off) or `drift` (both drop options on)."""
    on = F.lit(mode == "drift")
    defaults = {"include_drops": on, "include_table_drops": on,
                "allow_rebuild": F.lit(False), "add_only": F.lit(False)}
    have = set(pairs.columns)
    return pairs.withColumns({
        name: F.coalesce(F.col(name), default) if name in have else default for name, default in defaults.items()
    })


def attach_side(relations: dict[str, DataFrame], pairs: DataFrame, side: str) -> dict[str, DataFrame]:
    """Relations scoped by snapshot, rescoped to the pairs that use it as `side` (source or target)."""
    scope = pairs.select("pair_id", F.col(f"{side}_snapshot_id").alias("snapshot_id"))
    return {name: rows.join(scope, "snapshot_id").drop("snapshot_id") for name, rows in relations.items()}


def duplicate_keys(objects: DataFrame, scope: str = "snapshot_id") -> DataFrame:
    """Object keys that occur more than once ignoring case; such a snapshot cannot be compared."""
    key = obj_key(F.col("obj_type"), F.col("schema_name"), F.col("obj_name"))
    return objects.groupBy(scope, key.alias("obj_key")).agg(F.count("*").alias("copies")).where("copies > 1")


def repeated_keys(src_objects: DataFrame, tgt_objects: DataFrame) -> DataFrame:
    """Duplicate keys of either side of a comparison: pair_id, side, obj_key, copies. Keys alone are shuffled, once."""
    sides = keyed(src_objects).withColumn("side", F.lit("source")).unionByName(keyed(tgt_objects).withColumn("side", F.lit("target")))
    return sides.groupBy("pair_id", "side", "obj_key").agg(F.count("*").alias("copies")).where("copies > 1")


def _keyed(objects: DataFrame) -> DataFrame:
    """Key and digest of each object; a relation that brings `digest` along was hashed before.

    Two digests are compared under one key, never looked up among all: half of SHA-256 is enough to travel.
    """
    digest = F.substring(F.col("digest") if "digest" in objects.columns else text_digest(F.col("definition")), 1, 16)
    return objects.select(
        "pair_id", obj_key(F.col("obj_type"), F.col("schema_name"), F.col("obj_name")).alias("obj_key"),
        "obj_type",
        F.struct("schema_name", "obj_name", "has_model", digest.alias("digest")).alias("row"),
    )


def keyed(objects: DataFrame) -> DataFrame:
    """Scope and key of each object."""
    return objects.select("pair_id", obj_key(F.col("obj_type"), F.col("schema_name"), F.col("obj_name")).alias("obj_key"))


def match_objects(src_objects: DataFrame, tgt_objects: DataFrame) -> DataFrame:
    """Objects of both sides joined on `(pair_id, obj_key)`. Definitions stay behind; digests travel."""
    s = _keyed(src_objects).withColumnsRenamed({"row": "s", "obj_type": "s_type"})
    t = _keyed(tgt_objects).withColumnsRenamed({"row": "t", "obj_type": "t_type"})
    return s.join(t, ["pair_id", "obj_key"], "full_outer").select(
        "pair_id", "obj_key", F.coalesce("s_type", "t_type").alias("obj_type"), "s", "t")


def comparable_tables(matched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tables compared by structure: on both sides, modelled on both, rebuild off."""
    structural = (
        (F.col("obj_type") == TABLE) & F.coalesce(F.col("s.has_model") & F.col("t.has_model"), F.lit(False))
    )
    return (
        matched.where(structural)
        .join(pairs.where(~F.col("allow_rebuild")).select("pair_id", "include_drops"), "pair_id")
        .select("pair_id", "obj_key", quote2(F.col("s.schema_name"), F.col("s.obj_name")).alias("table_ident"),
                "include_drops")
    )


def classify_objects(matched: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per object that matters: `outcome` (added, changed, removed, kept), `action`, `skipped`.

    `counts` are the structural change and warning counts of the comparable tables; every
    other matched object is compared by the digest of its normalised text.
    """
    # What the action is told from, so that neither side's digest travels to the counts.
    side = F.coalesce("s", "t")
    told = matched.select(
        "pair_id", "obj_key", "obj_type", F.col("s").isNotNull().alias("on_src"), F.col("t").isNotNull().alias("on_tgt"),
        (F.col("s.has_model") & F.col("t.has_model")).alias("modelled"), (F.col("s.digest") != F.col("t.digest")).alias("text_differs"),
        side["schema_name"].alias("schema_name"), side["obj_name"].alias("obj_name"))
    rows = told.join(pairs.select("pair_id", *OPTIONS), "pair_id").join(counts, ["pair_id", "obj_key"], "left")
    is_table, on_both = F.col("obj_type") == TABLE, F.col("on_src") & F.col("on_tgt")
    structural = on_both & is_table & ~F.col("allow_rebuild") & F.col("modelled")
    touched = F.coalesce((F.col("changes") > 0) | (F.col("warnings") > 0), F.lit(False))
    differs = F.when(structural, touched).otherwise(F.col("text_differs"))
    drops = F.col("include_drops") & ~F.col("add_only")

    action = (
        F.when(~F.col("on_tgt"), "create")
        .when(~F.col("on_src") & ~drops, "ignore")
        .when(~F.col("on_src") & is_table & ~F.col("include_table_drops"), "keep_table")
        .when(~F.col("on_src"), "drop")
        .when(~differs, "ignore")
        .when(F.col("add_only"), "skip_add_only")
        .when(structural, "alter")
        .when(is_table & F.col("allow_rebuild"), "rebuild")
        .when(is_table, "skip_no_model")
        .otherwise("recreate")
    )
    outcome = (
        F.when(F.col("action") == "create", "added").when(F.col("action") == "drop", "removed")
        .when(F.col("action") == "keep_table", "kept").otherwise("changed")
    )
    return (
        rows.withColumn("action", action).where(F.col("action") != "ignore")
        .withColumn("outcome", outcome)
        .select("pair_id", "obj_key", "obj_type", "schema_name", "obj_name",
                identifier(F.col("schema_name"), F.col("obj_name")).alias("identifier"), "outcome", "action",
                F.col("action").isin("skip_add_only", "skip_no_model", "keep_table").alias("skipped"))
    )


def objects_added(matched: DataFrame) -> DataFrame:
    return matched.where("t is null").select(
        "pair_id", "obj_key", "obj_type", identifier(F.col("s.schema_name"), F.col("s.obj_name")).alias("identifier"))


def text_changes(matched: DataFrame) -> DataFrame:
    """Objects on both sides whose normalised text differs."""
    return matched.where(F.col("s.digest") != F.col("t.digest")).select(
        "pair_id", "obj_key", "obj_type", identifier(F.col("s.schema_name"), F.col("s.obj_name")).alias("identifier"))


def target_only(matched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drops and kept tables among the target-only objects of pairs that ask for drops."""
    gated = pairs.where(F.col("include_drops") & ~F.col("add_only")).select("pair_id", "include_table_drops")
    kept = (F.col("obj_type") == TABLE) & ~F.col("include_table_drops")
    return (
        matched.where("s is null").join(gated, "pair_id")
        .select("pair_id", "obj_key", identifier(F.col("t.schema_name"), F.col("t.obj_name")).alias("identifier"),
                F.when(kept, "keep_table").otherwise("drop").alias("action"),
                F.when(kept, "kept").otherwise("removed").alias("outcome"), kept.alias("skipped"))
    )


def drift(pairs: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per pair with its counts. Skipped objects alone are not drift."""
    def count(condition):
        return F.count_if(condition)

    per_pair = actions.groupBy("pair_id").agg(
        count(F.col("outcome") == "added").alias("added"),
        count(F.col("outcome") == "changed").alias("changed"),
        count(F.col("outcome") == "removed").alias("removed"),
        count(F.col("skipped")).alias("skipped"),
    )
    zero = F.lit(0).cast("bigint")
    refused = F.when(F.col("include_drops") & F.col("add_only"), 1).otherwise(0)
    return (
        pairs.select("pair_id", "include_drops", "add_only").join(per_pair, "pair_id", "left")
        .select("pair_id", *[F.coalesce(c, zero).alias(c) for c in ("added", "changed", "removed")],
                (F.coalesce("skipped", zero) + refused).alias("skipped"))
        .withColumn("drifted", (F.col("added") + F.col("changed") + F.col("removed")) > 0)
    )
