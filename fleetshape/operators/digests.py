"""A digest tree per snapshot - column or item, table, database - so that equal parts are not compared.

Most databases of a fleet, and most tables of the others, are what they should be. The tree is built once per snapshot,
however many pairs use it: each column and item becomes two 64-bit hashes of what its comparison looks at, a table the
sums of its rows' hashes, a database the sums over its objects. Pairs then join digests: pairs of equal databases leave nothing to
compare, and of the others only tables whose digests differ are copied to the pair and matched.

A digest covers all that the comparison of a table looks at and nothing else, so equal digests mean no change and no warning,
but for a chance of two 64-bit collisions at once. A table in which a key repeats is always compared, as there the order of rows counts;
keys are told by 32 bits, so that one table in many millions is compared for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetshape.compare import CONSTRAINT_RELATIONS, FleetDiff
from fleetshape.functions.render import column_type, fields
from fleetshape.functions.text import normalize_text, text_digest
from fleetshape.model import obj_key, table_key
from fleetshape.operators import constraints as K
from fleetshape.operators.filters import OF_TABLES
from fleetshape.operators.matching import union_all
from fleetshape.plans.ordering import stored

SCOPE = "snapshot_id"
_SUM = "decimal(38,0)"
#: Bits that tell which tables may be wanted, and of one word of them.
_MARKS, _WORD_BITS = 1 << 26, 6


def _hashes(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((0, "h1"), (1, "h2"))]


def _of_table() -> Column:
    return table_key(F.col("schema_name"), F.col("table_name")).alias("obj_key")


def column_digests(columns: DataFrame) -> DataFrame:
    """One row per column: snapshot_id, obj_key, key (hash of kind and name), h1, h2."""
    r = fields()
    facets = [F.upper("name"), F.upper(column_type(r)), F.upper("collation_name"), F.upper("identity_seed"), F.upper("identity_increment"),
              normalize_text(F.col("computed_definition")), normalize_text(F.col("default_definition")),
              *[F.col(f) for f in ("is_nullable", "is_identity", "is_computed", "is_persisted", "is_row_guid")]]
    # A null does not enter a hash: null and absent facets must not read like their neighbours.
    known = [x for f in facets for x in (f.isNull(), f)]
    return columns.select(SCOPE, _of_table(), F.hash(F.lit(0), F.upper("name")).alias("key"), *_hashes(F.lit(0), *known))


def item_digests(relation: str, rows: DataFrame) -> DataFrame:
    """The same for the rows of one constraint relation."""
    items = K.items(relation, rows.withColumnRenamed(SCOPE, "pair_id"), False)
    return items.select(
        F.col("pair_id").alias(SCOPE), "obj_key", F.hash("kind_rank", "match_key").alias("key"),
        *_hashes("kind_rank", "match_key", F.size("row.facets"), F.array_join("row.facets", "\0", "\1")))


def table_digests(relations: dict[str, DataFrame]) -> DataFrame:
    """snapshot_id, obj_key, d1, d2, repeats: one row per table with rows. One exchange, of hashes alone."""
    parts = [column_digests(relations["columns"])] if "columns" in relations else []
    parts += [item_digests(n, relations[n]) for n in CONSTRAINT_RELATIONS if n in relations]
    placed = union_all(parts).repartition(SCOPE, "obj_key")
    by_key = placed.groupBy(SCOPE, "obj_key", "key").agg(
        *[F.sum(F.col(h).cast(_SUM)).alias(h) for h in ("h1", "h2")], F.count(F.lit(1)).alias("n"))
    return by_key.groupBy(SCOPE, "obj_key").agg(F.sum("h1").alias("d1"), F.sum("h2").alias("d2"), F.max(F.col("n") > 1).alias("repeats"))


def database_digests(objects: DataFrame, tables: DataFrame) -> DataFrame:
    """snapshot_id, d1, d2, repeats: objects with their text and model flag, and the digests of all tables."""
    own = objects.select(SCOPE, *_hashes(F.lit("object"), "obj_key", "digest", "has_model"), F.lit(False).alias("repeats"))
    inner = tables.select(SCOPE, *_hashes(F.lit("table"), "obj_key", "d1", "d2"), "repeats")
    return own.unionByName(inner).groupBy(SCOPE).agg(
        *[F.sum(F.col(h).cast(_SUM)).alias(d) for h, d in (("h1", "d1"), ("h2", "d2"))], F.max("repeats").alias("repeats"))


@dataclass
class Tree:
    """Relations of snapshots with their stored digests."""

    relations: dict[str, DataFrame]
    objects: DataFrame
    tables: DataFrame
    databases: DataFrame


def build_tree(relations: dict[str, DataFrame]) -> Tree:
    """Hashes every snapshot of `relations` once and keeps the digests as tables."""
    key = obj_key(F.col("obj_type"), F.col("schema_name"), F.col("obj_name"))
    objects = stored(relations["objects"].withColumns({"obj_key": key, "digest": text_digest(F.col("definition"))}), "object-digests")
    tables = stored(table_digests(relations), "table-digests")
    return Tree(relations, objects.drop("obj_key"), tables, stored(database_digests(objects, tables), "database-digests"))


def unequal_pairs(pairs: DataFrame, src: Tree, tgt: Tree) -> DataFrame:
    """Pairs (pair_id and both snapshot ids) whose databases are not the same; one digest row per snapshot is all that is read."""
    sides = [t.databases.withColumnsRenamed({SCOPE: f"{s}_snapshot_id", "d1": f"{s}1", "d2": f"{s}2", "repeats": f"{s}_repeats"})
             for s, t in (("source", src), ("target", tgt))]
    met = pairs.select("pair_id", "source_snapshot_id", "target_snapshot_id")
    for s, side in zip(("source", "target"), sides):
        met = met.join(side, f"{s}_snapshot_id", "left")
    same = (F.col("source1") == F.col("target1")) & (F.col("source2") == F.col("target2")) & ~F.col("source_repeats") & ~F.col("target_repeats")
    empty = F.col("source1").isNull() & F.col("target1").isNull()
    return met.where(~F.coalesce(same, F.lit(False)) & ~empty).select("pair_id", "source_snapshot_id", "target_snapshot_id")


def unequal_tables(pairs: DataFrame, src: Tree, tgt: Tree) -> DataFrame:
    """pair_id, obj_key of tables whose digests differ or that one side has alone."""
    sides = [t.tables.join(pairs.select("pair_id", F.col(f"{s}_snapshot_id").alias(SCOPE)), SCOPE).select(
        "pair_id", "obj_key", F.struct("d1", "d2").alias(f"{s}_d"), F.col("repeats").alias(f"{s}_r")) for s, t in (("source", src), ("target", tgt))]
    met = sides[0].join(sides[1], ["pair_id", "obj_key"], "full_outer")
    apart = ~F.col("source_d").eqNullSafe(F.col("target_d"))
    return met.where(apart | F.coalesce("source_r", F.lit(False)) | F.coalesce("target_r", F.lit(False))).select("pair_id", "obj_key")


def _mark() -> Column:
    return F.pmod(F.xxhash64(SCOPE, "obj_key"), F.lit(_MARKS))


def marks(wanted: DataFrame) -> DataFrame:
    """word, bits: a bit for each table of `wanted` (snapshot_id, obj_key). At most 1,048,576 words, whatever the fleet."""
    bit = F.expr(f"shiftleft(1L, cast(mark & {(1 << _WORD_BITS) - 1} as int))")
    return wanted.withColumn("mark", _mark()).groupBy(F.shiftright("mark", _WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def marked(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (with snapshot_id, obj_key) whose table has its bit set, told where they are read: all that are wanted, and of the others those that share a bit."""
    told = rows.withColumns({"mark": _mark(), "word": F.shiftright(_mark(), _WORD_BITS)}).join(F.broadcast(words), "word")
    return told.where(F.expr(f"shiftright(bits, cast(mark & {(1 << _WORD_BITS) - 1} as int)) & 1 = 1")).drop("mark", "word", "bits")


def pruned_diff(pairs: DataFrame, src: Tree, tgt: Tree) -> FleetDiff:
    """The comparison of `pairs`, which holds the rows of unequal databases and tables alone. Its counts, actions and drift are those of the whole."""
    open_pairs = stored(unequal_pairs(pairs, src, tgt), "unequal-pairs")
    open_tables = stored(unequal_tables(open_pairs, src, tgt), "unequal-tables")

    def side(name: str, tree: Tree) -> dict[str, DataFrame]:
        scope = open_pairs.select("pair_id", F.col(f"{name}_snapshot_id").alias(SCOPE))
        wanted = open_tables.join(scope, "pair_id")
        words = stored(marks(wanted), "marks")
        out = {"objects": tree.objects.join(scope, SCOPE).drop(SCOPE)}
        for relation in set(OF_TABLES) & set(tree.relations):
            rows = tree.relations[relation].withColumn("obj_key", _of_table())
            out[relation] = marked(rows, words).join(wanted, [SCOPE, "obj_key"]).drop(SCOPE, "obj_key")
        return out

    return FleetDiff(pairs, side("source", src), side("target", tgt))
