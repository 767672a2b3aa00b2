"""Comparison of keys, checks, foreign keys and indexes through one generic relation.

Each kind is projected to the same shape - match key, facets that must agree, columns it
touches, and its own fields - so one set comparison serves all four. Statements are written behind it,
for items that have a step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetshape.functions import messages, render
from fleetshape.functions.render import Row, fields
from fleetshape.functions.text import normalize_text
from fleetshape.model import CHECK_FIELDS, FK_FIELDS, INDEX_FIELDS, KEY_FIELDS, table_key
from fleetshape.operators.columns import PHASE_POST, PHASE_PRE, PHASE_WARNING, Step, expand_steps, step_numbers
from fleetshape.operators.matching import match_sides, tag_sides, union_all

# Order in which the kinds are compared inside a table.
KIND_LABELS = {1: "key constraint", 2: "check constraint", 3: "foreign key", 4: "index"}

_row = fields()


def key_match_key(row: Row) -> Column:
    """Name, or the shape when the server chose the name. Index type is not part of the shape."""
    shape = F.array_join(
        F.transform(row("columns"), lambda c: F.concat(c["name"], F.lit(":"), c["is_descending"].cast("string"))), ",")
    return F.upper(F.when(row("is_system_named"), F.concat(F.lit("~"), row("type_code"), F.lit(":"), shape))
                   .otherwise(row("name")))


def check_match_key(row: Row) -> Column:
    return F.upper(F.when(row("is_system_named"), F.concat(F.lit("~CK:"), normalize_text(row("definition"))))
                   .otherwise(row("name")))


def _fk_pairs(row: Row) -> Column:
    return F.transform(row("columns"), lambda c: F.concat(c["parent_column"], F.lit(">"), c["referenced_column"]))


def fk_match_key(row: Row) -> Column:
    shape = F.concat(F.lit("~FK:"), row("referenced_schema"), F.lit("."), row("referenced_table"), F.lit(":"),
                     F.array_join(_fk_pairs(row), ","))
    return F.upper(F.when(row("is_system_named"), shape).otherwise(row("name")))


def index_match_key(row: Row) -> Column:
    return F.upper(row("name"))


def _as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _column_facets(row: Row) -> Column:
    """Three entries per column, so that no separator inside a name can blur two lists."""
    return F.flatten(F.transform(row("columns"), lambda c: F.array(
        F.upper(c["name"]), _as_text(c["is_descending"]), _as_text(c["is_included"]))))


def _key_own(row: Row) -> Column:
    return F.array(_as_text(row("type_code")), _as_text(render.is_clustered(row("index_type_desc"))))


def key_facets(row: Row) -> Column:
    return F.concat(_key_own(row), _column_facets(row))


def check_facets(row: Row) -> Column:
    return F.array(normalize_text(row("definition")), _as_text(row("is_not_trusted")))


def fk_facets(row: Row) -> Column:
    """Referenced table, actions (exact), replication flag, ordered pairs; trust and disabled do not count."""
    return F.concat(
        F.array(F.upper(row("referenced_schema")), F.upper(row("referenced_table")), _as_text(row("delete_action")),
                _as_text(row("update_action")), _as_text(row("is_not_for_replication"))),
        F.transform(_fk_pairs(row), lambda p: F.upper(p)))


def _index_own(row: Row) -> Column:
    return F.array(_as_text(row("is_unique")), F.upper(row("type_desc")), normalize_text(row("filter_definition")))


def index_facets(row: Row) -> Column:
    return F.concat(_index_own(row), _column_facets(row))


def _names(part: str) -> Callable[[Row], Column]:
    return lambda row: F.transform(row("columns"), lambda c: F.upper(c[part]))


def _nothing(_: Row) -> Column:
    return F.array().cast("array<string>")


#: Relation: (rank, match key, facets, columns it touches, fields, how it is written).
KINDS: dict[str, tuple] = {
    "keys": (1, key_match_key, key_facets, _names("name"), KEY_FIELDS, render.key_add),
    "checks": (2, check_match_key, check_facets, _nothing, CHECK_FIELDS, render.check_add),
    "foreign_keys": (3, fk_match_key, fk_facets, _names("parent_column"), FK_FIELDS, render.fk_add),
    "indexes": (4, index_match_key, index_facets, _names("name"), INDEX_FIELDS, render.index_create),
}
INDEX_RANK = KINDS["indexes"][0]


#: What is read of an index column: its numbers only say the order of the list.
_INDEX_COLUMN = ("name", "is_descending", "is_included")


def _carried(relation: str) -> Column:
    """An item's own fields without its ordinal, which travels beside them."""
    columns = F.col("columns")
    if relation in ("keys", "indexes"):
        columns = F.transform("columns", lambda c: F.struct(*[c[f].alias(f) for f in _INDEX_COLUMN]))
    return F.struct(*[columns.alias(f) if f == "columns" else F.col(f) for f in KINDS[relation][4] if f != "ordinal"])


def items(relation: str, rows: DataFrame, text: bool = True) -> DataFrame:
    """One constraint relation in the generic shape, of which no statement can be written.

    With `text` an item's own fields travel instead, each once, in a column of its kind; what follows from them is told behind
    the exchange (`_unfolded`).
    """
    rank, match_key, facets, touches, *_ = KINDS[relation]
    own = [_carried(relation).alias(relation)] if text else [
        match_key(_row).alias("match_key"), F.struct("name", facets(_row).alias("facets"), touches(_row).alias("touches")).alias("row")]
    return rows.select(
        "pair_id", table_key(F.col("schema_name"), F.col("table_name")).alias("obj_key"), F.lit(rank).alias("kind_rank"), "ordinal", *own)


def constraint_items(side: dict[str, DataFrame], text: bool = True) -> DataFrame:
    """Every constraint and index of one side as `items` has them; absent relations are skipped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [items(name, side[name], text) for name in KINDS if name in side])


def _unfolded(carried: DataFrame) -> DataFrame:
    """Items with their own fields in the generic shape: the fields of its kind are part of an item, the other kinds' are null."""
    kinds = [name for name in KINDS if name in carried.columns]

    def told(part: int) -> Column:
        return reduce(lambda c, k: c.when(F.col("kind_rank") == KINDS[k][0], KINDS[k][part](fields(k))), kinds, F)

    name = F.coalesce(*[F.col(f"{k}.name") for k in kinds])
    row = F.struct(name.alias("name"), told(2).alias("facets"), told(3).alias("touches"), *kinds)
    return carried.withColumns({"match_key": told(1), "row": row}).drop(*kinds)


def counted_items(side: dict[str, DataFrame]) -> DataFrame:
    """The same for `count_items`: of an item's facets two 64-bit hashes travel, and nothing else but its key."""
    facets = F.col("row.facets")
    hashes = F.array(*[F.xxhash64(F.lit(seed), F.size(facets), F.array_join(facets, "\0", "\1")) for seed in (0, 1)])
    return constraint_items(side, False).withColumn("row", F.struct(F.when(facets.isNotNull(), hashes).alias("facets")))


def _joined(values: Column) -> Column:
    return F.array_join(values, "\0", "\1")


def facets_hash(relation: str, row: Row = _row) -> Column:
    """A hash that is equal for equal facets, null where they are. Lists of index columns are joined field by field:
    a lambda for each column of each item would be interpreted, and costs more than all else here."""
    own = {"keys": _key_own, "indexes": _index_own}.get(relation)
    if own is None:
        facets = KINDS[relation][2](row)
        return F.when(facets.isNotNull(), F.xxhash64(F.size(facets), _joined(facets)))
    columns = row("columns")
    flags = [F.array_join(columns[f].cast("array<string>"), ",", "") for f in ("is_descending", "is_included")]
    return F.when(columns.isNotNull(), F.xxhash64(F.size(columns), _joined(own(row)), F.upper(_joined(columns["name"])), *flags))


def compared_items(side: dict[str, DataFrame]) -> DataFrame:
    """Items as `columns.compared_columns` has columns: pair_id, obj_key, key, ordinal, row."""
    def of(relation: str) -> DataFrame:
        rank, match_key, *_ = KINDS[relation]
        return side[relation].select(
            "pair_id", table_key(F.col("schema_name"), F.col("table_name")).alias("obj_key"), F.xxhash64(F.lit(rank), match_key(_row)).alias("key"),
            "ordinal", F.struct(facets_hash(relation).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("known"), F.lit(0).alias("value")).alias("row"))

    return union_all([of(name) for name in KINDS if name in side])


def match_constraints(src: DataFrame, tgt: DataFrame, tables: DataFrame) -> DataFrame:
    """Generic items of comparable tables matched by kind and match key."""
    rows = tag_sides(src, tgt).join(tables, ["pair_id", "obj_key"])
    return match_sides(rows if "row" in rows.columns else _unfolded(rows), ["pair_id", "obj_key", "kind_rank", "match_key"])


def _kept() -> Column:
    label = F.element_at(F.array(*[F.lit(text) for text in KIND_LABELS.values()]), F.col("kind_rank"))
    return messages.item_kept(label, F.col("name"))


def _dropped() -> Column:
    return F.col("drop_text")


def _added() -> Column:
    return F.col("add_text")


STEPS = [
    Step("outcome = 'target_only' and not include_drops", PHASE_WARNING, 4, "warn_item_kept", _kept),
    Step("outcome = 'changed' or (outcome = 'target_only' and include_drops)", PHASE_PRE, 0, "drop_item", _dropped),
    Step("moved", PHASE_PRE, 0, "take_down", _dropped),
    Step("outcome in ('added', 'changed')", PHASE_POST, 0, "add_item", _added),
    Step("moved and outcome = 'same'", PHASE_POST, 0, "restore", _added),
    Step("moved and outcome = 'target_only'", PHASE_POST, 0, "restore", _added),
]
#: Numbers of the steps that drop, that add, and that add what the source has.
_DROPS, _ADDS, _OF_SOURCE = (1, 2), (3, 4, 5), (3, 4)


def _written(steps: DataFrame) -> DataFrame:
    """Expanded steps with the one statement each needs: what stayed as it was is never rendered."""
    chosen = steps.withColumn("item", F.when(F.col("step").isin(*_OF_SOURCE), F.col("s")).otherwise(F.col("t")))
    name, kinds = F.col("item.name"), [k for k in KINDS if k in steps.schema["s"].dataType.names]
    drop = F.when(F.col("kind_rank") == INDEX_RANK, render.around(render.index_drop(name), F.col("table_ident"))).otherwise(
        render.around(render.constraint_drop(name), F.col("table_ident")))
    add = reduce(lambda c, k: c.when(F.col("kind_rank") == KINDS[k][0], render.around(KINDS[k][-1](fields(f"item.{k}")), F.col("table_ident"))), kinds, F)
    return chosen.withColumns({"drop_text": F.when(F.col("step").isin(*_DROPS), drop), "add_text": F.when(F.col("step").isin(*_ADDS), add)})


def diff_constraints(matched: DataFrame) -> DataFrame:
    """Differing items and items that must step aside for a rewritten column, with their steps.

    `matched` carries `rewritten_cols` of its table (`columns.table_summary`). An unchanged
    item over a rewritten column is taken down and put back without counting as a change; a
    target-only one is put back the way the target had it.
    """
    s, t = fields("s"), fields("t")
    outcome = ("case when t is null then 'added' when s is null then 'target_only' "
               "when s.facets = t.facets then 'same' else 'changed' end")
    flagged = matched.withColumns({
        "outcome": F.expr(outcome),
        "in_the_way": F.coalesce(F.arrays_overlap(t("touches"), F.col("rewritten_cols")), F.lit(False)),
    }).withColumn(
        "moved", F.expr("in_the_way and (outcome = 'same' or (outcome = 'target_only' and not include_drops))")
    ).where("outcome <> 'same' or moved")
    return flagged.select(
        "pair_id", "obj_key", "kind_rank", "match_key", "table_ident", "outcome", "moved", "s", "t",
        (1 - F.col("is_source")).alias("side"), "ordinal", F.coalesce(s("name"), t("name")).alias("name"),
        F.expr("case when outcome = 'same' or (outcome = 'target_only' and not include_drops) then 0 else 1 end")
        .alias("changes"),
        F.expr("case when outcome = 'target_only' and not include_drops then 1 else 0 end").alias("warnings"),
        step_numbers(STEPS).alias("steps"),
    )


def constraint_steps(diffed: DataFrame) -> DataFrame:
    """One row per constraint or index step or warning."""
    return expand_steps(diffed, STEPS, _written)


def count_items(matched: DataFrame) -> DataFrame:
    """Changes and warnings of matched items, one row per differing item: pair_id, obj_key, changes, warnings."""
    kept = "t is not null and s is null and not include_drops"
    return matched.where("s is null or t is null or s.facets <> t.facets").select(
        "pair_id", "obj_key", F.expr(f"if({kept}, 0, 1)").alias("changes"), F.expr(f"if({kept}, 1, 0)").alias("warnings"))
