"""Column-level comparison of matched tables.

`tables` is the relation of comparable tables (see `objects.comparable_tables`):
`pair_id, obj_key, table_ident, include_drops`. Every step keeps the partitioning by
`(pair_id, obj_key)`: one exchange of the column rows serves matching, classification,
the per-table counts and the set of rewritten columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetshape.functions import messages, render
from fleetshape.functions.render import Row, column_type, fields
from fleetshape.functions.text import is_blank, normalize_text, same_ci
from fleetshape.model import COLUMN_FIELDS, table_key
from fleetshape.operators.matching import match_sides, tag_sides

# Phases inside one table. Warnings come first in its block.
PHASE_WARNING, PHASE_PRE, PHASE_ADD, PHASE_ALTER, PHASE_DROP, PHASE_POST = -1, 0, 1, 2, 3, 4

STEP_COLUMNS = ["pair_id", "obj_key", "kind_rank", "side", "ordinal", "name"]

_s, _t = fields("s"), fields("t")


def _keyed(columns: DataFrame) -> DataFrame:
    return columns.select(
        "pair_id", table_key(F.col("schema_name"), F.col("table_name")).alias("obj_key"), F.struct(*COLUMN_FIELDS).alias("row"))


def match_columns(src: DataFrame, tgt: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of comparable tables matched by name, position ignored. Fields travel once: key and ordinal are told from them behind the exchange."""
    rows = tag_sides(_keyed(src), _keyed(tgt)).join(tables, ["pair_id", "obj_key"])
    told = rows.withColumns({"col_key": F.upper("row.name"), "ordinal": F.col("row.ordinal")})
    return match_sides(told, ["pair_id", "obj_key", "col_key"])


# The comparison is staged: derived text once per side, then flags, then - for differing
# columns only - statements. Each stage is a projection Catalyst keeps apart, so no type or
# definition is spelled out more than once in generated code.

_COMPARED = {
    "d_type": "upper(s_type) <> upper(t_type)",
    "d_collation": "not (upper(s.collation_name) <=> upper(t.collation_name))",
    "d_null": "s.is_nullable <> t.is_nullable",
    "d_identity": "s.is_identity <> t.is_identity or not (upper(s.identity_seed) <=> upper(t.identity_seed)) "
                  "or not (upper(s.identity_increment) <=> upper(t.identity_increment))",
    "d_computed": "s.is_computed <> t.is_computed or s_computed <> t_computed or s.is_persisted <> t.is_persisted",
    "d_row_guid": "s.is_row_guid <> t.is_row_guid",
    "d_default": "s_default <> t_default",
}


def compare_facets(matched: DataFrame) -> DataFrame:
    """`outcome` of every matched column, with one flag per group of the eleven facets."""
    derived = matched.withColumns({
        "s_type": column_type(_s), "t_type": column_type(_t),
        "s_default": normalize_text(_s("default_definition")), "t_default": normalize_text(_t("default_definition")),
        "s_computed": normalize_text(_s("computed_definition")), "t_computed": normalize_text(_t("computed_definition")),
    })
    differs = " or ".join(_COMPARED)
    outcome = f"case when t is null then 'added' when s is null then 'target_only' when {differs} then 'changed' else 'same' end"
    return derived.withColumns({name: F.expr(text) for name, text in _COMPARED.items()}).withColumn(
        "outcome", F.expr(outcome))


_FLAGS = ("is_nullable", "is_identity", "is_computed", "is_persisted", "is_row_guid")


def compared_columns(columns: DataFrame) -> DataFrame:
    """What `compare_facets` looks at, of each column, small enough to travel: pair_id, obj_key, key, ordinal, row (see `matching.touched`)."""
    r = fields()
    kind = F.upper(column_type(r))
    # Two unknown values are equal to each other and unlike any other: a null does not enter a hash, so that it is null does.
    alike = [x for f in ("collation_name", "identity_seed", "identity_increment") for x in (r(f).isNull(), F.upper(r(f)))]
    texts = [normalize_text(r("computed_definition")), normalize_text(r("default_definition"))]
    known, value = (sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(bits)), F.lit(0)) for bits in (
        [r(f).isNotNull() for f in _FLAGS], [r(f) for f in _FLAGS]))
    return columns.select(
        "pair_id", table_key(F.col("schema_name"), F.col("table_name")).alias("obj_key"),
        F.xxhash64(F.lit(0), F.upper("name")).alias("key"), "ordinal", F.struct(
            F.when(kind.isNotNull(), F.xxhash64(kind)).alias("a"), F.xxhash64(*alike, *texts).alias("b"),
            known.alias("known"), value.alias("value")).alias("row"))


def is_narrowing(s: Row, t: Row) -> Column:
    """Same base type with a smaller length, precision or scale; -1 is the widest length."""
    shorter = (s("max_length") != -1) & ((t("max_length") == -1) | (s("max_length") < t("max_length")))
    return (
        ~s("is_user_defined") & ~t("is_user_defined") & same_ci(s("type_name"), t("type_name"))
        & (shorter | (s("precision") < t("precision")) | (s("scale") < t("scale")))
    )


def needs_backfill(row: Row) -> Column:
    """An added NOT NULL column nothing would fill."""
    return (
        ~row("is_nullable") & is_blank(row("default_definition")) & ~row("is_identity") & ~row("is_computed")
    )


@dataclass(frozen=True)
class Step:
    """A kind of step: the condition that calls for it, its place in the table's plan, and its text."""

    when: str
    phase: int
    sub: int
    action: str
    text: Callable[[], Column]


def step_numbers(kinds: list[Step]) -> Column:
    """Array of the numbers of the kinds whose condition holds."""
    return F.expr("array_compact(array({}))".format(", ".join(f"case when {k.when} then {i} end" for i, k in enumerate(kinds))))


def expand_steps(diffed: DataFrame, kinds: list[Step], stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per step. Text is written behind the expansion: a filter on `action` leaves only its own to render.

    `stage` adds what the texts of `kinds` refer to.
    """
    step = F.col("step")

    def looked_up(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), step + 1)

    stmt = F.when(step == 0, kinds[0].text())
    for i, kind in enumerate(kinds[1:], 1):
        stmt = stmt.when(step == i, kind.text())
    # The outer form on purpose: for a plain explode Spark infers a filter on the array and pushes it
    # through every stage above, spelling all conditions out once more in one predicate.
    rows = diffed.withColumn("step", F.explode_outer("steps")).where("step is not null")
    return (stage(rows) if stage else rows).select(
        *STEP_COLUMNS, looked_up([k.phase for k in kinds]).alias("phase"), looked_up([k.sub for k in kinds]).alias("sub"),
        looked_up([k.action for k in kinds]).alias("action"), stmt.alias("stmt"))


_WARNINGS = ["w_backfill", "w_identity", "w_not_null", "w_narrows", "only"]

def _table() -> Column:
    return F.col("table_ident")


def _name() -> Column:
    return F.col("name")


def _drop_default() -> Column:
    return render.around(render.constraint_drop(_t("default_name")), _table())


STEPS = [
    Step("w_backfill", PHASE_WARNING, 0, "warn_add_not_null", lambda: messages.add_not_null(_name())),
    Step("added", PHASE_ADD, 0, "add_column", lambda: render.add_column_stmt(_table(), _s)),
    Step("w_identity", PHASE_WARNING, 0, "warn_identity", lambda: messages.identity_differs(_name())),
    Step("recompute and t.is_computed and named_default", PHASE_ALTER, 0, "drop_default", _drop_default),
    Step("recompute", PHASE_ALTER, 1, "drop_computed", lambda: render.drop_column_stmt(_table(), _name())),
    Step("recompute", PHASE_ALTER, 2, "add_computed", lambda: render.add_column_stmt(_table(), _s)),
    Step("alters", PHASE_ALTER, 3, "alter_column", lambda: render.alter_column(_table(), _s, F.col("s_type"))),
    Step("w_not_null", PHASE_WARNING, 1, "warn_not_null", lambda: messages.becomes_not_null(_name())),
    Step("w_narrows", PHASE_WARNING, 2, "warn_narrowing",
         lambda: messages.narrows(_name(), F.col("t_type"), F.col("s_type"))),
    Step("redefault and named_default", PHASE_ALTER, 4, "drop_default", _drop_default),
    Step("redefault and s_default <> ''", PHASE_ALTER, 5, "add_default", lambda: render.add_default_stmt(_table(), _s)),
    Step("only and not include_drops", PHASE_WARNING, 3, "warn_column_kept", lambda: messages.column_kept(_name())),
    Step("only and include_drops and named_default", PHASE_DROP, 0, "drop_default", _drop_default),
    Step("only and include_drops", PHASE_DROP, 1, "drop_column", lambda: render.drop_column_stmt(_table(), _name())),
    Step("only and include_drops", PHASE_WARNING, 3, "warn_column_dropped", lambda: messages.column_dropped(_name())),
    # A difference no statement can express (row-guid or identity alone) still counts as a change.
    Step("changed and not recompute and not alters and not redefault", PHASE_ALTER, 9, "none",
         lambda: F.lit(None).cast("string")),
]


def diff_columns(matched: DataFrame) -> DataFrame:
    """Differing columns, one row each: outcome, change and warning counts, `rewritten`, and the numbers of their steps."""
    flagged = compare_facets(matched).where("outcome <> 'same'").withColumns({
        "name": F.coalesce(_s("name"), _t("name")),
        "added": F.expr("outcome = 'added'"), "only": F.expr("outcome = 'target_only'"),
        "changed": F.expr("outcome = 'changed'"),
        "recompute": F.expr("outcome = 'changed' and (s.is_computed or t.is_computed)"),
        "named_default": ~is_blank(_t("default_name")),
    }).withColumns({
        "alters": F.expr("changed and not recompute and (d_type or d_collation or d_null)"),
        "redefault": F.expr("changed and not recompute and d_default"),
    }).withColumns({
        "w_backfill": F.col("added") & needs_backfill(_s),
        "w_identity": F.expr("changed and d_identity"),
        "w_not_null": F.expr("alters and t.is_nullable and not s.is_nullable"),
        "w_narrows": F.expr("alters and d_type") & is_narrowing(_s, _t),
    })
    warned = " + ".join(f"if({w}, 1, 0)" for w in _WARNINGS)
    return flagged.select(
        "pair_id", "obj_key", "col_key", "table_ident", "outcome", "s", "t", "s_type", "t_type",
        F.lit(0).alias("kind_rank"), (1 - F.col("is_source")).alias("side"), "ordinal", "name",
        F.expr("coalesce(recompute or alters, false)").alias("rewritten"),
        F.expr("case when only and not include_drops then 0 else 1 end").alias("changes"),
        F.expr(warned).alias("warnings"),
        step_numbers(STEPS).alias("steps"),
    )


def column_steps(diffed: DataFrame) -> DataFrame:
    """One row per column step or warning."""
    return expand_steps(diffed, STEPS)


def rewritten_columns(diffed: DataFrame) -> DataFrame:
    """Columns whose storage is rewritten, as (pair, table, column key)."""
    return diffed.where("rewritten").select("pair_id", "obj_key", "col_key").distinct()


def table_summary(tables: DataFrame, diffed: DataFrame) -> DataFrame:
    """Comparable tables with the set of their rewritten columns, null where there is none. A table's column count bounds the set."""
    per_table = diffed.where("rewritten").groupBy("pair_id", "obj_key").agg(F.collect_set("col_key").alias("rewritten_cols"))
    return tables.join(per_table, ["pair_id", "obj_key"], "left")
