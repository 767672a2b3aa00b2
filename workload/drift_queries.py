"""Object, column and constraint comparison (survey groups D to G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.compare import FleetDiff
from fleetshape.functions import render, text
from fleetshape.operators import columns as C
from fleetshape.operators import constraints as K
from fleetshape.operators import digests, matching
from fleetshape.operators import objects as O
from fleetshape.plans import script
from workload import fleet
from workload import oracle_sql as Q
from workload.registry import query

COLUMNS_ONLY = ("objects", "columns")
OBJECTS_ONLY = ("objects",)

STEP_FIELDS = ["pair_id", "obj_key", "name", "action", "stmt"]


def _long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- scalar expressions


@query("q_normalize_text", Q.oracle(f"select doc_id, md5({Q.norm("replace(text, 'ß', 'SS')")}) as digest from documents"))
def q_normalize_text(spark, sf):
    docs = fleet.cte(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@query("q_quote", """
select doc_id, md5('[' || replace(source || ']' || text, ']', ']]') || ']') as quoted, md5(replace(text || '''', '''', '''''')) as escaped
from documents""")
def q_quote(spark, sf):
    docs = fleet.cte(spark, sf, "documents")
    return docs.select(
        "doc_id", F.md5(text.quote(F.concat("source", F.lit("]"), "text"))).alias("quoted"),
        F.md5(text.literal(F.concat("text", F.lit("'")))).alias("escaped"))


def _flat_columns(spark, sf, alias_types: bool = False) -> DataFrame:
    return fleet.columns(spark, sf, "src", alias_types) if alias_types else fleet.relation(spark, sf, "src", "columns")


@query("q_render_type", Q.oracle(
    f"select type_sql, cast(count(*) as bigint) as n from (select {Q.type_sql()} as type_sql from src_columns join src_tables using (pair_id, object_id)) x group by 1"))
def q_render_type(spark, sf):
    rows = _flat_columns(spark, sf).select(render.column_type(render.fields()).alias("type_sql"))
    return rows.groupBy("type_sql").agg(F.count("*").alias("n"))


@query("q_render_column", Q.oracle("select pair_id, table_name, name, coldef from o_src_coldefs", Q._columns("src")))
def q_render_column(spark, sf):
    return _flat_columns(spark, sf).select(
        "pair_id", "table_name", "name", render.column_definition(render.fields()).alias("coldef"))


def _rendered(spark, sf, relation: str, add, drop) -> DataFrame:
    ident = text.quote2(F.col("schema_name"), F.col("table_name"))
    return fleet.relation(spark, sf, "tgt", relation).select(
        "pair_id", "table_name", "name", render.around(add(render.fields()), ident).alias("add_stmt"),
        render.around(drop(F.col("name")), ident).alias("drop_stmt"))


def _rendered_sql(kind: str, build) -> str:
    return Q.oracle(f"""select pair_id, table_name, name, add_head || '[' || schema_name || '].[' || table_name || ']' || add_tail as add_stmt,
      drop_head || '[' || schema_name || '].[' || table_name || ']' || drop_tail as drop_stmt from o_tgt_{kind}_items""", build("tgt"))


@query("q_render_keys", _rendered_sql("key", Q.key_items))
def q_render_keys(spark, sf):
    return _rendered(spark, sf, "keys", render.key_add, render.constraint_drop)


@query("q_render_checks", _rendered_sql("check", Q.check_items))
def q_render_checks(spark, sf):
    return _rendered(spark, sf, "checks", render.check_add, render.constraint_drop)


@query("q_render_fks", _rendered_sql("fk", Q.fk_items))
def q_render_fks(spark, sf):
    return _rendered(spark, sf, "foreign_keys", render.fk_add, render.constraint_drop)


@query("q_render_indexes", _rendered_sql("index", Q.index_items))
def q_render_indexes(spark, sf):
    return _rendered(spark, sf, "indexes", render.index_create, render.index_drop)


# ---- objects


@query("q_match_objects", Q.oracle(
    "select pair_id, obj_key, obj_type, in_src, in_tgt, coalesce(text_differs, false) as text_differs from o_match", Q.OBJECT_MATCH))
def q_match_objects(spark, sf):
    d = fleet.fleet_diff(spark, sf, OBJECTS_ONLY)
    return d.matched.select(
        "pair_id", "obj_key", "obj_type", F.col("s").isNotNull().alias("in_src"), F.col("t").isNotNull().alias("in_tgt"),
        F.coalesce(F.col("s.digest") != F.col("t.digest"), F.lit(False)).alias("text_differs"))


@query("q_objects_added", Q.oracle("select pair_id, obj_key, obj_type, s_ident as identifier from o_match where not in_tgt", Q.OBJECT_MATCH))
def q_objects_added(spark, sf):
    return O.objects_added(fleet.fleet_diff(spark, sf, OBJECTS_ONLY).matched)


@query("q_tables_changed", Q.oracle(
    "select pair_id, obj_key, changes, warnings from o_table_counts where changes > 0 or warnings > 0",
    f"{Q.ALL_STEPS},{Q.TABLE_COUNTS}"))
def q_tables_changed(spark, sf):
    return fleet.fleet_diff(spark, sf).table_counts.where("changes > 0 or warnings > 0")


@query("q_modules_changed", Q.oracle(
    "select pair_id, obj_key, obj_type, s_ident as identifier from o_match where in_src and in_tgt and obj_type <> 'Table' and text_differs",
    Q.OBJECT_MATCH))
def q_modules_changed(spark, sf):
    return O.text_changes(fleet.fleet_diff(spark, sf, OBJECTS_ONLY).matched).where("obj_type <> 'Table'")


@query("q_drift_add_only", Q.oracle(
    """select p.pair_id, cast(count(a.pair_id) filter (where a.outcome = 'changed') as bigint) as changed,
         cast(count(a.pair_id) filter (where a.skipped) + case when p.include_drops then 1 else 0 end as bigint) as skipped
       from pairs p left join o_act a on a.pair_id = p.pair_id where p.add_only group by p.pair_id, p.include_drops""", Q.DRIFT))
def q_drift_add_only(spark, sf):
    d = fleet.fleet_diff(spark, sf)
    asked = FleetDiff(d.pairs.where("add_only"), d.src, d.tgt)
    return O.drift(asked.pairs, asked.actions).select("pair_id", "changed", "skipped")


@query("q_legacy_skip", Q.oracle(
    """select pair_id, obj_key, '-- warning table_skipped ' || identifier as warning
       from o_act where action = 'skip_no_model'""", Q.DRIFT))
def q_legacy_skip(spark, sf):
    return script.legacy_skips(fleet.fleet_diff(spark, sf).actions)


@query("q_objects_removed", Q.oracle(
    "select pair_id, obj_key, identifier, action, skipped from o_act where action in ('drop', 'keep_table')",
    Q.DRIFT))
def q_objects_removed(spark, sf):
    d = fleet.fleet_diff(spark, sf, OBJECTS_ONLY)
    return O.target_only(d.matched, d.pairs).drop("outcome")


_DRIFT_COUNTS = """
  cast(count(a.pair_id) filter (where a.outcome = 'added') as bigint) as added,
  cast(count(a.pair_id) filter (where a.outcome = 'changed') as bigint) as changed,
  cast(count(a.pair_id) filter (where a.outcome = 'removed') as bigint) as removed,
  cast(count(a.pair_id) filter (where a.skipped) + case when p.include_drops and p.add_only then 1 else 0 end as bigint) as skipped,
  count(a.pair_id) filter (where a.outcome in ('added', 'changed', 'removed')) > 0 as drifted"""


@query("q_drift_summary", Q.oracle(
    f"select p.pair_id, {_DRIFT_COUNTS} from pairs p left join o_act a on a.pair_id = p.pair_id group by p.pair_id, p.include_drops, p.add_only",
    Q.DRIFT))
def q_drift_summary(spark, sf):
    return fleet.fleet_diff(spark, sf).drift


@query("q_drift_mode", Q.oracle(
    """select p.pair_id, cast(count(a.pair_id) filter (where a.action = 'drop') as bigint) as removed from pairs p left join (
         select pair_id, case when in_src then 'x' else 'drop' end as action from o_match) a on a.pair_id = p.pair_id group by 1""",
    Q.OBJECT_MATCH))
def q_drift_mode(spark, sf):
    """Drift defaults: with no option set, every target-only object is reported as removed."""
    bare = fleet.pairs(spark, sf).select("pair_id")
    pairs = O.with_mode_defaults(bare, "drift")
    matched = fleet.fleet_diff(spark, sf, OBJECTS_ONLY).matched
    return O.drift(pairs, O.target_only(matched, pairs)).select("pair_id", "removed")


@query("q_drift_lists", Q.oracle(
    """select pair_id, outcome, identifier, row_number() over (partition by pair_id, outcome order by
         case when outcome = 'removed' then case obj_type when 'View' then 0 when 'StoredProcedure' then 1 when 'Function' then 2 else 3 end
           else case obj_type when 'Table' then 0 when 'Function' then 1 when 'View' then 2 else 3 end end, obj_key) - 1 as list_no
       from o_act where outcome <> 'kept'""", Q.DRIFT))
def q_drift_lists(spark, sf):
    return script.drift_lists(fleet.fleet_diff(spark, sf).actions)


@query("q_drift_pruned", Q.oracle(
    f"select p.pair_id, {_DRIFT_COUNTS} from pairs p left join o_act a on a.pair_id = p.pair_id and p.pair_id % 3 = 0 group by p.pair_id, p.include_drops, p.add_only",
    Q.DRIFT))
def q_drift_pruned(spark, sf):
    """Two of three targets are what their source says; digests leave only the third to be compared, and of that its unequal tables."""
    src, tgt = ({n: df.withColumnRenamed("pair_id", "snapshot_id") for n, df in fleet.side(spark, sf, s).items()} for s in ("src", "tgt"))
    mixed = {n: tgt[n].where("snapshot_id % 3 = 0").unionByName(src[n].where("snapshot_id % 3 <> 0")) for n in src}
    pairs = fleet.pairs(spark, sf).withColumns({"source_snapshot_id": F.col("pair_id"), "target_snapshot_id": F.col("pair_id")})
    return digests.pruned_diff(pairs, digests.build_tree(src), digests.build_tree(mixed)).drift


# Every fiftieth table is present a second time under an upper-case name, on the source side.
_DUPLICATED = """
o_dup as (
  select pair_id, upper('Table:' || schema_name || '.' || table_name) as obj_key from src_tables where object_id % 50 = 0)"""


def _with_duplicates(spark, sf) -> FleetDiff:
    d = fleet.fleet_diff(spark, sf)
    objects = d.src["objects"]
    again = objects.where("obj_type = 'Table' and cast(substring(obj_name, 5) as bigint) % 50 = 0").withColumn("obj_name", F.upper("obj_name"))
    return FleetDiff(d.pairs, {**d.src, "objects": objects.unionByName(again)}, d.tgt)


@query("q_duplicate_keys", Q.oracle("select pair_id, 'source' as side, obj_key, 2::bigint as copies from o_dup", _DUPLICATED))
def q_duplicate_keys(spark, sf):
    return _with_duplicates(spark, sf).rejects


@query("q_accepted_pairs", Q.oracle(
    f"""select p.pair_id, {_DRIFT_COUNTS} from pairs p left join o_act a on a.pair_id = p.pair_id
        where p.pair_id not in (select pair_id from o_dup) group by p.pair_id, p.include_drops, p.add_only""", f"{Q.DRIFT},{_DUPLICATED}"))
def q_accepted_pairs(spark, sf):
    """A pair with a repeated key is refused whole; the others are compared as ever."""
    return _with_duplicates(spark, sf).drift


# ---- columns


@query("q_match_columns", Q.oracle(
    """select obj_key, pair_id, col_key, true as in_src, true as in_tgt from o_both
       union all select obj_key, pair_id, col_key, true, false from o_new
       union all select obj_key, pair_id, col_key, false, true from o_only""", Q.COLUMN_MATCH))
def q_match_columns(spark, sf):
    return fleet.fleet_diff(spark, sf, COLUMNS_ONLY).columns.select(
        "pair_id", "obj_key", "col_key", F.col("s").isNotNull().alias("in_src"), F.col("t").isNotNull().alias("in_tgt"))


@query("q_columns_changed", Q.oracle(
    "select pair_id, obj_key, col_key, (recompute or alters) as rewritten from o_diff", Q.COLUMN_MATCH))
def q_columns_changed(spark, sf):
    diff = fleet.fleet_diff(spark, sf, COLUMNS_ONLY).column_diff
    return diff.where("outcome = 'changed'").select("pair_id", "obj_key", "col_key", "rewritten")


@query("q_rewritten_columns", Q.oracle("select pair_id, obj_key, col_key from o_rewritten", Q.COLUMN_MATCH))
def q_rewritten_columns(spark, sf):
    return C.rewritten_columns(fleet.fleet_diff(spark, sf, COLUMNS_ONLY).column_diff)


COLUMN_ACTIONS = {
    "q_columns_added": ("add_column",),
    "q_warn_add_notnull": ("warn_add_not_null",),
    "q_warn_identity": ("warn_identity",),
    "q_computed_changes": ("drop_computed", "add_computed"),
    "q_alter_columns": ("alter_column",),
    "q_warn_becomes_notnull": ("warn_not_null",),
    "q_warn_narrowing": ("warn_narrowing",),
    "q_columns_target_only": ("warn_column_kept", "warn_column_dropped", "drop_column"),
    "q_uncorrectable_columns": ("none",),
}


def _column_action(name: str, actions: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{a}'" for a in actions)
    sql = Q.oracle(f"select pair_id, obj_key, name, action, stmt from o_col_steps where action in ({listed})",
                   f"{Q.COLUMN_MATCH},{Q.COLUMN_STEPS}")

    @query(name, sql)
    def run(spark, sf):
        diff = fleet.fleet_diff(spark, sf, COLUMNS_ONLY).column_diff
        return C.column_steps(diff).where(F.col("action").isin(*actions)).select(*STEP_FIELDS)


for _name, _actions in COLUMN_ACTIONS.items():
    _column_action(_name, _actions)


@query("q_default_changes", Q.oracle(
    "select pair_id, obj_key, name, action, stmt from o_col_steps where phase = 2 and action in ('drop_default', 'add_default')",
    f"{Q.COLUMN_MATCH},{Q.COLUMN_STEPS}"))
def q_default_changes(spark, sf):
    diff = fleet.fleet_diff(spark, sf, COLUMNS_ONLY).column_diff
    return C.column_steps(diff).where("phase = 2 and action in ('drop_default', 'add_default')").select(*STEP_FIELDS)


# ---- constraints and indexes


def _match_keys(name: str, relation: str, kind: str, build) -> None:
    sql = Q.oracle(f"select pair_id, upper('Table:' || schema_name || '.' || table_name) as obj_key, match_key, name from o_src_{kind}_items",
                   build("src"))

    @query(name, sql)
    def run(spark, sf):
        return K.items(relation, fleet.relation(spark, sf, "src", relation), text=False).select(
            "pair_id", "obj_key", "match_key", F.col("row.name").alias("name"))


_match_keys("q_match_keys", "keys", "key", Q.key_items)
_match_keys("q_match_checks", "checks", "check", Q.check_items)
_match_keys("q_match_fks", "foreign_keys", "fk", Q.fk_items)
_match_keys("q_match_indexes", "indexes", "index", Q.index_items)


@query("q_last_wins", Q.oracle(
    """select pair_id, obj_key, match_key, name from (
         select pair_id, upper('Table:' || schema_name || '.' || table_name) as obj_key, contains(facets, '(0))') as match_key, name, ordinal
         from o_src_check_items) x
       qualify row_number() over (partition by pair_id, obj_key, match_key order by ordinal desc) = 1""",
    Q.check_items("src")))
def q_last_wins(spark, sf):
    """Checks of a table grouped by whether they compare against zero: the last of each group is the one found."""
    items = K.items("checks", fleet.relation(spark, sf, "src", "checks"), text=False)
    grouped = items.withColumn("match_key", F.col("row.facets")[0].contains("(0))"))
    return matching.last_wins(grouped, ["pair_id", "obj_key", "match_key"]).select(
        "pair_id", "obj_key", "match_key", F.col("row.name").alias("name"))


_ITEM_ORACLE = f"{Q.COLUMN_MATCH},{Q.ITEM_MATCH}"


@query("q_constraint_actions", Q.oracle(
    "select pair_id, obj_key, cast(kind_rank as bigint) as kind_rank, name, action, stmt from o_item_steps", _ITEM_ORACLE))
def q_constraint_actions(spark, sf):
    steps = K.constraint_steps(fleet.fleet_diff(spark, sf).constraint_diff)
    return steps.select(*STEP_FIELDS, *_long("kind_rank"))


def _kind_changes(name: str, rank: int, relation: str) -> None:
    sql = Q.oracle(f"select pair_id, obj_key, match_key, name, outcome from o_item_diff where kind_rank = {rank} and outcome <> 'same'",
                   _ITEM_ORACLE)

    @query(name, sql)
    def run(spark, sf):
        diff = fleet.fleet_diff(spark, sf, ("objects", relation)).item_changes
        return diff.select("pair_id", "obj_key", "match_key", "name", "outcome")


for _relation, _kind in {"keys": "key", "checks": "check", "foreign_keys": "fk", "indexes": "index"}.items():
    _kind_changes(f"q_{_kind}_changes", K.KINDS[_relation][0], _relation)


@query("q_dependants_restored", Q.oracle(
    "select pair_id, obj_key, name, action, stmt from o_item_steps where action in ('take_down', 'restore')", _ITEM_ORACLE))
def q_dependants_restored(spark, sf):
    steps = K.constraint_steps(fleet.fleet_diff(spark, sf).constraint_diff)
    return steps.where("action in ('take_down', 'restore')").select(*STEP_FIELDS)
