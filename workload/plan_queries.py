"""Filters, ordering, scripts and snapshot documents (survey groups A, C, H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.compare import FleetDiff
from fleetshape.functions.modules import to_create_or_alter
from fleetshape.model import table_key
from fleetshape.operators import assemble as A
from fleetshape.operators import corpus, filters
from fleetshape.operators import objects as O
from fleetshape.plans import levels, prerequisites, script
from fleetshape.plans.ordering import stored
from fleetshape.plans.tables import create_table_rows
from fleetshape.session import scratch_path
from fleetshape.sources import snapshots
from workload import catalog_queries as CQ
from workload import fleet
from workload import oracle_sql as Q
from workload.registry import query

# ---- filters

INCLUDE = "Sales.*, view:, TBL_1?, proc:mod_2*"
EXCLUDE = "app.*, func:, dbo.Tbl_*5"


@query("q_filter_include", Q.oracle("""
  select pair_id, obj_key from o_src_obj where lower(schema_name) = 'sales' or obj_type = 'View'
    or regexp_matches(upper(obj_name), '^TBL_1.$') or (obj_type = 'StoredProcedure' and starts_with(upper(obj_name), 'MOD_2'))""", Q.OBJECTS))
def q_filter_include(spark, sf):
    return O.keyed(filters.filter_objects(fleet.relation(spark, sf, "src", "objects"), include=INCLUDE))


_EXCLUDED = """(lower(schema_name) = 'app' or obj_type = 'Function' or (lower(schema_name) = 'dbo' and starts_with(upper(obj_name), 'TBL_')
    and ends_with(obj_name, '5')))"""


@query("q_filter_exclude", Q.oracle(f"select pair_id, obj_key from o_src_obj where not {_EXCLUDED}", Q.OBJECTS))
def q_filter_exclude(spark, sf):
    return O.keyed(filters.filter_objects(fleet.relation(spark, sf, "src", "objects"), exclude=EXCLUDE))


@query("q_filter_both_sides", Q.oracle(f"""
  select t.pair_id, t.obj_key, t.identifier, case when t.obj_type = 'Table' and not p.include_table_drops then 'keep_table' else 'drop' end as action
  from o_tgt_obj t join pairs p on p.pair_id = t.pair_id
  where p.include_drops and not p.add_only and not {_EXCLUDED.replace('schema_name', 't.schema_name').replace('obj_', 't.obj_')}
    and not exists (select 1 from o_src_obj s where s.pair_id = t.pair_id and s.obj_key = t.obj_key)""", Q.OBJECTS))
def q_filter_both_sides(spark, sf):
    """Drops of a filtered comparison: nothing the filter hides is dropped."""
    src = filters.filter_side(fleet.side(spark, sf, "src", ("objects",)), exclude=EXCLUDE)
    tgt = filters.filter_side(fleet.side(spark, sf, "tgt", ("objects",)), exclude=EXCLUDE)
    matched = O.match_objects(src["objects"], tgt["objects"])
    return O.target_only(matched, fleet.pairs(spark, sf)).select("pair_id", "obj_key", "identifier", "action")


@query("q_filter_notice", Q.oracle(f"select pair_id, 'include={INCLUDE}, exclude={EXCLUDE}' as filter_notice from pairs"))
def q_filter_notice(spark, sf):
    return filters.filter_notice(fleet.pairs(spark, sf).select("pair_id"), INCLUDE, EXCLUDE)


#: What the patterns of q_filter_per_pair leave, pair by pair.
_PAIR_KEPT = r"""(case pair_id % 4 when 0 then lower(schema_name) = 'sales' or obj_type = 'View'
      when 1 then starts_with(upper(obj_name), 'TBL_' || pair_id) or regexp_matches(obj_name, '_1.$')
      when 2 then ends_with(obj_name, '9') or obj_type = 'StoredProcedure' else true end)
    and not (case pair_id % 3 when 0 then lower(schema_name) = 'app' or obj_type = 'Function' or lower(schema_name) = 'dbo' and obj_name ilike 'tbl\_%5' escape '\'
      when 1 then obj_type = 'StoredProcedure' and starts_with(upper(obj_name), 'MOD_' || pair_id % 10) or ends_with(obj_name, '7') else false end)"""


@query("q_filter_per_pair", Q.oracle(f"select pair_id, obj_key from o_src_obj where pair_id in (select pair_id from pairs) and {_PAIR_KEPT}", Q.OBJECTS))
def q_filter_per_pair(spark, sf):
    """Every pair with patterns of its own; pairs without any keep all."""
    texts = fleet.cte(spark, sf, "pairs").selectExpr(
        "pair_id", """case pair_id % 4 when 0 then 'Sales.*, view:' when 1 then 'tbl_' || pair_id || '*,*_1?' when 2 then '*9, proc: , :x' end as include""",
        """case pair_id % 3 when 0 then 'app.*, func:, dbo.Tbl_*5' when 1 then 'procedures : mod_' || pair_id % 10 || '*,*7' end as exclude""")
    objects = fleet.relation(spark, sf, "src", "objects").join(fleet.cte(spark, sf, "pairs").select("pair_id"), "pair_id", "left_semi")
    return O.keyed(filters.filter_per_pair(objects, filters.pattern_rows(texts)))


# ---- dependency order

_GRAPH = """
o_e as (select distinct pair_id, object_id as n, referenced_object_id as d from fk_edges where object_id <> referenced_object_id),
o_reach as (select pair_id, n, d from o_e union select r.pair_id, r.n, e.d from o_reach r join o_e e on e.pair_id = r.pair_id and e.n = r.d),
o_cycle as (select distinct pair_id, n from o_reach where n = d),
o_blocked as (select pair_id, n from o_cycle union select r.pair_id, r.n from o_reach r join o_cycle c on c.pair_id = r.pair_id and c.n = r.d),
o_live as (select e.* from o_e e where not exists (select 1 from o_blocked b where b.pair_id = e.pair_id and b.n = e.n)),
o_levels as (
  select t.pair_id, t.object_id as n, 0 as l from tables_base t where not exists (select 1 from o_blocked b where b.pair_id = t.pair_id and b.n = t.object_id)
  union select e.pair_id, e.n, v.l + 1 from o_levels v join o_live e on e.pair_id = v.pair_id and e.d = v.n)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All tables as pending creates, and the foreign-key edges between them."""
    tables = fleet.cte(spark, sf, "tables_base").select(
        "pair_id", "object_id", table_key(F.col("schema_name"), F.col("table_name")).alias("obj_key"))
    edges = (
        fleet.cte(spark, sf, "fk_edges").join(tables, ["pair_id", "object_id"])
        .join(tables.select("pair_id", F.col("object_id").alias("referenced_object_id"), F.col("obj_key").alias("dep_key")),
              ["pair_id", "referenced_object_id"])
        .select("pair_id", "obj_key", "dep_key")
    )
    return tables.select("pair_id", "obj_key"), edges


_KEY = "upper('Table:' || t.schema_name || '.' || t.table_name) as obj_key"


@query("q_create_levels", _recursive(Q.oracle(
    f"""select t.pair_id, {_KEY}, cast(max(v.l) as bigint) as level from o_levels v
        join tables_base t on t.pair_id = v.pair_id and t.object_id = v.n group by all""", _GRAPH)))
def q_create_levels(spark, sf):
    levelled = levels.create_levels(*_graph(spark, sf))
    return levelled.where("level is not null").withColumn("level", F.col("level").cast("bigint"))


@query("q_dependency_cycles", _recursive(Q.oracle(
    f"select t.pair_id, {_KEY} from o_blocked b join tables_base t on t.pair_id = b.pair_id and t.object_id = b.n", _GRAPH)))
def q_dependency_cycles(spark, sf):
    return levels.cycle_remainder(levels.create_levels(*_graph(spark, sf))).select("pair_id", "obj_key")


@query("q_cycle_members", _recursive(Q.oracle(
    f"""select b.pair_id, {_KEY}, (
          select min(upper('Table:' || m.schema_name || '.' || m.table_name)) from o_reach r join o_reach q on q.pair_id = r.pair_id and q.n = r.d and q.d = r.n
          join tables_base m on m.pair_id = r.pair_id and m.object_id = r.d where r.pair_id = b.pair_id and r.n = b.n) as cycle
        from o_blocked b join tables_base t on t.pair_id = b.pair_id and t.object_id = b.n""", _GRAPH)))
def q_cycle_members(spark, sf):
    """The cycles themselves, told from what only stands behind one."""
    nodes, edges = _graph(spark, sf)
    return levels.cycle_members(levels.create_levels(nodes, edges), edges)


# ---- plan

_STMT_ORDER = "phase, kind_rank, side, ordinal, sub"


@query("q_plan_phases", Q.oracle(
    f"""select pair_id, obj_key, row_number() over (partition by pair_id, obj_key order by {_STMT_ORDER}) - 1 as line_no, stmt
        from o_steps where stmt is not null""", Q.ALL_STEPS))
def q_plan_phases(spark, sf):
    return script.table_lines(fleet.fleet_diff(spark, sf).steps).select("pair_id", "obj_key", "line_no", "stmt")


_DROP_STMT = """'IF OBJECT_ID(N''' || identifier || ''') IS NOT NULL' || chr(10) || '    DROP ' ||
  case obj_type when 'Table' then 'TABLE' when 'View' then 'VIEW' when 'StoredProcedure' then 'PROCEDURE' else 'FUNCTION' end || ' ' || identifier || ';'"""
_CREATE_RANK = "case obj_type when 'Table' then 0 when 'Function' then 1 when 'View' then 2 else 3 end"
_DROP_RANK = "case obj_type when 'View' then 0 when 'StoredProcedure' then 1 when 'Function' then 2 else 3 end"

_DROPS = f"""
o_drops as (
  select pair_id, 2 as section, 0 as level, case when action = 'rebuild' then 0 else 10 + {_DROP_RANK} end as type_rank, obj_key,
    case when action = 'rebuild' then 'rebuild_drop' else action end as action,
    case when action = 'keep_table' then '-- warning table_kept ' || identifier
      else {_DROP_STMT} end as stmt
  from o_act where action in ('rebuild', 'drop', 'keep_table'))"""


@query("q_drop_plan", Q.oracle("select pair_id, cast(type_rank as bigint) as type_rank, obj_key, action, stmt from o_drops", f"{Q.DRIFT},{_DROPS}"))
def q_drop_plan(spark, sf):
    actions = stored(fleet.fleet_diff(spark, sf).actions, "actions")
    return script.drop_rows(actions).select("pair_id", F.col("type_rank").cast("bigint").alias("type_rank"), "obj_key", "action", "stmt")


@query("q_module_plan", Q.oracle(
    """select a.pair_id, a.obj_key, a.identifier, md5('CREATE OR ALTER' || substr(s.definition, 7)) as digest
       from o_act a join o_src_obj s on s.pair_id = a.pair_id and s.obj_key = a.obj_key where a.action = 'recreate'""", Q.DRIFT))
def q_module_plan(spark, sf):
    d = fleet.fleet_diff(spark, sf)
    return script.module_updates(d.actions, d.src["objects"]).select("pair_id", "obj_key", "identifier", F.md5("stmt").alias("digest"))


def _create_sql(side: str) -> str:
    kinds = " union all ".join(
        f"select pair_id, object_id, {rank} as kind, ordinal, add_head || '[' || schema_name || '].[' || table_name || ']' || add_tail || chr(10) || 'GO' "
        f"|| chr(10) || chr(10) as block from o_{side}_{kind}_items"
        for kind, rank in (("key", 1), ("fk", 2), ("check", 3), ("index", 4)))
    return f"""
o_{side}_blocks as (select pair_id, object_id, string_agg(block, '' order by kind, ordinal) as blocks from ({kinds}) b group by 1, 2),
o_{side}_create as (
  select c.pair_id, c.object_id, c.schema_name, c.table_name, regexp_replace('CREATE TABLE [' || c.schema_name || '].[' || c.table_name || ']' || chr(10) || '('
    || chr(10) || '    ' || c.cols || chr(10) || ');' || chr(10) || 'GO' || chr(10) || chr(10) || coalesce(b.blocks, ''), '\\s+$', '') as definition
  from (select pair_id, object_id, schema_name, table_name, string_agg(coldef, ',' || chr(10) || '    ' order by ordinal) as cols
        from o_{side}_coldefs group by all) c left join o_{side}_blocks b on b.pair_id = c.pair_id and b.object_id = c.object_id)"""


def _create_ctes(side: str) -> str:
    return ",".join([Q._columns(side), Q.key_items(side), Q.check_items(side), Q.fk_items(side), Q.index_items(side), _create_sql(side)])


@query("q_render_tables", Q.oracle("select pair_id, schema_name, table_name, md5(definition) as digest from o_src_create", _create_ctes("src")))
def q_render_tables(spark, sf):
    rows = create_table_rows(fleet.side(spark, sf, "src"))
    return rows.select("pair_id", "schema_name", "table_name", F.md5("definition").alias("digest"))


@query("q_rebuild_plan", Q.oracle(f"""
  select s.pair_id, upper('Table:' || s.schema_name || '.' || s.table_name) as obj_key,
    'IF OBJECT_ID(N''[' || s.schema_name || '].[' || s.table_name || ']'') IS NOT NULL' || chr(10) || '    DROP TABLE [' || s.schema_name || '].[' || s.table_name || '];' as drop_stmt,
    md5(s.definition) as create_digest
  from o_src_create s join o_tgt_create t on t.pair_id = s.pair_id and t.object_id = s.object_id join pairs p on p.pair_id = s.pair_id
  where p.allow_rebuild and not p.add_only and {Q.norm('s.definition')} <> {Q.norm('t.definition')}""", f"{_create_ctes('src')},{_create_ctes('tgt')}"))
def q_rebuild_plan(spark, sf):
    """Rebuild mode compares the rendered text, so even column order is a difference."""
    pairs = fleet.pairs(spark, sf).where("allow_rebuild")

    def rendered(side_name: str) -> dict[str, DataFrame]:
        side = {n: df.join(pairs.select("pair_id"), "pair_id", "left_semi") for n, df in fleet.side(spark, sf, side_name).items()}
        objects = create_table_rows(side).select(
            "pair_id", F.lit("Table").alias("obj_type"), "schema_name", F.col("table_name").alias("obj_name"), "definition",
            F.lit(True).alias("has_model"))
        return {"objects": objects, "columns": side["columns"]}

    diff = FleetDiff(pairs, rendered("src"), rendered("tgt"))
    actions = stored(diff.actions.where("action = 'rebuild'"), "rebuilds")
    drops = script.drop_rows(actions).select("pair_id", "obj_key", F.col("stmt").alias("drop_stmt"))
    creates = script.create_statements(actions, diff.src["objects"]).select("pair_id", "obj_key", F.md5("stmt").alias("create_digest"))
    return drops.join(creates, ["pair_id", "obj_key"])


# ---- prerequisites

_EMITTED = """
o_emitted as (select * from o_act where action in ('create', 'recreate', 'rebuild', 'alter')),
o_type_rows as (
  select c_custkey as pair_id, s.schema_name, s.name from customer
    cross join (values ('dbo', 'PhoneNumber'), ('app', 'PhoneNumber'), ('dbo', 'Unused')) s(schema_name, name)),
o_alias_cols as (
  select c.pair_id, upper('Table:' || t.schema_name || '.' || t.table_name) as obj_key, case when c.object_id % 2 = 0 then 'dbo' else 'app' end as type_schema
  from src_columns c join src_tables t on t.pair_id = c.pair_id and t.object_id = c.object_id where c.type_name = 'varchar' and c.max_length = 60),
o_types as (
  select y.pair_id, y.schema_name, y.name, 'IF TYPE_ID(N''' || y.schema_name || '.' || y.name || ''') IS NULL' || chr(10) || '    CREATE TYPE ['
    || y.schema_name || '].[' || y.name || '] FROM varchar(25) NOT NULL;' as stmt
  from o_type_rows y where y.name = 'PhoneNumber' and exists (
    select 1 from o_alias_cols c join o_emitted e on e.pair_id = c.pair_id and e.obj_key = c.obj_key where c.pair_id = y.pair_id and c.type_schema = y.schema_name)),
o_schemas as (
  select pair_id, min(schema_name) as schema_name, 'IF SCHEMA_ID(N''' || min(schema_name) || ''') IS NULL' || chr(10) || '    EXEC(N''CREATE SCHEMA ['
    || min(schema_name) || ']'');' as stmt
  from (select pair_id, schema_name from o_emitted union all select pair_id, schema_name from o_types) x
  where upper(schema_name) <> 'DBO' group by pair_id, upper(schema_name))"""


def alias_types(spark, sf) -> DataFrame:
    """Three alias types per pair, one of them unused."""
    names = F.array(*[F.struct(F.lit(s).alias("schema_name"), F.lit(n).alias("name"))
                      for s, n in (("dbo", "PhoneNumber"), ("app", "PhoneNumber"), ("dbo", "Unused"))])
    return fleet.pairs(spark, sf).select("pair_id", F.inline(names)).withColumns({
        "base_type_name": F.lit("varchar"), "max_length": F.lit(25), "precision": F.lit(0), "scale": F.lit(0),
        "is_nullable": F.lit(False), "collation_name": F.lit(None).cast("string")})


def _emitted_and_types(spark, sf) -> tuple[DataFrame, DataFrame]:
    emitted = stored(prerequisites.emitted(fleet.fleet_diff(spark, sf).actions), "emitted")
    return emitted, prerequisites.prereq_types(emitted, fleet.columns(spark, sf, "src", True), alias_types(spark, sf))


@query("q_prereq_types", Q.oracle("select * from o_types", f"{Q.DRIFT},{_EMITTED}"))
def q_prereq_types(spark, sf):
    return _emitted_and_types(spark, sf)[1].select("pair_id", "schema_name", "name", "stmt")


@query("q_prereq_schemas", Q.oracle("select * from o_schemas", f"{Q.DRIFT},{_EMITTED}"))
def q_prereq_schemas(spark, sf):
    return prerequisites.prereq_schemas(*_emitted_and_types(spark, sf)).select("pair_id", "schema_name", "stmt")


# ---- scripts

_DEPS = """
o_dep as (
  select distinct f.pair_id, upper('Table:' || t.schema_name || '.' || t.table_name) as obj_key, upper('Table:' || r.schema_name || '.' || r.table_name) as dep_key
  from src_fks f join src_tables t on t.pair_id = f.pair_id and t.object_id = f.object_id
    join src_tables r on r.pair_id = f.pair_id and r.object_id = f.referenced_object_id where f.object_id <> f.referenced_object_id),
o_pending as (select * from o_act where action in ('create', 'recreate', 'rebuild')),
o_e as (
  select d.pair_id, d.obj_key as n, d.dep_key as d from o_dep d join o_pending a on a.pair_id = d.pair_id and a.obj_key = d.obj_key
    join o_pending b on b.pair_id = d.pair_id and b.obj_key = d.dep_key),
o_reach as (select pair_id, n, d from o_e union select r.pair_id, r.n, e.d from o_reach r join o_e e on e.pair_id = r.pair_id and e.n = r.d),
o_cycle as (select distinct pair_id, n from o_reach where n = d),
o_blocked as (select pair_id, n from o_cycle union select r.pair_id, r.n from o_reach r join o_cycle c on c.pair_id = r.pair_id and c.n = r.d),
o_live as (select e.* from o_e e where not exists (select 1 from o_blocked b where b.pair_id = e.pair_id and b.n = e.n)),
o_lv as (
  select pair_id, obj_key as n, 0 as l from o_pending p where not exists (select 1 from o_blocked b where b.pair_id = p.pair_id and b.n = p.obj_key)
  union select e.pair_id, e.n, v.l + 1 from o_lv v join o_live e on e.pair_id = v.pair_id and e.d = v.n),
o_level as (select pair_id, n, max(l) as l from o_lv group by 1, 2)"""

_PLAN = f"""
o_plan as (
  select pair_id, 1 as section, 0 as level, 0 as type_rank, upper(schema_name) as obj_key, 0 as phase, 0 as kind_rank, 0 as side, 0 as ordinal, 0 as sub,
    stmt || chr(10) || 'GO' as line from o_schemas
  union all select pair_id, 1, 0, 1, upper(schema_name || '.' || name), 0, 0, 0, 0, 0, stmt || chr(10) || 'GO' from o_types
  union all select pair_id, section, level, type_rank, obj_key, 0, 0, 0, 0, 0, stmt || chr(10) || 'GO' from o_drops
  union all select pair_id, 3, 0, 0, obj_key, 0, 0, 0, 0, 0, '-- warning table_skipped ' || identifier || chr(10) || 'GO'
    from o_act where action = 'skip_no_model'
  union all select pair_id, 3, 1, 0, '', 0, 0, 0, 0, 0, '-- info add_only_keeps_all' || chr(10) || 'GO'
    from pairs where include_drops and add_only
  union all select p.pair_id, 4, coalesce(v.l, 1000000000), {_CREATE_RANK.replace('obj_type', 'p.obj_type')}, p.obj_key, 0, 0, 0, 0, 0,
    case when p.action = 'recreate' then 'CREATE OR ALTER' || substr(regexp_replace(s.definition, '\\s+$', ''), 7) else regexp_replace(s.definition, '\\s+$', '') end
      || chr(10) || 'GO'
    from o_pending p join o_src_obj s on s.pair_id = p.pair_id and s.obj_key = p.obj_key left join o_level v on v.pair_id = p.pair_id and v.n = p.obj_key
  union all select distinct pair_id, 4, 999999999, 0, '', 0, 0, 0, 0, 0,
    '-- warning dependency_cycle' || chr(10) || 'GO' from o_blocked
  union all select pair_id, 5, 0, 0, obj_key, -2, 0, 0, 0, 0, '-- ALTER [' || schema_name || '].[' || obj_name || ']' from o_act where action = 'alter'
  union all select s.pair_id, 5, 0, 0, s.obj_key, s.phase, s.kind_rank, s.side, s.ordinal, s.sub, case when s.phase >= 0 then s.stmt || chr(10) || 'GO' else s.stmt end
    from o_steps s join o_act a on a.pair_id = s.pair_id and a.obj_key = s.obj_key and a.action = 'alter' where s.stmt is not null
  union all select a.pair_id, 5, 0, 0, a.obj_key, 9, 0, 0, 0, 0, 'GO' from o_act a where a.action = 'alter' and not exists (
    select 1 from o_steps s where s.pair_id = a.pair_id and s.obj_key = a.obj_key and s.phase >= 0 and s.stmt is not null)),
o_lines as (
  select * from o_plan
  union all select distinct pair_id, least(section, 3), -1, 0, '', 0, 0, 0, 0, 0,
    case least(section, 3) when 1 then '-- 1 needed first' when 2 then '-- 2 removals' else '-- 3 changes' end || chr(10) || 'GO' from o_plan
  union all select pair_id, 0, 0, 0, '', 0, 0, 0, 0, 0, '-- Source: [src_' || pair_id || ']' || chr(10) || '-- Target: [tgt_' || pair_id || ']' || chr(10) || chr(10)
    || 'SET ANSI_NULLS ON;' || chr(13) || chr(10) || 'SET QUOTED_IDENTIFIER ON;' || chr(10) || 'GO' from pairs)"""


@query("q_diff_script", _recursive(Q.oracle("""
  select pair_id, row_number() over (partition by pair_id order by section, level, type_rank, obj_key, phase, kind_rank, side, ordinal, sub) - 1 as line_no,
    line from o_lines""", f"{Q.DRIFT},{_EMITTED},{_DROPS},{_DEPS},{_PLAN}")))
def q_diff_script(spark, sf):
    d = fleet.fleet_diff(spark, sf)
    src = {**d.src, "alias_types": alias_types(spark, sf)}
    diff = FleetDiff(d.pairs, src, d.tgt)
    plan = script.migration_plan(diff, A.table_deps(src["foreign_keys"], "pair_id"), fleet.columns(spark, sf, "src", True))
    return script.diff_scripts(stored(plan, "plan"), diff.accepted)


@query("q_full_script", Q.oracle(f"""
  select pair_id, row_number() over (partition by pair_id order by section, r, k1, k2) - 1 as line_no, line from (
    select pair_id, 0 as section, 0 as r, '' as k1, '' as k2, '-- Snapshot database: [src_' || pair_id || ']' || chr(10) || chr(10) || 'SET ANSI_NULLS ON;' || chr(13)
      || chr(10) || 'SET QUOTED_IDENTIFIER ON;' || chr(10) || 'GO' as line from pairs
    union all select distinct pair_id, 1, 0, '', '', '-- 1 needed first' || chr(10) || 'GO' from o_script_schemas
    union all select pair_id, 2, 0, upper(schema_name), '', 'IF SCHEMA_ID(N''' || schema_name || ''') IS NULL' || chr(10) || '    EXEC(N''CREATE SCHEMA [' || schema_name || ']'');'
      || chr(10) || 'GO' from o_script_schemas
    union all select pair_id, 3, {_CREATE_RANK}, upper(schema_name), upper(obj_name), '-- ' || obj_type || ' [' || schema_name || '].[' || obj_name || ']' || chr(10) || 'GO'
      || chr(10) || case when regexp_matches(definition, '(^|\\n)GO$') then definition else regexp_replace(definition, '\\s+$', '') || chr(10) || 'GO' end || chr(10)
      from o_script_objects) x
  where pair_id in (select pair_id from pairs)""", f"""{_create_ctes('src')},
o_script_objects as (
  select t.pair_id, 'Table' as obj_type, t.schema_name, t.table_name as obj_name, coalesce(c.definition, '') as definition
  from src_tables t left join o_src_create c on c.pair_id = t.pair_id and c.object_id = t.object_id
  union all select pair_id, obj_type, schema_name, obj_name, definition from src_modules),
o_script_schemas as (select distinct pair_id, schema_name from o_script_objects where upper(schema_name) <> 'DBO')"""))
def q_full_script(spark, sf):
    side = fleet.side(spark, sf, "src")
    bare = side["objects"].withColumn("definition", F.when(F.col("obj_type") != "Table", F.col("definition")))
    objects = A.with_definitions({**side, "objects": bare}, "pair_id")["objects"]
    pairs = fleet.pairs(spark, sf).select("pair_id", F.col("source_name").alias("database_name"))
    no_types = alias_types(spark, sf).where("false").withColumn("stmt", F.lit(""))
    schemas = prerequisites.prereq_schemas(objects.join(pairs, "pair_id", "left_semi"), no_types)
    return script.full_scripts(pairs, objects.join(pairs, "pair_id", "left_semi"), schemas, no_types, "pair_id")


# ---- script corpora

# One script per document, its whole text in two string literals and a quoted name: behind a header
# whose nested comment holds a GO line, and before and behind GO lines inside literal and name.
_SCRIPTS = """
o_parts as (
  select doc_id, case when doc_id % 9 = 0 then '/* a /* b' || chr(10) || 'GO' || chr(10) || '*/ c */ ' else '' end || 'SELECT ''' || quoted || '''' as first_batch,
    'INSERT INTO t VALUES (''' || quoted || chr(10) || 'GO' || chr(10) || 'it''''s'')' as second_batch,
    'SELECT [x' || chr(10) || 'GO' || chr(10) || ']]y' || replace(body, ']', ']]') || ']' as third_batch
  from (select doc_id, body, replace(body, '''', '''''') as quoted from (
    select doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) as body from documents) x) y)"""


def scripts(spark, sf) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    quoted = F.replace(body, F.lit("'"), F.lit("''"))
    header = F.when(F.col("doc_id") % 9 == 0, "/* a /* b\nGO\n*/ c */ ").otherwise("")
    go = F.when(F.col("doc_id") % 10 == 0, "\nGO 2 -- twice\n").otherwise("\n  go  \r\n")
    return fleet.cte(spark, sf, "documents").select(
        F.col("doc_id").alias("script_id"),
        F.concat(header, F.lit("SELECT '"), quoted, F.lit("'"), go, F.lit("INSERT INTO t VALUES ('"), quoted, F.lit("\nGO\nit''s')"),
                 F.lit("\nGO;\nGO\n\nGO\n"), F.lit("SELECT [x\nGO\n]]y"), F.replace(body, F.lit("]"), F.lit("]]")), F.lit("]")).alias("text"))


@query("q_batches", Q.oracle("""
  select doc_id as script_id, cast(batch_no as bigint) as batch_no, md5(trim(body)) as digest from (
    select doc_id, 1 as batch_no, first_batch as body from o_parts
    union all select doc_id, 2, first_batch from o_parts where doc_id % 10 = 0
    union all select doc_id, case when doc_id % 10 = 0 then 3 else 2 end, second_batch || chr(10) || 'GO;' from o_parts
    union all select doc_id, case when doc_id % 10 = 0 then 4 else 3 end, third_batch from o_parts) x""", _SCRIPTS))
def q_batches(spark, sf):
    return corpus.split_batches(scripts(spark, sf)).select("script_id", "batch_no", F.md5("text").alias("digest"))


@query("q_batch_counts", "select doc_id as script_id, cast(case when doc_id % 10 = 0 then 4 else 3 end as bigint) as batches from documents")
def q_batch_counts(spark, sf):
    return corpus.batch_counts(scripts(spark, sf))


@query("q_create_or_alter", """
  select doc_id, md5(case doc_id % 5 when 0 then 'CREATE OR ALTER VIEW v AS ' || body
      when 1 then '/* ' || block || ' */' || chr(10) || '-- ' || line || chr(10) || '  create OR ALTER  PROCEDURE p AS ' || body
      when 2 then 'CREATE /* x */ OR ALTER VIEW v AS ' || body when 3 then 'ALTER PROCEDURE p AS ' || body else 'CREATED ' || body end) as digest
  from (select doc_id, coalesce(text, '') as body, replace(replace(coalesce(text, ''), '*/', '* /'), '/*', '/ *') as block,
    replace(replace(coalesce(text, ''), chr(10), ' CREATE '), chr(13), ' ') as line from documents) x""")
def q_create_or_alter(spark, sf):
    """For every fifth document its text stands in a block and in a line comment ahead of CREATE."""
    body = F.coalesce("text", F.lit(""))
    block = F.replace(F.replace(body, F.lit("*/"), F.lit("* /")), F.lit("/*"), F.lit("/ *"))
    line = F.replace(F.replace(body, F.lit("\n"), F.lit(" CREATE ")), F.lit("\r"), F.lit(" "))
    kind = F.col("doc_id") % 5
    definition = (
        F.when(kind == 0, F.concat(F.lit("CREATE VIEW v AS "), body))
        .when(kind == 1, F.concat(F.lit("/* "), block, F.lit(" */\n-- "), line, F.lit("\n  create  PROCEDURE p AS "), body))
        .when(kind == 2, F.concat(F.lit("CREATE /* x */ OR ALTER VIEW v AS "), body))
        .when(kind == 3, F.concat(F.lit("ALTER PROCEDURE p AS "), body))
        .otherwise(F.concat(F.lit("CREATED "), body))
    )
    return fleet.cte(spark, sf, "documents").select("doc_id", F.md5(to_create_or_alter(definition)).alias("digest"))


# ---- documents


@query("q_snapshot_roundtrip", Q.oracle("""
  select p.snapshot_id, cast((select count(*) from o_tables t where t.snapshot_id = p.snapshot_id and t.temporal_type <> 1)
      + (select count(*) from o_modules m where m.snapshot_id = p.snapshot_id) as bigint) as n_objects,
    cast((select count(*) from o_columns c join o_tables t on t.snapshot_id = c.snapshot_id and t.object_id = c.object_id
      where c.snapshot_id = p.snapshot_id and t.temporal_type <> 1) as bigint) as n_columns,
    cast((select count(*) from sys_check_constraints c join o_tables t on t.snapshot_id = c.snapshot_id and t.object_id = c.parent_object_id
      where c.snapshot_id = p.snapshot_id and t.temporal_type <> 1) as bigint) as n_checks,
    cast((select count(*) from sys_key_constraints c join o_tables t on t.snapshot_id = c.snapshot_id and t.object_id = c.parent_object_id
      where c.snapshot_id = p.snapshot_id and t.temporal_type <> 1) as bigint) as n_keys
  from (select snapshot_id from o_tables where temporal_type <> 1 union select snapshot_id from o_modules) p""",
    f"{CQ._TABLES},{CQ._COLUMNS},{CQ._MODULES}"))
def q_snapshot_roundtrip(spark, sf):
    """Catalog to documents on disk and back, counted per snapshot."""
    back = _there_and_back(spark, sf)

    def counted(relation: str, name: str) -> DataFrame:
        return back[relation].groupBy("snapshot_id").agg(F.count("*").alias(name))

    out = back["snapshots"].select("snapshot_id")
    for relation, name in (("objects", "n_objects"), ("columns", "n_columns"), ("checks", "n_checks"), ("keys", "n_keys")):
        out = out.join(counted(relation, name), "snapshot_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


@query("q_roundtrip_columns", Q.oracle("""
  select c.* exclude (object_id, ordinal), t.schema_name, t.table_name, cast(row_number() over (partition by c.snapshot_id, c.object_id order by c.ordinal) as bigint) as ordinal
  from o_columns c join o_tables t on t.snapshot_id = c.snapshot_id and t.object_id = c.object_id where t.temporal_type <> 1""", f"{CQ._TABLES},{CQ._COLUMNS}"))
def q_roundtrip_columns(spark, sf):
    """Every field of every column after the round trip."""
    rows = _there_and_back(spark, sf)["columns"]
    return rows.withColumns({n: F.col(n).cast("bigint") for n in ("ordinal", "max_length", "precision", "scale")})


@query("q_roundtrip_foreign_keys", Q.oracle("""
  select k.snapshot_id, t.schema_name, t.table_name, k.name, rs.name as referenced_schema, rt.name as referenced_table,
    k.delete_referential_action_desc as delete_action, k.update_referential_action_desc as update_action, k.is_not_for_replication, k.is_system_named,
    k.is_not_trusted, k.is_disabled, coalesce(string_agg(pc.name || '>' || rc.name, ',' order by f.constraint_column_id), '') as columns
  from sys_foreign_keys k join o_tables t on t.snapshot_id = k.snapshot_id and t.object_id = k.parent_object_id and t.temporal_type <> 1
    join sys_tables rt on rt.snapshot_id = k.snapshot_id and rt.object_id = k.referenced_object_id
    join sys_schemas rs on rs.snapshot_id = k.snapshot_id and rs.schema_id = rt.schema_id
    left join sys_foreign_key_columns f on f.snapshot_id = k.snapshot_id and f.constraint_object_id = k.object_id
    left join sys_columns pc on pc.snapshot_id = f.snapshot_id and pc.object_id = f.parent_object_id and pc.column_id = f.parent_column_id
    left join sys_columns rc on rc.snapshot_id = f.snapshot_id and rc.object_id = f.referenced_object_id and rc.column_id = f.referenced_column_id
  group by all""", CQ._TABLES))
def q_roundtrip_foreign_keys(spark, sf):
    rows = _there_and_back(spark, sf)["foreign_keys"]
    pairs = F.array_join(F.transform("columns", lambda c: F.concat(c["parent_column"], F.lit(">"), c["referenced_column"])), ",")
    return rows.withColumn("columns", pairs).drop("ordinal")


def _there_and_back(spark, sf) -> dict[str, DataFrame]:
    """The assembled catalog written as documents and read again."""
    with A.by_database(CQ.catalog(spark, sf)) as cat:
        relations = A.assemble(cat)
        ids = relations["objects"].select("snapshot_id").distinct()
        relations["snapshots"] = ids.withColumns({
            "database_name": F.concat(F.lit("db_"), "snapshot_id"), "generated_at": F.lit(None).cast("timestamp")})
        relations["schemas"] = prerequisites.used_schemas(relations["objects"], relations["alias_types"], "snapshot_id")
        path = scratch_path(spark, "documents")
        snapshots.write_snapshots(relations, path)
    return snapshots.read_snapshots(spark, path, multi_line=False)
