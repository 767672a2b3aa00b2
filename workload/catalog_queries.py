"""Catalog assembly (survey group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetshape.functions.modules import object_type
from fleetshape.operators import assemble as A
from fleetshape.operators import digests, filters
from fleetshape.operators import objects as O
from fleetshape.plans.ordering import stored
from fleetshape.plans.prerequisites import used_schemas
from fleetshape.session import scratch_path
from fleetshape.sources.catalog import CATALOG_VIEWS, read_catalog
from workload import fleet
from workload import oracle_sql as Q
from workload.registry import query

_TABLES = """
o_tables as (
  select t.snapshot_id, t.object_id, s.name as schema_name, t.name as table_name, t.temporal_type
  from sys_tables t join sys_schemas s on s.snapshot_id = t.snapshot_id and s.schema_id = t.schema_id where not t.is_ms_shipped)"""


class _Views(dict):
    """Catalog views by name, each dumped when an operator first asks for it."""

    def __init__(self, spark, sf):
        self.load = lambda name: fleet.catalog_view(spark, sf, name)

    def __missing__(self, name):
        self[name] = self.load(name)
        return self[name]


def catalog(spark, sf) -> A.Catalog:
    return _Views(spark, sf)


@query("q_user_tables", Q.oracle("select snapshot_id, object_id, schema_name, table_name from o_tables", _TABLES))
def q_user_tables(spark, sf):
    return A.user_tables(catalog(spark, sf)).select("snapshot_id", "object_id", "schema_name", "table_name")


@query("q_extract_notices", Q.oracle("""
  select snapshot_id, case when temporal_type = 1 then 'skipped [' || schema_name || '].[' || table_name || ']: history_table'
    else '[' || schema_name || '].[' || table_name || ']: versioned_table' end as notice
  from o_tables where temporal_type in (1, 2)
  union all
  select i.snapshot_id, 'skipped index [' || i.name || '] on [' || t.schema_name || '].[' || t.table_name || ']: index_kind ' || i.type_desc
  from sys_indexes i join o_tables t on t.snapshot_id = i.snapshot_id and t.object_id = i.object_id
  where not i.is_hypothetical and i.name is not null and not i.is_primary_key and not i.is_unique_constraint and i.type not in (1, 2)""", _TABLES))
def q_extract_notices(spark, sf):
    return A.extract_notices(catalog(spark, sf))


_COLUMNS = """
o_columns as (
  select c.snapshot_id, c.object_id, cast(c.column_id as bigint) as ordinal, c.name, ts.name as type_schema, ty.name as type_name, ty.is_user_defined,
    cast(c.max_length as bigint) as max_length, cast(c.prec as bigint) as precision, cast(c.scale as bigint) as scale, c.collation_name, c.is_nullable, c.is_identity, c.is_computed, c.is_rowguidcol as is_row_guid,
    cc.definition as computed_definition, coalesce(cc.is_persisted, false) as is_persisted, dc.name as default_name, dc.definition as default_definition,
    coalesce(dc.is_system_named, false) as default_is_system_named, cast(ic.seed_value as varchar) as identity_seed,
    cast(ic.increment_value as varchar) as identity_increment
  from sys_columns c join sys_tables t on t.snapshot_id = c.snapshot_id and t.object_id = c.object_id and not t.is_ms_shipped
    join sys_types ty on ty.snapshot_id = c.snapshot_id and ty.user_type_id = c.user_type_id
    join sys_schemas ts on ts.snapshot_id = c.snapshot_id and ts.schema_id = ty.schema_id
    left join sys_computed_columns cc on cc.snapshot_id = c.snapshot_id and cc.object_id = c.object_id and cc.column_id = c.column_id
    left join sys_default_constraints dc on dc.snapshot_id = c.snapshot_id and dc.object_id = c.default_object_id
    left join sys_identity_columns ic on ic.snapshot_id = c.snapshot_id and ic.object_id = c.object_id and ic.column_id = c.column_id)"""


@query("q_assemble_columns", Q.oracle("select * from o_columns", _COLUMNS))
def q_assemble_columns(spark, sf):
    rows = A.assemble_columns(catalog(spark, sf))
    return rows.withColumns({n: F.col(n).cast("bigint") for n in ("ordinal", "max_length", "precision", "scale")})


_INDEX_COLUMNS = """
o_index_columns as (
  select ic.snapshot_id, ic.object_id, ic.index_id, c.name, ic.is_included_column, ic.is_descending_key, ic.key_ordinal, ic.index_column_id
  from sys_index_columns ic join sys_tables t on t.snapshot_id = ic.snapshot_id and t.object_id = ic.object_id and not t.is_ms_shipped
    join sys_columns c on c.snapshot_id = ic.snapshot_id and c.object_id = ic.object_id and c.column_id = ic.column_id),
o_index_lists as (
  select snapshot_id, object_id, index_id,
    string_agg(name || case when is_included_column then ' inc' when is_descending_key then ' desc' else ' asc' end, ', '
      order by is_included_column, key_ordinal, index_column_id) as columns,
    string_agg(name || case when is_descending_key then ' desc' else ' asc' end, ', ' order by key_ordinal, index_column_id)
      filter (where not is_included_column) as key_columns
  from o_index_columns group by 1, 2, 3)"""


def _listed(c):
    kind = lambda x: F.when(x["is_included"], " inc").when(x["is_descending"], " desc").otherwise(" asc")
    return F.array_join(F.transform(c, lambda x: F.concat(x["name"], kind(x))), ", ")


@query("q_index_columns", Q.oracle("select snapshot_id, object_id, cast(index_id as bigint) as index_id, columns from o_index_lists", _INDEX_COLUMNS))
def q_index_columns(spark, sf):
    return A.index_columns(catalog(spark, sf)).select(
        "snapshot_id", "object_id", F.col("index_id").cast("bigint").alias("index_id"), _listed(F.col("columns")).alias("columns"))


@query("q_key_constraints", Q.oracle("""
  select k.snapshot_id, k.parent_object_id as object_id, k.name, trim(k.type) as type_code, i.type_desc as index_type_desc, k.is_system_named,
    coalesce(l.key_columns, '') as columns
  from sys_key_constraints k join sys_tables t on t.snapshot_id = k.snapshot_id and t.object_id = k.parent_object_id and not t.is_ms_shipped
    join sys_indexes i on i.snapshot_id = k.snapshot_id and i.object_id = k.parent_object_id and i.index_id = k.unique_index_id
    left join o_index_lists l on l.snapshot_id = k.snapshot_id and l.object_id = k.parent_object_id and l.index_id = k.unique_index_id""", _INDEX_COLUMNS))
def q_key_constraints(spark, sf):
    cat = catalog(spark, sf)
    rows = A.assemble_keys(cat, A.index_columns(cat)).withColumn("columns", _listed(F.col("columns")))
    return rows.select("snapshot_id", "object_id", "name", "type_code", "index_type_desc", "is_system_named", "columns")


@query("q_foreign_keys", Q.oracle("""
  select k.snapshot_id, k.parent_object_id as object_id, k.name, rs.name as referenced_schema, rt.name as referenced_table,
    k.delete_referential_action_desc as delete_action, k.update_referential_action_desc as update_action, k.is_not_for_replication, k.is_system_named,
    k.is_not_trusted, k.is_disabled, coalesce(string_agg(pc.name || '>' || rc.name, ',' order by f.constraint_column_id), '') as columns
  from sys_foreign_keys k join sys_tables t on t.snapshot_id = k.snapshot_id and t.object_id = k.parent_object_id and not t.is_ms_shipped
    join sys_tables rt on rt.snapshot_id = k.snapshot_id and rt.object_id = k.referenced_object_id
    join sys_schemas rs on rs.snapshot_id = k.snapshot_id and rs.schema_id = rt.schema_id
    left join sys_foreign_key_columns f on f.snapshot_id = k.snapshot_id and f.constraint_object_id = k.object_id
    left join sys_columns pc on pc.snapshot_id = f.snapshot_id and pc.object_id = f.parent_object_id and pc.column_id = f.parent_column_id
    left join sys_columns rc on rc.snapshot_id = f.snapshot_id and rc.object_id = f.referenced_object_id and rc.column_id = f.referenced_column_id
  group by all"""))
def q_foreign_keys(spark, sf):
    cat = catalog(spark, sf)
    pairs = F.array_join(F.transform("columns", lambda c: F.concat(c["parent_column"], F.lit(">"), c["referenced_column"])), ",")
    return A.assemble_fks(cat, A.fk_columns(cat)).select(
        "snapshot_id", "object_id", "name", "referenced_schema", "referenced_table", "delete_action", "update_action", "is_not_for_replication",
        "is_system_named", "is_not_trusted", "is_disabled", pairs.alias("columns"))


@query("q_check_constraints", Q.oracle("""
  select k.snapshot_id, k.parent_object_id as object_id, k.name, k.definition, k.is_not_trusted, k.is_disabled, k.is_system_named
  from sys_check_constraints k join sys_tables t on t.snapshot_id = k.snapshot_id and t.object_id = k.parent_object_id and not t.is_ms_shipped"""))
def q_check_constraints(spark, sf):
    return A.assemble_checks(catalog(spark, sf)).drop("order_key")


@query("q_select_indexes", Q.oracle("""
  select i.snapshot_id, i.object_id, i.name, i.is_unique, i.type_desc, i.filter_definition, i.is_disabled, coalesce(l.columns, '') as columns
  from sys_indexes i join sys_tables t on t.snapshot_id = i.snapshot_id and t.object_id = i.object_id and not t.is_ms_shipped
    left join o_index_lists l on l.snapshot_id = i.snapshot_id and l.object_id = i.object_id and l.index_id = i.index_id
  where not i.is_hypothetical and i.name is not null and not i.is_primary_key and not i.is_unique_constraint and i.type in (1, 2)""", _INDEX_COLUMNS))
def q_select_indexes(spark, sf):
    cat = catalog(spark, sf)
    return A.select_indexes(cat, A.index_columns(cat)).withColumn("columns", _listed(F.col("columns"))).drop("order_key")


_ALIAS = """
o_alias as (
  select ty.snapshot_id, s.name as schema_name, ty.name, bt.name as base_type_name, cast(ty.max_length as bigint) as max_length, cast(ty.prec as bigint) as precision,
    cast(ty.scale as bigint) as scale, ty.is_nullable, ty.collation_name
  from sys_types ty join sys_schemas s on s.snapshot_id = ty.snapshot_id and s.schema_id = ty.schema_id
    join sys_types bt on bt.snapshot_id = ty.snapshot_id and bt.user_type_id = ty.system_type_id and not bt.is_user_defined
  where ty.is_user_defined and not ty.is_table_type and not ty.is_assembly_type),
o_used as (
  select a.* from o_alias a where exists (select 1 from o_columns c join sys_tables t on t.snapshot_id = c.snapshot_id and t.object_id = c.object_id
    where c.snapshot_id = a.snapshot_id and c.is_user_defined and t.temporal_type <> 1
      and upper(c.type_schema) = upper(a.schema_name) and upper(c.type_name) = upper(a.name)))"""


def _alias_fields(df):
    return df.select("snapshot_id", "schema_name", "name", "base_type_name", "is_nullable", "collation_name",
                     *[F.col(n).cast("bigint").alias(n) for n in ("max_length", "precision", "scale")])


@query("q_alias_types", Q.oracle("select * from o_alias", f"{_COLUMNS},{_ALIAS}"))
def q_alias_types(spark, sf):
    return _alias_fields(A.alias_types(catalog(spark, sf)))


@query("q_used_alias_types", Q.oracle("select * from o_used", f"{_COLUMNS},{_ALIAS}"))
def q_used_alias_types(spark, sf):
    return _alias_fields(A.assemble(catalog(spark, sf))["alias_types"])


_MODULES = """
o_codes as (
  select snapshot_id, object_id, schema_id, name, case trim(type) when 'U' then 'Table' when 'V' then 'View' when 'P' then 'StoredProcedure' else 'Function' end as obj_type
  from sys_objects where not is_ms_shipped),
o_modules as (
  select o.snapshot_id, o.object_id, o.obj_type, s.name as schema_name, o.name as obj_name, m.definition
  from o_codes o join sys_schemas s on s.snapshot_id = o.snapshot_id and s.schema_id = o.schema_id
    join sys_sql_modules m on m.snapshot_id = o.snapshot_id and m.object_id = o.object_id where o.obj_type <> 'Table')"""


@query("q_used_schemas", Q.oracle("""
  select snapshot_id, schema_name from (
    select snapshot_id, schema_name from o_tables where temporal_type <> 1
    union select snapshot_id, schema_name from o_modules union select snapshot_id, schema_name from o_used) x
  where upper(schema_name) <> 'DBO'""", f"{_TABLES},{_COLUMNS},{_ALIAS},{_MODULES}"))
def q_used_schemas(spark, sf):
    relations = A.assemble(catalog(spark, sf))
    return used_schemas(relations["objects"], relations["alias_types"], "snapshot_id").drop("schema_key")


@query("q_modules", Q.oracle("""
  select snapshot_id, object_id, obj_type, schema_name, obj_name, md5(regexp_replace(definition, '^\\s+|\\s+$', '', 'g')) as digest from o_modules""", _MODULES))
def q_modules(spark, sf):
    rows = A.assemble_modules(catalog(spark, sf)).withColumn("digest", F.md5("definition"))
    return rows.drop("definition", "has_model")


@query("q_module_deps", Q.oracle("""
  select distinct d.snapshot_id, upper(a.obj_type || ':dbo.' || a.name) as obj_key, upper(b.obj_type || ':dbo.' || b.name) as dep_key
  from sys_sql_expression_dependencies d join o_codes a on a.snapshot_id = d.snapshot_id and a.object_id = d.referencing_id and a.obj_type <> 'Table'
    join o_codes b on b.snapshot_id = d.snapshot_id and b.object_id = d.referenced_id""", _MODULES))
def q_module_deps(spark, sf):
    return A.module_deps(catalog(spark, sf))


@query("q_table_deps", Q.oracle("""
  select distinct k.snapshot_id, upper('Table:' || t.schema_name || '.' || t.table_name) as obj_key,
    upper('Table:' || rs.name || '.' || rt.name) as dep_key
  from sys_foreign_keys k join o_tables t on t.snapshot_id = k.snapshot_id and t.object_id = k.parent_object_id and t.temporal_type <> 1
    join sys_tables rt on rt.snapshot_id = k.snapshot_id and rt.object_id = k.referenced_object_id
    join sys_schemas rs on rs.snapshot_id = k.snapshot_id and rs.schema_id = rt.schema_id""", _TABLES))
def q_table_deps(spark, sf):
    return A.table_deps(A.assemble(catalog(spark, sf))["foreign_keys"])


@query("q_type_codes", Q.oracle("""
  select type as code, case trim(type) when 'U' then 'Table' when 'V' then 'View' when 'P' then 'StoredProcedure' else 'Function' end as obj_type,
    cast(count(*) as bigint) as n from sys_objects group by 1, 2"""))
def q_type_codes(spark, sf):
    objects = fleet.catalog_view(spark, sf, "sys_objects")
    return objects.groupBy(F.col("type").alias("code"), object_type(F.col("type")).alias("obj_type")).agg(F.count("*").alias("n"))


@query("q_snapshot_summary", Q.oracle("""
  select snapshot_id, cast(count(*) filter (where obj_type = 'Table') as bigint) as tables, cast(count(*) filter (where obj_type = 'View') as bigint) as views,
    cast(count(*) filter (where obj_type = 'StoredProcedure') as bigint) as procs, cast(count(*) filter (where obj_type = 'Function') as bigint) as funcs
  from (select snapshot_id, 'Table' as obj_type from o_tables where temporal_type <> 1 union all select snapshot_id, obj_type from o_modules) x group by 1""",
    f"{_TABLES},{_MODULES}"))
def q_snapshot_summary(spark, sf):
    return A.snapshot_summary(A.assemble_objects(catalog(spark, sf)))


#: What the live databases of q_catalog_drift are numbered from.
LIVE = 10_000_000
HIDDEN = "hr.*"


def _both_catalogs(spark, sf) -> dict:
    """A dump of all views of the golden databases, read back, and with them live ones that lack some tables and have some longer texts."""
    path = scratch_path(spark, "views")
    for name in CATALOG_VIEWS:
        fleet.catalog_view(spark, sf, name).write.parquet(f"{path}/{name}")
    both = {}
    for name, golden in read_catalog(spark, path).items():
        live = golden.withColumn("snapshot_id", F.col("snapshot_id") + LIVE)
        if name == "sys_tables":
            live = live.where("object_id % 17 <> 0")
        if name == "sys_columns":
            longer = (F.col("object_id") % 10 == 1) & (F.col("user_type_id") == 3) & (F.col("max_length") > 0)
            live = live.withColumn("max_length", F.when(longer, F.col("max_length") + 20).otherwise(F.col("max_length")))
        both[name] = golden.unionByName(live)
    return both


@query("q_catalog_drift", Q.oracle(f"""
  select p.pair_id, cast(count(t.object_id) filter (where t.object_id % 17 = 0) as bigint) as added, cast(count(t.object_id) filter (where t.changed) as bigint) as changed,
    0::bigint as removed, 0::bigint as skipped, count(t.object_id) filter (where t.object_id % 17 = 0 or t.changed) > 0 as drifted, 'exclude={HIDDEN}' as filter_notice
  from pairs p left join (
    select o.snapshot_id, o.object_id, o.object_id % 17 <> 0 and (
      exists (select 1 from sys_columns c where c.snapshot_id = o.snapshot_id and c.object_id = o.object_id and o.object_id % 10 = 1 and c.user_type_id = 3 and c.max_length > 0)
      or exists (select 1 from sys_foreign_keys k where k.snapshot_id = o.snapshot_id and k.parent_object_id = o.object_id and k.referenced_object_id % 17 = 0)) as changed
    from o_tables o where o.temporal_type <> 1 and lower(o.schema_name) <> 'hr') t on t.snapshot_id = p.pair_id
  group by p.pair_id""", _TABLES))
def q_catalog_drift(spark, sf):
    """From raw views to the report: read, assemble, hide, hash each database once, compare what is unequal, tell what was hidden."""
    with A.by_database(_both_catalogs(spark, sf)) as cat:
        relations = filters.filter_side(A.assemble(cat), exclude=HIDDEN)
        # The tree writes objects with their digests itself, so their text is written once.
        tree = digests.build_tree({n: df if n == "objects" else stored(df, n) for n, df in relations.items() if n in ("objects", *filters.OF_TABLES)})
    ids = fleet.pairs(spark, sf).select("pair_id")
    pairs = O.with_mode_defaults(ids.withColumns({"source_snapshot_id": F.col("pair_id"), "target_snapshot_id": F.col("pair_id") + LIVE}), "drift")
    return filters.filter_notice(digests.pruned_diff(pairs, tree, tree).drift, exclude=HIDDEN)
