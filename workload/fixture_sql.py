"""Fleet catalog derived from the driver tables, as CTE text.

Every block is valid in both Spark SQL and DuckDB. This text is the only thing a query
and its oracle share; the operator logic is written independently on each side.
Database = customer, table object = order, column = line number.
"""

import re

OBJECTS = """
pairs as (
  select c_custkey as pair_id, c_custkey % 2 = 0 as include_drops, c_custkey % 4 = 0 as include_table_drops,
         c_custkey % 10 = 9 as allow_rebuild, c_custkey % 5 = 3 as add_only
  from customer),
tables_base as (
  select o_custkey as pair_id, o_orderkey as object_id,
         case o_orderkey % 4 when 0 then 'dbo' when 1 then 'Sales' when 2 then 'app' else 'hr' end as schema_name,
         'Tbl_' || cast(o_orderkey as varchar(20)) as table_name,
         o_orderkey % 67 <> 0 as has_model, 'CREATE TABLE T' || cast(o_orderkey as varchar(20)) as definition
  from orders),
src_tables as (select * from tables_base where object_id % 37 <> 0),
tgt_tables as (
  select pair_id, object_id, schema_name,
         case when object_id % 6 = 0 then upper(table_name) else table_name end as table_name, has_model,
         case when object_id % 2 = 0 then definition || ' v2' else definition end as definition
  from tables_base where object_id % 41 <> 0),
src_modules as (
  select doc_id % 50 as pair_id, case doc_id % 3 when 0 then 'View' when 1 then 'StoredProcedure' else 'Function' end as obj_type,
         'dbo' as schema_name, 'mod_' || cast(doc_id as varchar(20)) as obj_name,
         'CREATE X dbo.mod AS ' || text as definition
  from documents where doc_id % 13 <> 0),
tgt_modules as (
  select doc_id % 50 as pair_id, case doc_id % 3 when 0 then 'View' when 1 then 'StoredProcedure' else 'Function' end as obj_type,
         'DBO' as schema_name, 'mod_' || cast(doc_id as varchar(20)) as obj_name,
         case when doc_id % 4 = 0 then 'create  x dbo.mod as ' || replace(text, ' ', '  ')
              when doc_id % 7 = 0 then 'CREATE X dbo.mod AS ' || text || ' changed'
              else 'CREATE X dbo.mod AS ' || text end as definition
  from documents where doc_id % 11 <> 0)
"""

COLUMNS = """
base as (
  select o.o_custkey as pair_id, l.l_orderkey as object_id, l.l_linenumber as column_id,
         min(l.l_partkey) as p, min(l.l_suppkey) as s
  from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by 1, 2, 3),
typed as (
  select *, case p % 6 when 0 then 'int' when 1 then 'bigint' when 2 then 'varchar' when 3 then 'nvarchar'
                       when 4 then 'decimal' else 'datetime2' end as type_name,
         'Col_' || cast(column_id as varchar(10)) as col_name
  from base),
src_columns as (
  select pair_id, object_id, column_id, col_name as name, type_name,
    case when type_name in ('varchar', 'nvarchar') then case when p % 23 = 0 then -1 else 20 * (1 + p % 20) end
         when type_name = 'int' then 4 else 8 end as max_length,
    case when type_name = 'decimal' then 10 + p % 9 else 0 end as prec,
    case when type_name = 'decimal' then p % 5 when type_name = 'datetime2' then p % 8 else 0 end as scale,
    p % 2 = 0 as is_nullable,
    column_id = 1 and type_name = 'int' as is_identity,
    case when column_id = 1 and type_name = 'int' then '1' end as identity_seed,
    p % 47 = 0 as is_row_guid,
    case when p % 31 = 0 then '([Col_1] * ' || cast(p % 5 as varchar(10)) || ')' end as computed_definition,
    case when type_name in ('varchar', 'nvarchar') then 'SQL_Latin1_General_CP1_CI_AS' end as collation_name,
    case when p % 4 = 1 then '((' || cast(p % 3 as varchar(10)) || '))' end as default_definition,
    case when p % 4 = 1 then 'DF_' || cast(object_id as varchar(20)) || '_' || cast(column_id as varchar(10)) end as default_name,
    p % 8 = 1 as default_is_system_named
  from typed where p % 17 <> 0),
tgt_columns as (
  select pair_id, object_id, 8 - column_id as column_id,
    case when s % 3 = 0 then upper(col_name) else col_name end as name,
    case when s % 12 = 0 then 'varchar' else type_name end as type_name,
    case when type_name in ('varchar', 'nvarchar')
         then case when p % 23 = 0 then -1 else 20 * (1 + (p + case when s % 7 = 1 then 3 else 0 end) % 20) end
         when type_name = 'int' then 4 else 8 end as max_length,
    case when type_name = 'decimal' then 10 + (p + case when s % 8 = 1 then 1 else 0 end) % 9 else 0 end as prec,
    case when type_name = 'decimal' then p % 5 when type_name = 'datetime2' then p % 8 else 0 end as scale,
    (p % 2 = 0) <> (s % 11 = 0) as is_nullable,
    column_id = 1 and type_name = 'int' and s % 29 <> 0 as is_identity,
    case when column_id = 1 and type_name = 'int' and s % 29 <> 0 then '1' end as identity_seed,
    (p % 47 = 0) <> (s % 43 = 0) as is_row_guid,
    case when p % 31 = 0 then '([col_1]  *   ' || cast((p + case when s % 10 = 1 then 1 else 0 end) % 5 as varchar(10)) || ')' end as computed_definition,
    case when type_name in ('varchar', 'nvarchar') then case when s % 13 = 0 then 'Latin1_General_BIN'
         else 'sql_latin1_general_cp1_ci_as' end end as collation_name,
    case when p % 4 = 1 then '((' || cast((p + case when s % 9 = 0 then 1 else 0 end) % 3 as varchar(10)) || '))' end as default_definition,
    case when p % 4 = 1 then 'DF_T_' || cast(object_id as varchar(20)) || '_' || cast(column_id as varchar(10)) end as default_name,
    p % 8 = 1 as default_is_system_named
  from typed where p % 19 <> 0)
"""

CONSTRAINTS = """
src_keys as (
  select distinct pair_id, object_id, 'PK' as type_code, object_id % 2 = 0 as is_system_named,
    case when object_id % 2 = 0 then 'PK__Tbl__' || cast(object_id * 7 as varchar(20)) else 'PK_Tbl_' || cast(object_id as varchar(20)) end as name,
    'CLUSTERED' as index_type_desc
  from base where column_id <= 2),
tgt_keys as (
  select distinct pair_id, object_id, 'PK' as type_code, object_id % 2 = 0 as is_system_named,
    case when object_id % 2 = 0 then 'PK__Tbl__' || cast(object_id * 11 as varchar(20)) else 'PK_Tbl_' || cast(object_id as varchar(20)) end as name,
    case when object_id % 15 = 0 then 'NONCLUSTERED' else 'CLUSTERED' end as index_type_desc
  from base where column_id <= 2),
src_key_columns as (
  select pair_id, object_id, column_id as key_ordinal, 'Col_' || cast(column_id as varchar(10)) as name,
         object_id % 5 = 0 as is_descending
  from base where column_id <= 2),
tgt_key_columns as (
  select pair_id, object_id, column_id as key_ordinal, 'Col_' || cast(column_id as varchar(10)) as name,
         (object_id % 5 = 0) <> (object_id % 21 = 0) as is_descending
  from base where column_id <= 2),
src_indexes as (
  select pair_id, object_id, 'IX_' || cast(object_id as varchar(20)) || '_' || cast(column_id as varchar(10)) as name,
    p % 10 = 0 as is_unique, 'NONCLUSTERED' as type_desc,
    case when p % 9 = 0 then '([Col_1]>(0))' end as filter_definition,
    'Col_' || cast(column_id as varchar(10)) as key_column, false as is_descending,
    case when p % 3 = 0 then 'Col_1' end as included_column
  from base where column_id >= 3 and s % 14 <> 1),
tgt_indexes as (
  select pair_id, object_id, 'ix_' || cast(object_id as varchar(20)) || '_' || cast(column_id as varchar(10)) as name,
    p % 10 = 0 as is_unique, 'NONCLUSTERED' as type_desc,
    case when p % 9 = 0 then '([col_1]>(0))' end as filter_definition,
    'Col_' || cast(column_id as varchar(10)) as key_column, s % 17 = 0 as is_descending,
    case when p % 3 = 0 then 'Col_1' end as included_column
  from base where column_id >= 3 and s % 14 <> 0),
src_checks as (
  select pair_id, object_id, p % 4 = 0 as is_system_named,
    case when p % 4 = 0 then 'CK__Tbl__' || cast(object_id * 13 + column_id as varchar(20))
         else 'CK_' || cast(object_id as varchar(20)) || '_' || cast(column_id as varchar(10)) end as name,
    '([Col_' || cast(column_id as varchar(10)) || '] >= (' || cast(p % 3 as varchar(10)) || '))' as definition,
    false as is_not_trusted
  from typed where type_name = 'decimal'),
tgt_checks as (
  select pair_id, object_id, p % 4 = 0 as is_system_named,
    case when p % 4 = 0 then 'CK__Tbl__' || cast(object_id * 17 + column_id as varchar(20))
         else 'CK_' || cast(object_id as varchar(20)) || '_' || cast(column_id as varchar(10)) end as name,
    '([COL_' || cast(column_id as varchar(10)) || ']   >= (' || cast((p + case when s % 16 = 0 then 1 else 0 end) % 3 as varchar(10)) || '))' as definition,
    s % 18 = 0 as is_not_trusted
  from typed where type_name = 'decimal'),
fk_edges as (
  select pair_id, object_id, referenced_object_id from (
    select o_custkey as pair_id, o_orderkey as object_id,
           lag(o_orderkey, 1) over (partition by o_custkey order by o_orderkey) as referenced_object_id from orders
    union all
    select o_custkey, o_orderkey, case when o_orderkey % 5 = 0
           then lag(o_orderkey, 3) over (partition by o_custkey order by o_orderkey) end from orders
    union all
    select o_custkey, min(o_orderkey), max(o_orderkey) from orders where o_custkey % 50 = 0
           group by o_custkey having count(*) > 1
    union all
    select o_custkey, o_orderkey, o_orderkey from orders where o_orderkey % 97 = 0) e
  where referenced_object_id is not null),
src_fks as (
  select distinct pair_id, object_id, referenced_object_id, object_id % 3 = 0 as is_system_named,
    case when object_id % 3 = 0 then 'FK__T__' || cast(object_id * 19 + referenced_object_id as varchar(20))
         else 'FK_' || cast(object_id as varchar(20)) || '_' || cast(referenced_object_id as varchar(20)) end as name,
    'Col_1' as parent_column, 'Col_1' as referenced_column,
    'NO_ACTION' as delete_action, 'NO_ACTION' as update_action, false as is_not_trusted
  from fk_edges where object_id % 10 <> 3),
tgt_fks as (
  select distinct pair_id, object_id, referenced_object_id, object_id % 3 = 0 as is_system_named,
    case when object_id % 3 = 0 then 'FK__T__' || cast(object_id * 23 + referenced_object_id as varchar(20))
         else 'FK_' || cast(object_id as varchar(20)) || '_' || cast(referenced_object_id as varchar(20)) end as name,
    'Col_1' as parent_column, 'Col_1' as referenced_column,
    case when object_id % 8 = 0 then 'CASCADE' else 'NO_ACTION' end as delete_action, 'NO_ACTION' as update_action,
    object_id % 6 = 0 as is_not_trusted
  from fk_edges where object_id % 10 <> 7)
"""


# Raw catalog views, derived from the blocks above (source side). snapshot_id = pair_id.
_TYPES = [  # user_type_id, system_type_id, schema_id, name, user defined, table type, assembly type, max_length
    (1, 1, 5, "int", False, False, False, 4), (2, 2, 5, "bigint", False, False, False, 8),
    (3, 3, 5, "varchar", False, False, False, 8000), (4, 4, 5, "nvarchar", False, False, False, 8000),
    (5, 5, 5, "decimal", False, False, False, 17), (6, 6, 5, "datetime2", False, False, False, 8),
    (100, 3, 1, "PhoneNumber", True, False, False, 25), (101, 1, 3, "Unused", True, False, False, 4),
    (102, 1, 1, "Rows", True, True, False, -1), (103, 1, 1, "Clr", True, False, True, -1),
]


def _type_rows() -> str:
    return " union all\n  ".join(
        f"select c_custkey as snapshot_id, {u} as user_type_id, {b} as system_type_id, {sc} as schema_id, '{n}' as name, "
        f"{ud} as is_user_defined, {tt} as is_table_type, {at} as is_assembly_type, {ml} as max_length, {u} % 19 as prec, {u} % 5 as scale, "
        f"{u} <> 100 as is_nullable, case when {u} > 2 then 'coll_{u}' end as collation_name from customer".lower()
        .replace(n.lower() + "'", n + "'")
        for u, b, sc, n, ud, tt, at, ml in _TYPES)


def _schema_rows() -> str:
    return " union all\n  ".join(
        f"select c_custkey as snapshot_id, {i} as schema_id, '{n}' as name from customer"
        for i, n in enumerate(["dbo", "Sales", "app", "hr", "sys"], 1))


CATALOG = f"""
sys_schemas as (
  {_schema_rows()}),
sys_types as (
  {_type_rows()}),
sys_tables as (
  select pair_id as snapshot_id, object_id, case schema_name when 'dbo' then 1 when 'Sales' then 2 when 'app' then 3 else 4 end as schema_id,
    table_name as name, object_id % 101 = 0 as is_ms_shipped, case object_id % 53 when 0 then 1 when 1 then 2 else 0 end as temporal_type
  from tables_base),
sys_columns as (
  select pair_id as snapshot_id, object_id, column_id, name,
    case when type_name = 'varchar' and max_length = 60 then 100 else case type_name when 'int' then 1 when 'bigint' then 2 when 'varchar' then 3
      when 'nvarchar' then 4 when 'decimal' then 5 else 6 end end as user_type_id,
    max_length, prec, scale, is_nullable, is_identity, computed_definition is not null as is_computed, collation_name,
    is_row_guid as is_rowguidcol, case when default_definition is null then 0 else object_id * 10 + column_id end as default_object_id
  from src_columns),
sys_computed_columns as (
  select pair_id as snapshot_id, object_id, column_id, computed_definition as definition, column_id = 2 as is_persisted
  from src_columns where computed_definition is not null),
sys_default_constraints as (
  select pair_id as snapshot_id, object_id * 10 + column_id as object_id, default_name as name, default_definition as definition,
    default_is_system_named as is_system_named
  from src_columns where default_definition is not null),
sys_identity_columns as (
  select pair_id as snapshot_id, object_id, column_id, object_id % 9 as seed_value, 1 + object_id % 4 as increment_value from src_columns where is_identity),
sys_indexes as (
  select pair_id as snapshot_id, object_id, 1 as index_id, name, 1 as type, 'CLUSTERED' as type_desc, true as is_unique,
    cast(null as varchar(50)) as filter_definition, false as is_disabled, false as is_hypothetical, true as is_primary_key,
    false as is_unique_constraint
  from src_keys
  union all
  select pair_id, object_id, cast(substr(key_column, 5) as int), name, case when object_id % 59 = 0 then 6 else 2 end,
    case when object_id % 59 = 0 then 'NONCLUSTERED COLUMNSTORE' else type_desc end, is_unique, filter_definition,
    object_id % 31 = 0, object_id % 61 = 0, false, false
  from src_indexes
  union all
  select pair_id, object_id, 90, 'UQ_Tbl_' || cast(object_id as varchar(20)), 2, 'NONCLUSTERED', true, null, false, false, false, true
  from src_keys where object_id % 8 < 3
  union all
  select pair_id, object_id, 0, null, 0, 'HEAP', false, null, false, false, false, false from tables_base where object_id % 7 = 0),
sys_index_columns as (
  select pair_id as snapshot_id, object_id, 1 as index_id, key_ordinal as index_column_id, key_ordinal as column_id, key_ordinal,
    is_descending as is_descending_key, false as is_included_column
  from src_key_columns
  union all
  select pair_id, object_id, 90, 3 - key_ordinal, key_ordinal, 3 - key_ordinal, not is_descending, false
  from src_key_columns where object_id % 8 < 3
  union all
  select pair_id, object_id, cast(substr(key_column, 5) as int), 1, cast(substr(key_column, 5) as int), 1, is_descending, false from src_indexes
  union all
  select pair_id, object_id, cast(substr(key_column, 5) as int), 2, cast(substr(included_column, 5) as int), 0, false, true
  from src_indexes where included_column is not null),
sys_key_constraints as (
  select pair_id as snapshot_id, object_id as parent_object_id, name, type_code as type, 1 as unique_index_id, is_system_named from src_keys
  union all
  select pair_id, object_id, 'UQ_Tbl_' || cast(object_id as varchar(20)), 'UQ', 90, object_id % 3 = 0 from src_keys where object_id % 8 < 3),
sys_foreign_keys as (
  select pair_id as snapshot_id, object_id * 1000000 + referenced_object_id as object_id, object_id as parent_object_id, referenced_object_id, name,
    delete_action as delete_referential_action_desc, case when object_id % 13 = 0 then 'SET_NULL' else update_action end as update_referential_action_desc, object_id % 19 = 0 as is_not_for_replication,
    is_not_trusted, object_id % 23 = 0 as is_disabled, is_system_named
  from src_fks),
sys_foreign_key_columns as (
  select pair_id as snapshot_id, object_id * 1000000 + referenced_object_id as constraint_object_id, 1 + object_id % 2 as constraint_column_id,
    object_id as parent_object_id, 1 as parent_column_id, referenced_object_id, 1 as referenced_column_id
  from src_fks
  union all
  select pair_id, object_id * 1000000 + referenced_object_id, 2 - object_id % 2, object_id, 2, referenced_object_id, 2 from src_fks where object_id % 4 < 3),
sys_check_constraints as (
  select pair_id as snapshot_id, object_id as parent_object_id, name, definition, is_not_trusted, object_id % 29 = 0 as is_disabled, is_system_named
  from src_checks),
sys_objects as (
  select pair_id as snapshot_id, object_id, case schema_name when 'dbo' then 1 when 'Sales' then 2 when 'app' then 3 else 4 end as schema_id,
    table_name as name, 'U ' as type, object_id % 101 = 0 as is_ms_shipped
  from tables_base
  union all
  select pair_id, 1000000000 + cast(substr(obj_name, 5) as bigint), 1, obj_name, case obj_type when 'View' then 'V ' when 'StoredProcedure' then 'P '
      else case cast(substr(obj_name, 5) as bigint) % 2 when 0 then 'FN' else 'IF' end end, cast(substr(obj_name, 5) as bigint) % 43 = 0
  from src_modules),
sys_sql_modules as (
  select pair_id as snapshot_id, 1000000000 + cast(substr(obj_name, 5) as bigint) as object_id, '  ' || definition || '  ' as definition from src_modules),
sys_sql_expression_dependencies as (
  select pair_id as snapshot_id, 1000000000 + cast(substr(obj_name, 5) as bigint) as referencing_id,
    case when cast(substr(obj_name, 5) as bigint) % 5 = 0 then null else 1000000000 + cast(substr(obj_name, 5) as bigint) - 150 end as referenced_id
  from src_modules)
"""

FLEET_CTES = ",\n".join(block.strip() for block in (OBJECTS, COLUMNS, CONSTRAINTS, CATALOG))


def fleet_sql(body: str, extra: str = "") -> str:
    """`body` as the final select behind the fleet CTEs, plus optional `extra` CTEs."""
    tail = ",\n" + extra.strip() if extra.strip() else ""
    return f"with {FLEET_CTES}{tail}\n{body}"


def cte_bodies() -> dict[str, str]:
    """The CTEs one by one, name to select text, in dependency order."""
    parts = re.split(r"(?m)^(\w+) as \(", FLEET_CTES)[1:]
    return {name: body.strip().rstrip(",").removesuffix(")") for name, body in zip(parts[::2], parts[1::2])}
