"""DuckDB side of the checks: the comparison written as SQL over the fixture CTEs."""

from __future__ import annotations

from workload.fixture_sql import fleet_sql


def norm(x: str) -> str:
    return f"upper(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"


def q(x: str) -> str:
    return f"'[' || replace({x}, ']', ']]') || ']'"


def type_sql(name: str = "type_name", length: str = "max_length", prec: str = "prec", scale: str = "scale") -> str:
    return f"""case when {name} in ('varchar', 'char') then {name} || '(' || case when {length} = -1 then 'MAX' else cast({length} as varchar) end || ')'
      when {name} = 'nvarchar' then {name} || '(' || case when {length} = -1 then 'MAX' else cast({length} // 2 as varchar) end || ')'
      when {name} = 'decimal' then {name} || '(' || cast({prec} as varchar) || ',' || cast({scale} as varchar) || ')'
      when {name} = 'datetime2' then {name} || '(' || cast({scale} as varchar) || ')' else {name} end"""


def _columns(side: str) -> str:
    return f"""
o_{side}_cols as (
  select c.pair_id, c.object_id, t.schema_name, t.table_name, c.column_id as ordinal, c.name, upper(c.name) as col_key,
    c.type_name, c.max_length, c.prec, c.scale, c.is_nullable, c.is_identity, c.identity_seed, c.is_row_guid,
    c.computed_definition, c.computed_definition is not null as is_computed, c.collation_name,
    c.default_definition, c.default_name, c.default_is_system_named,
    {type_sql()} as type_sql,
    {norm('c.computed_definition')} as ncomp, {norm('c.default_definition')} as ndef,
    case when c.collation_name is not null then ' COLLATE ' || c.collation_name else '' end as collate_sql,
    case when c.is_nullable then ' NULL' else ' NOT NULL' end as null_sql,
    case when c.default_is_system_named or c.default_name is null then '' else 'CONSTRAINT [' || c.default_name || '] ' end as dname_sql
  from {side}_columns c join {side}_tables t on t.pair_id = c.pair_id and t.object_id = c.object_id),
o_{side}_coldefs as (
  select *, case when is_computed then '[' || name || '] AS ' || computed_definition
    else '[' || name || '] ' || type_sql || collate_sql
      || case when is_identity then ' IDENTITY(' || coalesce(identity_seed, '1') || ',' || coalesce(identity_seed, '1') || ')' else '' end
      || case when is_row_guid then ' ROWGUIDCOL' else '' end || null_sql
      || case when default_definition is not null then ' ' || dname_sql || 'DEFAULT ' || default_definition else '' end end as coldef
  from o_{side}_cols)"""


COMPARABLE = """
o_cmp as (
  select s.pair_id, s.object_id, '[' || s.schema_name || '].[' || s.table_name || ']' as ident,
    upper('Table:' || s.schema_name || '.' || s.table_name) as obj_key, p.include_drops
  from src_tables s join tgt_tables t on t.pair_id = s.pair_id and t.object_id = s.object_id
    join pairs p on p.pair_id = s.pair_id
  where s.has_model and t.has_model and not p.allow_rebuild)"""

COLUMN_MATCH = f"""{COMPARABLE},{_columns('src')},{_columns('tgt')},
o_s as (select c.*, m.ident, m.obj_key, m.include_drops from o_src_coldefs c join o_cmp m on m.pair_id = c.pair_id and m.object_id = c.object_id),
o_t as (select c.*, m.ident, m.obj_key, m.include_drops from o_tgt_coldefs c join o_cmp m on m.pair_id = c.pair_id and m.object_id = c.object_id),
o_both as (
  select s.pair_id, s.object_id, s.obj_key, s.ident, s.col_key, s.ordinal, s.name, s.coldef as s_coldef, s.collate_sql, s.null_sql,
    s.type_sql as s_type, t.type_sql as t_type, s.default_definition as s_default, s.dname_sql, t.default_name as t_dname,
    s.is_computed as s_comp, t.is_computed as t_comp, t.is_nullable as t_null, s.is_nullable as s_null,
    upper(s.type_sql) <> upper(t.type_sql) as d_type,
    upper(s.collation_name) is distinct from upper(t.collation_name) as d_coll,
    s.is_nullable <> t.is_nullable as d_null,
    s.is_identity <> t.is_identity or upper(s.identity_seed) is distinct from upper(t.identity_seed) as d_ident,
    s.is_computed <> t.is_computed or s.ncomp <> t.ncomp as d_comp,
    s.is_row_guid <> t.is_row_guid as d_guid, s.ndef <> t.ndef as d_def,
    s.type_name = t.type_name and ((s.max_length <> -1 and (t.max_length = -1 or s.max_length < t.max_length))
      or s.prec < t.prec or s.scale < t.scale) as narrower
  from o_s s join o_t t on t.pair_id = s.pair_id and t.object_id = s.object_id and t.col_key = s.col_key),
o_diff as (
  select *, (s_comp or t_comp) as recompute, not (s_comp or t_comp) and (d_type or d_coll or d_null) as alters,
    not (s_comp or t_comp) and d_def as redefault
  from o_both where d_type or d_coll or d_null or d_ident or d_comp or d_guid or d_def),
o_new as (select * from o_s s where not exists (select 1 from o_t t where t.pair_id = s.pair_id and t.object_id = s.object_id and t.col_key = s.col_key)),
o_only as (select * from o_t t where not exists (select 1 from o_s s where s.pair_id = t.pair_id and s.object_id = t.object_id and s.col_key = t.col_key)),
o_rewritten as (select distinct pair_id, object_id, obj_key, col_key from o_diff where recompute or alters)"""

COLUMN_STEPS = """
o_col_steps as (
  select pair_id, obj_key, 0 as kind_rank, 0 as side, ordinal, name, 1 as phase, 0 as sub, 'add_column' as action,
    'ALTER TABLE ' || ident || ' ADD ' || coldef || ';' as stmt from o_new
  union all select pair_id, obj_key, 0, 0, ordinal, name, -1, 0, 'warn_add_not_null',
    '-- warning add_not_null [' || name || ']'
    from o_new where not is_nullable and default_definition is null and not is_identity and not is_computed
  union all select pair_id, obj_key, 0, 0, ordinal, name, -1, 0, 'warn_identity',
    '-- warning identity [' || name || ']' from o_diff where d_ident
  union all select pair_id, obj_key, 0, 0, ordinal, name, 2, 0, 'drop_default',
    'ALTER TABLE ' || ident || ' DROP CONSTRAINT [' || t_dname || '];' from o_diff where t_comp and t_dname is not null
  union all select pair_id, obj_key, 0, 0, ordinal, name, 2, 1, 'drop_computed',
    'ALTER TABLE ' || ident || ' DROP COLUMN [' || name || '];' from o_diff where recompute
  union all select pair_id, obj_key, 0, 0, ordinal, name, 2, 2, 'add_computed',
    'ALTER TABLE ' || ident || ' ADD ' || s_coldef || ';' from o_diff where recompute
  union all select pair_id, obj_key, 0, 0, ordinal, name, 2, 3, 'alter_column',
    'ALTER TABLE ' || ident || ' ALTER COLUMN [' || name || '] ' || s_type || collate_sql || null_sql || ';' from o_diff where alters
  union all select pair_id, obj_key, 0, 0, ordinal, name, -1, 1, 'warn_not_null',
    '-- warning not_null [' || name || ']' from o_diff where alters and t_null and not s_null
  union all select pair_id, obj_key, 0, 0, ordinal, name, -1, 2, 'warn_narrowing',
    '-- warning narrower [' || name || '] ' || t_type || ' -> ' || s_type
    from o_diff where alters and d_type and narrower
  union all select pair_id, obj_key, 0, 0, ordinal, name, 2, 4, 'drop_default',
    'ALTER TABLE ' || ident || ' DROP CONSTRAINT [' || t_dname || '];' from o_diff where redefault and t_dname is not null
  union all select pair_id, obj_key, 0, 0, ordinal, name, 2, 5, 'add_default',
    'ALTER TABLE ' || ident || ' ADD ' || dname_sql || 'DEFAULT ' || s_default || ' FOR [' || name || '];' from o_diff where redefault and s_default is not null
  union all select pair_id, obj_key, 0, 0, ordinal, name, 2, 9, 'none', null from o_diff where not recompute and not alters and not redefault
  union all select pair_id, obj_key, 0, 1, ordinal, name, -1, 3, 'warn_column_kept',
    '-- warning column_kept [' || name || ']' from o_only where not include_drops
  union all select pair_id, obj_key, 0, 1, ordinal, name, 3, 0, 'drop_default',
    'ALTER TABLE ' || ident || ' DROP CONSTRAINT [' || default_name || '];' from o_only where include_drops and default_name is not null
  union all select pair_id, obj_key, 0, 1, ordinal, name, 3, 1, 'drop_column',
    'ALTER TABLE ' || ident || ' DROP COLUMN [' || name || '];' from o_only where include_drops
  union all select pair_id, obj_key, 0, 1, ordinal, name, -1, 3, 'warn_column_dropped',
    '-- warning column_lost [' || name || ']' from o_only where include_drops),
o_col_counts as (
  select pair_id, obj_key, 1 as changes, 0 as warnings from o_diff
  union all select pair_id, obj_key, 1, 0 from o_new
  union all select pair_id, obj_key, case when include_drops then 1 else 0 end, 0 from o_only
  union all select pair_id, obj_key, 0, 1 from o_col_steps where phase = -1)"""


def key_items(side: str) -> str:
    return f"""
o_{side}_key_cols as (
  select pair_id, object_id, string_agg(name || ':' || cast(is_descending as varchar), ',' order by key_ordinal) as shape,
    string_agg(upper(name) || '|' || cast(is_descending as varchar), ',' order by key_ordinal) as facets,
    string_agg('[' || name || ']' || case when is_descending then ' DESC' else ' ASC' end, ', ' order by key_ordinal) as cols_sql,
    list(upper(name) order by key_ordinal) as touches
  from {side}_key_columns group by 1, 2),
o_{side}_key_items as (
  select k.pair_id, k.object_id, t.schema_name, t.table_name, 1 as kind_rank, 1 as ordinal, k.name,
    upper(case when k.is_system_named then '~' || k.type_code || ':' || c.shape else k.name end) as match_key,
    k.type_code || '|' || k.index_type_desc || '|' || c.facets as facets, c.touches,
    'ALTER TABLE ' as add_head, ' ADD' || case when k.is_system_named then '' else ' CONSTRAINT [' || k.name || ']' end
      || ' PRIMARY KEY ' || k.index_type_desc || ' (' || c.cols_sql || ');' as add_tail,
    'ALTER TABLE ' as drop_head, ' DROP CONSTRAINT [' || k.name || '];' as drop_tail
  from {side}_keys k join o_{side}_key_cols c on c.pair_id = k.pair_id and c.object_id = k.object_id
    join {side}_tables t on t.pair_id = k.pair_id and t.object_id = k.object_id)"""


def check_items(side: str) -> str:
    return f"""
o_{side}_check_items as (
  select k.pair_id, k.object_id, t.schema_name, t.table_name, 2 as kind_rank,
    cast(regexp_extract(upper(k.definition), 'COL_(\\d+)', 1) as int) as ordinal, k.name,
    case when k.is_system_named then '~CK:' || {norm('k.definition')} else upper(k.name) end as match_key,
    {norm('k.definition')} || '|' || cast(k.is_not_trusted as varchar) as facets, cast([] as varchar[]) as touches,
    'ALTER TABLE ' as add_head, ' WITH ' || case when k.is_not_trusted then 'NOCHECK' else 'CHECK' end || ' ADD'
      || case when k.is_system_named then '' else ' CONSTRAINT [' || k.name || ']' end || ' CHECK ' || k.definition || ';' as add_tail,
    'ALTER TABLE ' as drop_head, ' DROP CONSTRAINT [' || k.name || '];' as drop_tail
  from {side}_checks k join {side}_tables t on t.pair_id = k.pair_id and t.object_id = k.object_id)"""


def fk_items(side: str) -> str:
    return f"""
o_{side}_fk_items as (
  select k.pair_id, k.object_id, t.schema_name, t.table_name, 3 as kind_rank, k.referenced_object_id as ordinal, k.name,
    upper(case when k.is_system_named then '~FK:' || r.schema_name || '.' || r.table_name || ':' || k.parent_column || '>' || k.referenced_column
      else k.name end) as match_key,
    upper(r.schema_name || '|' || r.table_name) || '|' || k.delete_action || '|' || k.update_action || '|'
      || upper(k.parent_column || '>' || k.referenced_column) as facets, [upper(k.parent_column)] as touches,
    'ALTER TABLE ' as add_head, ' WITH ' || case when k.is_not_trusted then 'NOCHECK' else 'CHECK' end || ' ADD'
      || case when k.is_system_named then '' else ' CONSTRAINT [' || k.name || ']' end || ' FOREIGN KEY ([' || k.parent_column
      || ']) REFERENCES [' || r.schema_name || '].[' || r.table_name || '] ([' || k.referenced_column || '])'
      || case when k.delete_action = 'CASCADE' then ' ON DELETE CASCADE' else '' end || ';' as add_tail,
    'ALTER TABLE ' as drop_head, ' DROP CONSTRAINT [' || k.name || '];' as drop_tail
  from {side}_fks k join {side}_tables t on t.pair_id = k.pair_id and t.object_id = k.object_id
    join {side}_tables r on r.pair_id = k.pair_id and r.object_id = k.referenced_object_id)"""


def index_items(side: str) -> str:
    return f"""
o_{side}_index_items as (
  select k.pair_id, k.object_id, t.schema_name, t.table_name, 4 as kind_rank,
    cast(regexp_extract(k.name, '(\\d+)$', 1) as int) as ordinal, k.name, upper(k.name) as match_key,
    cast(k.is_unique as varchar) || '|' || upper(k.type_desc) || '|' || {norm('k.filter_definition')} || '|' || upper(k.key_column) || '|'
      || cast(k.is_descending as varchar) || '|' || upper(coalesce(k.included_column, '')) as facets,
    case when k.included_column is null then [upper(k.key_column)] else [upper(k.key_column), upper(k.included_column)] end as touches,
    'CREATE ' || case when k.is_unique then 'UNIQUE ' else '' end || k.type_desc || ' INDEX [' || k.name || '] ON ' as add_head,
    ' ([' || k.key_column || ']' || case when k.is_descending then ' DESC' else ' ASC' end || ')'
      || case when k.included_column is null then '' else ' INCLUDE ([' || k.included_column || '])' end
      || case when k.filter_definition is null then '' else ' WHERE ' || k.filter_definition end || ';' as add_tail,
    'DROP INDEX [' || k.name || '] ON ' as drop_head, ';' as drop_tail
  from {side}_indexes k join {side}_tables t on t.pair_id = k.pair_id and t.object_id = k.object_id)"""


def _items(side: str) -> str:
    kinds = ["key", "check", "fk", "index"]
    cols = ("pair_id, object_id, kind_rank, ordinal, name, match_key, facets, touches, add_head, add_tail, drop_head, drop_tail")
    union = " union all ".join(f"select {cols} from o_{side}_{k}_items" for k in kinds)
    return ",".join([key_items(side), check_items(side), fk_items(side), index_items(side),
                     f"\no_{side}_items as ({union})"])


ITEMS = _items("src") + "," + _items("tgt")

ITEM_MATCH = f"""{ITEMS},
o_si as (select i.*, m.obj_key, m.ident, m.include_drops from o_src_items i join o_cmp m on m.pair_id = i.pair_id and m.object_id = i.object_id),
o_ti as (select i.*, m.obj_key, m.ident, m.include_drops from o_tgt_items i join o_cmp m on m.pair_id = i.pair_id and m.object_id = i.object_id),
o_tlast as (select * from o_ti qualify row_number() over (partition by pair_id, obj_key, kind_rank, match_key order by ordinal desc) = 1),
o_rw as (select pair_id, obj_key, list(col_key) as cols from o_rewritten group by 1, 2),
o_item_rows as (
  select s.pair_id, s.obj_key, s.kind_rank, 0 as side, s.ordinal, s.name, s.match_key, s.ident, s.include_drops,
    case when t.name is null then 'added' when s.facets = t.facets then 'same' else 'changed' end as outcome,
    coalesce(list_has_any(t.touches, rw.cols), false) as in_way,
    s.add_head || s.ident || s.add_tail as s_add, t.add_head || s.ident || t.add_tail as t_add, t.drop_head || s.ident || t.drop_tail as t_drop
  from o_si s left join o_tlast t on t.pair_id = s.pair_id and t.obj_key = s.obj_key and t.kind_rank = s.kind_rank and t.match_key = s.match_key
    left join o_rw rw on rw.pair_id = s.pair_id and rw.obj_key = s.obj_key
  union all
  select t.pair_id, t.obj_key, t.kind_rank, 1, t.ordinal, t.name, t.match_key, t.ident, t.include_drops, 'target_only',
    coalesce(list_has_any(t.touches, rw.cols), false), null, t.add_head || t.ident || t.add_tail, t.drop_head || t.ident || t.drop_tail
  from o_ti t left join o_rw rw on rw.pair_id = t.pair_id and rw.obj_key = t.obj_key
  where not exists (select 1 from o_si s where s.pair_id = t.pair_id and s.obj_key = t.obj_key and s.kind_rank = t.kind_rank and s.match_key = t.match_key)),
o_item_diff as (
  select *, in_way and (outcome = 'same' or (outcome = 'target_only' and not include_drops)) as moved,
    case kind_rank when 1 then 'key constraint' when 2 then 'check constraint' when 3 then 'foreign key' else 'index' end as label
  from o_item_rows),
o_item_steps as (
  select pair_id, obj_key, kind_rank, side, ordinal, name, -1 as phase, 4 as sub, 'warn_item_kept' as action,
    '-- warning item_kept ' || label || ' [' || name || ']' as stmt
    from o_item_diff where outcome = 'target_only' and not include_drops
  union all select pair_id, obj_key, kind_rank, side, ordinal, name, 0, 0, 'drop_item', t_drop from o_item_diff
    where outcome = 'changed' or (outcome = 'target_only' and include_drops)
  union all select pair_id, obj_key, kind_rank, side, ordinal, name, 0, 0, 'take_down', t_drop from o_item_diff where moved
  union all select pair_id, obj_key, kind_rank, side, ordinal, name, 4, 0, 'add_item', s_add from o_item_diff where outcome in ('added', 'changed')
  union all select pair_id, obj_key, kind_rank, side, ordinal, name, 4, 0, 'restore', case when outcome = 'same' then s_add else t_add end
    from o_item_diff where moved),
o_item_counts as (
  select pair_id, obj_key, case when outcome = 'same' or (outcome = 'target_only' and not include_drops) then 0 else 1 end as changes,
    case when outcome = 'target_only' and not include_drops then 1 else 0 end as warnings
  from o_item_diff where outcome <> 'same')"""

ALL_STEPS = f"{COLUMN_MATCH},{COLUMN_STEPS},{ITEM_MATCH},\no_steps as (select * from o_col_steps union all select * from o_item_steps)"

TABLE_COUNTS = """
o_table_counts as (
  select m.pair_id, m.obj_key, cast(coalesce(sum(c.changes), 0) as bigint) as changes, cast(coalesce(sum(c.warnings), 0) as bigint) as warnings
  from o_cmp m left join (select * from o_col_counts union all select * from o_item_counts) c
    on c.pair_id = m.pair_id and c.obj_key = m.obj_key group by 1, 2)"""


def _objects(side: str) -> str:
    return f"""
o_{side}_objects as (
  select pair_id, 'Table' as obj_type, schema_name, table_name as obj_name, definition, has_model from {side}_tables
  union all select pair_id, obj_type, schema_name, obj_name, definition, false from {side}_modules),
o_{side}_obj as (
  select *, upper(obj_type || ':' || schema_name || '.' || obj_name) as obj_key, {norm('definition')} as body,
    '[' || schema_name || '].[' || obj_name || ']' as identifier from o_{side}_objects)"""


OBJECTS = _objects("src") + "," + _objects("tgt")

OBJECT_MATCH = f"""{OBJECTS},
o_match as (
  select coalesce(s.pair_id, t.pair_id) as pair_id, coalesce(s.obj_key, t.obj_key) as obj_key,
    coalesce(s.obj_type, t.obj_type) as obj_type, s.identifier as s_ident, t.identifier as t_ident,
    s.schema_name as s_schema, s.obj_name as s_name, t.schema_name as t_schema, t.obj_name as t_name,
    s.obj_key is not null as in_src, t.obj_key is not null as in_tgt,
    coalesce(s.has_model and t.has_model, false) as modelled, s.body <> t.body as text_differs
  from o_src_obj s full outer join o_tgt_obj t on t.pair_id = s.pair_id and t.obj_key = s.obj_key)"""

CLASSIFY = """
o_class as (
  select m.*, p.include_drops, p.include_table_drops, p.allow_rebuild, p.add_only,
    m.in_src and m.in_tgt and m.obj_type = 'Table' and m.modelled and not p.allow_rebuild as structural,
    coalesce(c.changes > 0 or c.warnings > 0, false) as touched
  from o_match m join pairs p on p.pair_id = m.pair_id
    left join o_table_counts c on c.pair_id = m.pair_id and c.obj_key = m.obj_key),
o_actions as (
  select pair_id, obj_key, obj_type, coalesce(s_ident, t_ident) as identifier, coalesce(s_schema, t_schema) as schema_name,
    coalesce(s_name, t_name) as obj_name,
    case when not in_tgt then 'create'
      when not in_src then case when not include_drops or add_only then 'ignore'
        when obj_type = 'Table' and not include_table_drops then 'keep_table' else 'drop' end
      when structural and not touched or not structural and not text_differs then 'ignore'
      when add_only then 'skip_add_only'
      when structural then 'alter'
      when obj_type = 'Table' then case when allow_rebuild then 'rebuild' else 'skip_no_model' end
      else 'recreate' end as action
  from o_class),
o_act as (
  select *, case action when 'create' then 'added' when 'drop' then 'removed' when 'keep_table' then 'kept' else 'changed' end as outcome,
    action in ('keep_table', 'skip_add_only', 'skip_no_model') as skipped
  from o_actions where action <> 'ignore')"""

DRIFT = f"{ALL_STEPS},{TABLE_COUNTS},{OBJECT_MATCH},{CLASSIFY}"


def oracle(body: str, extra: str = "") -> str:
    return fleet_sql(body, extra)
