"""Preflights and changes compiled from the plan, over the driver tables as one target database.

What the tables look like is read from their schemas; what they should look like is that with EDITS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.compare import FleetDiff
from fleetshape.model import RELATION_FIELDS, relation_schema, table_key
from fleetshape.operators import rows as R
from fleetshape.plans import preflight as P
from fleetshape.plans.ordering import stored
from workload import fleet
from workload.registry import query

TABLES = ("orders", "customer", "documents", "lineitem")
PAIR = 1
_NEW = {"is_nullable": True, "is_user_defined": False, "is_identity": False, "is_computed": False, "is_row_guid": False, "is_persisted": False,
        "default_is_system_named": False, "type_schema": "sys", "max_length": 0, "precision": 0, "scale": 0}

#: Columns that change: None is dropped, an unknown name is added, else the facets that differ.
EDITS = {
    "orders": {
        "o_orderpriority": None,
        "o_custkey": {"type_name": "tinyint", "max_length": 1},
        "o_totalprice": {"type_name": "decimal", "max_length": 9, "precision": 7, "scale": 2},
        "o_orderstatus": {"type_name": "varchar", "max_length": 1, "is_nullable": False},
        "o_channel": {"type_name": "nvarchar", "max_length": 20, "is_nullable": False, "default_name": "DF_channel", "default_definition": "(N'web')"},
        "o_note": {"type_name": "nvarchar", "max_length": 40, "default_name": "DF_note", "default_definition": "('none')"},
        "o_checked": {"type_name": "bit", "max_length": 1, "is_nullable": False},
        "o_row": {"type_name": "int", "max_length": 4, "is_nullable": False, "is_identity": True, "identity_seed": "100", "identity_increment": "5"},
    },
    "customer": {
        "c_mktsegment": {"type_schema": "dbo", "type_name": "Segment", "is_user_defined": True},
        "c_acctbal": {"is_computed": True, "computed_definition": "([c_nationkey]*(2))"},
        "c_custkey": {"is_identity": True, "identity_seed": "1", "identity_increment": "1"},
    },
    "documents": {
        "text": {"type_name": "nvarchar", "max_length": 400},
        "lang": {"type_name": "varchar", "max_length": 2, "is_nullable": False},
        "n_chars": {"type_name": "smallint", "max_length": 2},
    },
    "lineitem": {
        "l_quantity": {"type_name": "tinyint", "max_length": 1},
        "l_discount": {"type_name": "decimal", "max_length": 5, "precision": 3, "scale": 1},
        "l_tax": {"is_computed": True, "computed_definition": "([l_discount]*(2))"},
    },
}
ALIASES = [{"schema_name": "dbo", "name": "Segment", "base_type_name": "varchar", "max_length": 9, "precision": 0, "scale": 0, "is_nullable": True}]
KEYS = {  # table, type, name, columns
    "keys": [("orders", "PK", "PK_orders", ["o_orderkey"]), ("customer", "UQ", "UQ_segment", ["c_mktsegment", "c_nationkey"]), ("lineitem", "PK", "PK_lineitem", ["l_orderkey"])],
    "indexes": [("lineitem", "UX", "UX_line", ["l_orderkey", "l_linenumber"])],
    "foreign_keys": [("orders", "FK", "FK_customer", ["o_custkey"]), ("lineitem", "FK", "FK_orders", ["l_orderkey"])],
}
REFERENCED = {"FK_customer": ("customer", ["c_custkey"]), "FK_orders": ("orders", ["o_orderkey"])}


def _edited(actual: DataFrame) -> DataFrame:
    rows = []
    for r in actual.orderBy("table_name", "ordinal").collect():  # the columns of four tables
        edit = EDITS[r["table_name"]].get(r["name"], {})
        if edit is not None:
            rows.append({**r.asDict(), **edit})
    for table, edits in EDITS.items():
        known = {r["name"] for r in rows if r["table_name"] == table}
        at = len(known)
        for name, edit in edits.items():
            if edit is not None and name not in known:
                at += 1
                rows.append({**_NEW, "pair_id": PAIR, "schema_name": "dbo", "table_name": table, "name": name, "ordinal": at, **edit})
    return actual.sparkSession.createDataFrame(rows, relation_schema("columns"))


def _keys(spark) -> dict[str, DataFrame]:
    out = {}
    for relation, items in KEYS.items():
        rows = []
        for i, (table, kind, name, columns) in enumerate(items, 1):
            row = {f: None for f in RELATION_FIELDS[relation]} | {
                "pair_id": PAIR, "schema_name": "dbo", "table_name": table, "ordinal": i, "name": name, "is_system_named": False, "is_disabled": False}
            parts = [{"name": c, "key_ordinal": n, "is_descending": False, "is_included": False, "index_column_id": n} for n, c in enumerate(columns, 1)]
            if relation == "foreign_keys":
                to, others = REFERENCED[name]
                row |= {"referenced_schema": "dbo", "referenced_table": to, "delete_action": "NO_ACTION", "update_action": "NO_ACTION",
                        "is_not_for_replication": False, "is_not_trusted": False,
                        "columns": [{"parent_column": a, "referenced_column": b} for a, b in zip(columns, others)]}
            else:
                row |= {"type_code": kind, "index_type_desc": "NONCLUSTERED", "columns": parts} if relation == "keys" else {
                    "is_unique": True, "type_desc": "NONCLUSTERED", "filter_definition": "([l_quantity]>(5))", "columns": parts}
            rows.append(row)
        out[relation] = spark.createDataFrame(rows, relation_schema(relation))
    return out


def _comparison(spark, sf, schemas: dict | None = None, keys: bool = False) -> FleetDiff:
    """The wanted database against the driver tables, or against tables of other `schemas`."""
    now = {t: fleet.cte(spark, sf, t).schema for t in TABLES}
    wanted, actual = P.describe(spark, PAIR, now), P.describe(spark, PAIR, schemas or now)
    wanted["columns"] = _edited(wanted["columns"])
    pairs = spark.createDataFrame([(PAIR, True, False, False, False)], "pair_id long, include_drops boolean, include_table_drops boolean, allow_rebuild boolean, add_only boolean")
    if keys:
        own = _keys(spark)
        wanted |= own
        actual |= {n: df.where("false") for n, df in own.items()}
    types = spark.createDataFrame([{"pair_id": PAIR, "collation_name": None, **a} for a in ALIASES], relation_schema("alias_types"))
    return P.resolved(FleetDiff(pairs, wanted, actual), types, types)



def _given() -> dict:
    return {"o_checked": F.lit(False), "c_acctbal": F.col("c_nationkey") * 2, "l_tax": F.col("l_discount") * 2}


def _works(spark, sf) -> dict[str, P.Work]:
    columns = stored(P.column_work(_comparison(spark, sf)), "column-work")
    return {t: P.work_of(PAIR, f"Table:dbo.{t}", columns, given=_given()) for t in TABLES}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("q_preflight_from_plan", """
  select * from (
    select 'orders' as table_name, unnest(['o_orderpriority', 'o_custkey', 'o_custkey', 'o_totalprice', 'o_totalprice', 'o_orderstatus', 'o_orderstatus', 'o_checked']) as column_name,
      unnest(['lost', 'does_not_fit', 'loses_digits', 'does_not_fit', 'loses_digits', 'null', 'does_not_fit', 'no_value']) as "check",
      unnest([count(o_orderpriority), count(*) filter (where o_custkey > 255), 0, count(*) filter (where round(abs(o_totalprice), 2) >= 100000),
        count(*) filter (where round(abs(o_totalprice), 2) < 100000 and round(o_totalprice, 2) <> o_totalprice), count(*) filter (where o_orderstatus is null),
        count(*) filter (where strlen(o_orderstatus) > 1), count(*)])::bigint as offending from orders
    union all
    select 'customer', unnest(['c_acctbal', 'c_mktsegment']), unnest(['lost', 'does_not_fit']),
      unnest([count(c_acctbal), count(*) filter (where strlen(c_mktsegment) > 9)])::bigint from customer
    union all
    select 'documents', unnest(['text', 'lang', 'lang', 'n_chars', 'n_chars']),
      unnest(['does_not_fit', 'null', 'does_not_fit', 'does_not_fit', 'loses_digits']),
      unnest([count(*) filter (where length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 200),
        count(*) filter (where lang is null), count(*) filter (where strlen(lang) > 2), count(*) filter (where n_chars not between -32768 and 32767), 0])::bigint from documents
    union all
    select 'lineitem', unnest(['l_quantity', 'l_quantity', 'l_discount', 'l_discount', 'l_tax']), unnest(['does_not_fit', 'loses_digits', 'does_not_fit', 'loses_digits', 'lost']),
      unnest([count(*) filter (where trunc(l_quantity) not between 0 and 255), count(*) filter (where l_quantity between 0 and 255.9 and trunc(l_quantity) <> l_quantity),
        count(*) filter (where round(abs(l_discount), 1) >= 100), count(*) filter (where round(abs(l_discount), 1) < 100 and round(l_discount, 1) <> l_discount), count(l_tax)])::bigint
    from lineitem) x""")
def q_preflight_from_plan(spark, sf):
    """Every column check that the plan calls for: one aggregate and one scan a table."""
    return _union([w.preflight(fleet.cte(spark, sf, t)).select(F.lit(t).alias("table_name"), "column_name", "check", "offending")
                   for t, w in _works(spark, sf).items()])


@query("q_preflight_keys_from_plan", """
  select 'orders' as table_name, 'PK_orders' as name, 'PK' as kind, (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1 or o_orderkey is null) x)::bigint as offending
  union all select 'customer', 'UQ_segment', 'UQ', (select count(*) from (select c_mktsegment, c_nationkey from customer group by 1, 2 having count(*) > 1) x)
  union all select 'lineitem', 'PK_lineitem', 'PK', (select count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1 or l_orderkey is null) x)
  union all select 'lineitem', 'UX_line', 'UX', (select count(*) from (select l_orderkey, l_linenumber from lineitem where l_quantity > 5 group by 1, 2 having count(*) > 1) x)
  union all select 'orders', 'FK_customer', 'FK', (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer where c_custkey is not null))
  union all select 'lineitem', 'FK_orders', 'FK', (select count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey is not null and o_orderkey % 9 <> 0))""")
def q_preflight_keys_from_plan(spark, sf):
    """Keys, unique indexes and foreign keys that the plan adds, held against the rows; every ninth order is missing."""
    keys = stored(P.key_work(_comparison(spark, sf, keys=True)), "key-work")
    parents = {f"TABLE:DBO.{t.upper()}": fleet.cte(spark, sf, t) for t in TABLES}
    parents["TABLE:DBO.ORDERS"] = parents["TABLE:DBO.ORDERS"].where("o_orderkey % 9 <> 0")
    out = []
    for t in TABLES:
        own = P.Work(keys=keys.where(F.col("obj_key") == table_key(F.lit("dbo"), F.lit(t))).collect())
        found = own.key_checks(fleet.cte(spark, sf, t), parents, {"UX_line": F.col("l_quantity") > 5})
        out.append(found.select(F.lit(t).alias("table_name"), "name", "kind", "offending"))
    return _union(out)


@query("q_evolved_shape", """
  select 'orders' as table_name, (select count(*) from orders) as rows_before, (select count(*) from orders) as rows_after, true as conserved, 0::bigint as remaining
  union all select 'customer', (select count(*) from customer), (select count(*) from customer), true, 2
  union all select 'documents', (select count(*) from documents), (select count(*) from documents), true, 0
  union all select 'lineitem', (select count(*) from lineitem), (select count(*) from lineitem), true, 0""")
def q_evolved_shape(spark, sf):
    """The tables after the plan: all rows are there, and comparing again leaves only what no statement can change.

    That is customer's identity: one warning, one change without a statement. Values that the preflight says do not fit are
    emptied first, as whoever runs the plan has to; the columns compared here are others.
    """
    works = _works(spark, sf)
    before = {}
    for t in TABLES:
        misfits = {c: F.when(~bad, F.col(c)) for (c, check), bad in works[t].checks().items() if check == "does_not_fit"}
        before[t] = fleet.cte(spark, sf, t).withColumns(misfits)
    after = {t: works[t].evolve(before[t], order=[before[t].columns[0]]) for t in TABLES}
    again = _comparison(spark, sf, {t: df.schema for t, df in after.items()})
    left = again.steps.groupBy("obj_key").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for t in TABLES:
        touched = {r["name"] for r in works[t].columns}
        parts.append(R.conserved(before[t], after[t], [c for c in before[t].columns if c not in touched], t))
    found = _union(parts).withColumn("obj_key", table_key(F.lit("dbo"), F.col("table_name"))).join(left, "obj_key", "left")
    return found.select("table_name", "rows_before", "rows_after", "conserved", F.coalesce("n", F.lit(0).cast("bigint")).alias("remaining"))
