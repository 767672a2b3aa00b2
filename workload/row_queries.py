"""Row-level checks and changes (survey group J)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetshape.functions import render
from fleetshape.operators import rows as R
from workload import fleet
from workload import oracle_sql as Q
from workload.registry import query


#: Dates leave the queries as text, which every engine writes alike.
ORDERS = "* replace (cast(o_orderdate as varchar) as o_orderdate)"


def dated(df, column: str):
    return df.withColumn(column, F.col(column).cast("string"))


@query("q_apply_add_default", f"select {ORDERS}, 'web' as o_channel, cast(null as varchar) as o_note from orders")
def q_apply_add_default(spark, sf):
    orders = dated(fleet.cte(spark, sf, "orders"), "o_orderdate")
    with_channel = R.add_column(orders, "o_channel", "string", F.lit("web"), nullable=False)
    return R.add_column(with_channel, "o_note", "string", F.lit("none"), nullable=True)


@query("q_pre_add_notnull", "select 'orders' as table_name, cast(count(*) as bigint) as offending from orders")
def q_pre_add_notnull(spark, sf):
    return R.check_add_notnull(fleet.cte(spark, sf, "orders"), "orders")


@query("q_apply_widen", "select * replace (cast(c_nationkey as bigint) as c_nationkey) from customer")
def q_apply_widen(spark, sf):
    return R.alter_type(fleet.cte(spark, sf, "customer"), "c_nationkey", "bigint")


@query("q_pre_nulls", """
  select 'd' as column_name, cast(count(*) filter (where l_discount = 0.0) as bigint) as offending from lineitem
  union all select 't', cast(count(*) filter (where l_tax = 0.0) as bigint) from lineitem""")
def q_pre_nulls(spark, sf):
    items = fleet.cte(spark, sf, "lineitem").selectExpr("nullif(l_discount, 0.0) as d", "nullif(l_tax, 0.0) as t")
    return R.check_nulls(items, ["d", "t"])


@query("q_pre_truncation", """
  select 'text' as column_name, cast(count(*) filter (where length(text) > 200) as bigint) as does_not_fit, cast(0 as bigint) as loses_digits from documents
  union all select 'o_totalprice', cast(count(*) filter (where round(abs(o_totalprice), 2) >= 10000) as bigint),
    cast(count(*) filter (where round(abs(o_totalprice), 2) < 10000 and round(o_totalprice, 2) <> o_totalprice) as bigint) from orders
  union all select 'o_custkey', cast(count(*) filter (where o_custkey > 127) as bigint), cast(0 as bigint) from orders""")
def q_pre_truncation(spark, sf):
    text = R.check_narrowing(fleet.cte(spark, sf, "documents"), [R.Narrowing("text", max_chars=200)])
    numbers = R.check_narrowing(fleet.cte(spark, sf, "orders"), [
        R.Narrowing("o_totalprice", dtype="decimal(6,2)"), R.Narrowing("o_custkey", dtype="tinyint")])
    return text.unionByName(numbers)


@query("q_pre_text_length", r"""
  select 'nvarchar' as kind, 'text' as column_name, cast(count(*) filter (where length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) > 200) as bigint) as does_not_fit
  from documents
  union all select 'varchar', 'text', cast(count(*) filter (where strlen(text) > 200) as bigint) from documents""")
def q_pre_text_length(spark, sf):
    """A length is UTF-16 units for nvarchar and bytes for varchar."""
    docs = fleet.cte(spark, sf, "documents")
    kinds = {"nvarchar": R.Narrowing("text", max_chars=200), "varchar": R.Narrowing("text", max_bytes=200)}
    found = [R.check_narrowing(docs, [spec]).select(F.lit(kind).alias("kind"), "column_name", "does_not_fit") for kind, spec in kinds.items()]
    return found[0].unionByName(found[1])


@query("q_pre_duplicates_folded", """
  select upper(rtrim(c_mktsegment)) as c_mktsegment, c_nationkey, cast(count(*) as bigint) as copies from customer group by 1, 2 having count(*) > 1""")
def q_pre_duplicates_folded(spark, sf):
    """A key under a case-insensitive collation, with every other customer's segment in another spelling."""
    spelled = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), F.lit(" "))).otherwise(F.col("c_mktsegment"))
    rows = fleet.cte(spark, sf, "customer").withColumn("c_mktsegment", spelled)
    return R.check_unique(rows, ["c_mktsegment", "c_nationkey"], ignore_case=("c_mktsegment",))


@query("q_apply_drop", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def q_apply_drop(spark, sf):
    return R.drop_column(R.drop_column(fleet.cte(spark, sf, "orders"), "o_orderpriority"), "o_orderdate")


@query("q_apply_computed", """
  select * replace (cast(l_shipdate as varchar) as l_shipdate), l_extendedprice * (1 - l_discount) as l_net from lineitem""")
def q_apply_computed(spark, sf):
    items = dated(fleet.cte(spark, sf, "lineitem"), "l_shipdate").withColumn("l_net", F.col("l_tax"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return R.recompute(items, "l_net", net)


@query("q_pre_lost_to_computed", "select 'l_tax' as column_name, cast(count(nullif(l_tax, 0.0)) as bigint) as offending from lineitem")
def q_pre_lost_to_computed(spark, sf):
    items = fleet.cte(spark, sf, "lineitem").select(F.expr("nullif(l_tax, 0.0)").alias("l_tax"))
    return R.check_lost_to_computed(items, ["l_tax"])


@query("q_apply_identity", "select *, 100 + 5 * (row_number() over (order by c_custkey) - 1) as row_id from customer")
def q_apply_identity(spark, sf):
    return R.add_identity(fleet.cte(spark, sf, "customer"), "row_id", ["c_custkey"], 100, 5)


@query("q_pre_duplicates", """
  select l_orderkey, l_linenumber, cast(count(*) as bigint) as copies from lineitem where l_quantity > 5 group by 1, 2 having count(*) > 1""")
def q_pre_duplicates(spark, sf):
    return R.check_unique(fleet.cte(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_quantity") > 5)


@query("q_pre_primary_key", """
  select nullif(l_linenumber, 3) as line, l_orderkey, cast(count(*) as bigint) as copies from lineitem group by 1, 2
  having count(*) > 1 or nullif(l_linenumber, 3) is null""")
def q_pre_primary_key(spark, sf):
    items = fleet.cte(spark, sf, "lineitem").select("l_orderkey", F.expr("nullif(l_linenumber, 3)").alias("line"))
    return R.check_unique(items, ["l_orderkey", "line"], primary_key=True)


@query("q_pre_orphans", """
  select nullif(o.o_custkey, 7) as cust, o.o_orderstatus as status, cast(count(*) as bigint) as rows from orders o
  where nullif(o.o_custkey, 7) is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_custkey % 20 <> 0
    and o.o_orderstatus <> 'P') group by 1, 2""")
def q_pre_orphans(spark, sf):
    """Composite key with NULLs; the parent lacks every twentieth customer and the status P."""
    child = fleet.cte(spark, sf, "orders").select(F.expr("nullif(o_custkey, 7)").alias("cust"), F.col("o_orderstatus").alias("status"))
    statuses = F.explode(F.array(*[F.lit(s) for s in ("F", "O")]))
    parent = fleet.cte(spark, sf, "customer").where("c_custkey % 20 <> 0").select("c_custkey", statuses.alias("c_status"))
    return R.check_fk(child, parent, {"cust": "c_custkey", "status": "c_status"})


@query("q_pre_check", """
  select 'ck_quantity' as check_name, cast(count(*) filter (where nullif(l_quantity, 1) > 45) as bigint) as offending from lineitem""")
def q_pre_check(spark, sf):
    items = fleet.cte(spark, sf, "lineitem").select(F.expr("nullif(l_quantity, 1)").alias("l_quantity"))
    return R.check_predicate(items, F.col("l_quantity") <= 45, "ck_quantity")


@query("q_apply_rebuild", "select 'orders' as table_name, cast(count(*) as bigint) as rows_before, cast(0 as bigint) as rows_after from orders")
def q_apply_rebuild(spark, sf):
    """Rows a rebuild of the table would lose."""
    orders = fleet.cte(spark, sf, "orders")
    before = orders.agg(F.count("*").alias("rows_before")).withColumn("table_name", F.lit("orders"))
    after = R.rebuild(orders).agg(F.count("*").alias("rows_after")).withColumn("table_name", F.lit("orders"))
    return before.join(after, "table_name")


@query("q_apply_align", f"select {ORDERS}, cast(null as varchar) as o_note from orders")
def q_apply_align(spark, sf):
    orders = dated(fleet.cte(spark, sf, "orders"), "o_orderdate").withColumnsRenamed({"o_orderstatus": "O_ORDERSTATUS", "o_orderkey": "O_OrderKey"})
    wanted = T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_orderkey", T.LongType()),
                           T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderdate", T.StringType()), T.StructField("o_orderpriority", T.StringType()),
                           T.StructField("o_note", T.StringType())])
    return R.align(orders, wanted)


@query("q_apply_conserves", "select 'orders' as table_name, count(*) as rows_before, count(*) as rows_after, true as conserved from orders")
def q_apply_conserves(spark, sf):
    orders = fleet.cte(spark, sf, "orders")
    evolved = R.drop_column(R.add_column(R.alter_type(orders, "o_custkey", "decimal(20,0)"), "o_channel", "string", F.lit("web"), False),
                            "o_orderpriority")
    return R.conserved(orders, evolved, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"], "orders")


@query("q_changed_keys", "select o_orderkey from orders where o_orderkey % 11 = 0")
def q_changed_keys(spark, sf):
    """Keys a faulty change touched: every eleventh order lost its status."""
    orders = fleet.cte(spark, sf, "orders")
    faulty = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return R.changed_keys(orders, faulty, ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("q_lost_rows", """
  select o_orderkey, count(*)::bigint as rows_before, case when o_orderkey % 101 = 7 then 0 when o_orderkey % 103 = 9 then 2 else 1 end * count(*)::bigint as rows_after,
    case when o_orderkey % 101 = 7 then 'lost' when o_orderkey % 103 = 9 then 'added' else 'changed' end as change
  from orders where o_orderkey % 101 = 7 or o_orderkey % 103 = 9 or (o_orderkey % 107 = 5 and o_orderpriority is not null) group by 1""")
def q_lost_rows(spark, sf):
    """A lossy change: some orders are gone, some stand twice, some lost a value."""
    orders = fleet.cte(spark, sf, "orders")
    after = orders.where("o_orderkey % 101 <> 7").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 107 != 5, F.col("o_orderpriority")))
    after = after.unionByName(after.where("o_orderkey % 103 = 9"))
    return R.lost_rows(orders, after, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("q_nothing_lost", "select count(*)::bigint as rows, 0::bigint as unequal from lineitem")
def q_nothing_lost(spark, sf):
    """A harmless change: sums of buckets agree, no row of either table is shuffled."""
    items = fleet.cte(spark, sf, "lineitem")
    after = R.alter_type(items, "l_partkey", "decimal(20,0)").repartition("l_suppkey")
    keys, cols = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_shipdate"]
    one = F.lit(1).alias("one")
    left = R.lost_rows(items, after, keys, cols).agg(F.count(F.lit(1)).alias("unequal")).select("*", one)
    return items.agg(F.count(F.lit(1)).alias("rows")).select("*", one).join(left, "one").drop("one")


def _shape_sql(ordinal: str) -> str:
    return Q.oracle(f"""
  select pair_id, object_id, cast(sum(greatest(n, 0)) as bigint) as only_source, cast(sum(greatest(-n, 0)) as bigint) as only_target from (
    select pair_id, object_id, {ordinal} as o, col_key, type_sql, sum(sign) as n from (
      select pair_id, object_id, ordinal, col_key, type_sql, 1 as sign from o_src_cols
      union all select pair_id, object_id, ordinal, col_key, type_sql, -1 from o_tgt_cols) x group by all) y group by 1, 2""",
                    f"{Q._columns('src')},{Q._columns('tgt')}")


def _shapes(spark, sf):
    return [fleet.relation(spark, sf, side, "columns").withColumn("type_text", render.column_type(render.fields())) for side in ("src", "tgt")]


@query("q_shape_gate", _shape_sql("ordinal"))
def q_shape_gate(spark, sf):
    return R.same_shape(*_shapes(spark, sf), ["pair_id", "object_id"])


@query("q_shape_gate_unordered", _shape_sql("0"))
def q_shape_gate_unordered(spark, sf):
    return R.same_shape(*_shapes(spark, sf), ["pair_id", "object_id"], ordered=False)
