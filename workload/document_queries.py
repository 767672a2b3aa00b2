"""Documents that leave fields out, and documents that have to be refused (survey groups A and E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.model import OPTIONAL_FIELDS, RELATION_FIELDS
from fleetshape.operators.assemble import table_deps
from fleetshape.session import scratch_path
from fleetshape.sources import snapshots
from workload import fleet
from workload import oracle_sql as Q
from workload.registry import query


def _scoped(spark, sf, side: str) -> dict[str, DataFrame]:
    """One side of the fleet with a snapshot for each pair, and what a document says besides."""
    relations = {n: df.withColumnRenamed("pair_id", "snapshot_id").drop("object_id") for n, df in fleet.side(spark, sf, side).items()}
    ids = relations["objects"].select("snapshot_id").distinct()
    return {
        **relations,
        "dependencies": table_deps(relations["foreign_keys"], "snapshot_id"),
        "schemas": relations["objects"].select("snapshot_id", "schema_name").distinct(),
        "alias_types": spark.createDataFrame([], "snapshot_id long, schema_name string, name string, base_type_name string, max_length int, precision int, "
                                                 "scale int, is_nullable boolean, collation_name string"),
        "snapshots": ids.withColumns({"database_name": F.concat(F.lit("db_"), "snapshot_id"), "generated_at": F.lit(None).cast("timestamp")}),
    }


def _thinned(name: str, rows: DataFrame) -> DataFrame:
    """The relation with every value that is its field's default left out, as hand-made documents do."""
    empty = {"boolean": False, "integer": 0, "string": ""}
    return rows.withColumns({
        f: F.nullif(F.col(f), F.lit(empty[t.typeName()])) for f, t in RELATION_FIELDS[name].items()
        if t.typeName() in empty and f not in OPTIONAL_FIELDS and f not in ("ordinal", "schema_name", "table_name", "obj_type", "obj_name", "has_model")})




@query("q_sparse_documents", Q.oracle("""
  select c.pair_id as snapshot_id, t.schema_name, t.table_name, row_number() over (partition by c.pair_id, c.object_id order by c.column_id)::int as ordinal, c.name,
    'sys' as type_schema, c.type_name, false as is_user_defined, c.max_length::int as max_length, c.prec::int as precision, c.scale::int as scale, c.is_nullable, c.is_identity,
    c.computed_definition is not null as is_computed, c.collation_name, c.is_row_guid, c.computed_definition, false as is_persisted, c.default_name, c.default_definition,
    coalesce(c.default_is_system_named, false) as default_is_system_named, c.identity_seed, c.identity_seed as identity_increment
  from src_columns c join src_tables t on t.pair_id = c.pair_id and t.object_id = c.object_id where t.has_model"""))
def q_sparse_documents(spark, sf):
    """Documents without the fields whose value is the default, written, read, and compared field by field."""
    relations = _scoped(spark, sf, "src")
    for name in ("columns", "keys", "foreign_keys", "checks", "indexes"):
        relations[name] = _thinned(name, relations[name])
    path = scratch_path(spark, "sparse")
    snapshots.write_snapshots(relations, path)
    return snapshots.read_snapshots(spark, path, multi_line=False)["columns"]


@query("q_snapshot_rejects", """
  with b as (select c_custkey as id, case when c_custkey % 7 = 3 then 'unreadable' when c_custkey % 11 = 5 then 'duplicate_id' end as reason from customer)
  select 'pair' as kind, c_custkey as pair_id, side, id as snapshot_id, reason from customer, b, (select unnest(['source', 'target']) as side) s
  where reason is not null and id = c_custkey + case side when 'source' then 0 else 1 end
  union all
  select 'kept', id, null, n, null from (select id, (select count(*) from orders where o_custkey = id and o_orderkey % 37 <> 0) as n from b where reason is null) x""")
def q_snapshot_rejects(spark, sf):
    """Broken documents and ids used twice: the pairs they refuse, and how many objects the whole snapshots hold."""
    customers = fleet.cte(spark, sf, "customer").select("c_custkey")
    tables = fleet.table_objects(spark, sf, "src").select(F.col("pair_id").alias("c_custkey"), F.struct(
        F.lit("Table").alias("Type"), F.col("schema_name").alias("Schema"), F.col("obj_name").alias("Name"), F.col("definition").alias("Definition")).alias("o"))
    heads = customers.select("c_custkey", F.struct(F.col("c_custkey").alias("SnapshotId"), F.concat(F.lit("db_"), "c_custkey").alias("DatabaseName")).alias("d"))
    bodies = tables.select("c_custkey", F.struct(F.col("c_custkey").alias("SnapshotId"), F.array("o").alias("Objects")).alias("d"))
    head = heads.select("c_custkey", F.to_json("d").alias("value"))
    # A head that breaks off behind its id; a second database under the same id.
    broken = head.withColumn("value", F.when(F.col("c_custkey") % 7 == 3, F.expr("left(value, length(value) - 4)")).otherwise(F.col("value")))
    twice = head.where("c_custkey % 11 = 5 and c_custkey % 7 <> 3")
    path = scratch_path(spark, "faulty")
    broken.unionByName(twice).unionByName(bodies.select("c_custkey", F.to_json("d").alias("value"))).select("value").write.text(path)
    relations, rejects = snapshots.read_with_rejects(spark, path, multi_line=False)
    pairs = customers.select(F.col("c_custkey").alias("pair_id"), F.col("c_custkey").alias("source_snapshot_id"), (F.col("c_custkey") + 1).alias("target_snapshot_id"))
    _, refused = snapshots.refuse_pairs(pairs, rejects)
    found = refused.select(F.lit("pair").alias("kind"), "pair_id", "side", "snapshot_id", "reason").distinct()
    held = relations["objects"].groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    kept = relations["snapshots"].join(held, "snapshot_id", "left").select(
        F.lit("kept").alias("kind"), F.col("snapshot_id").alias("pair_id"), F.lit(None).cast("string").alias("side"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("snapshot_id"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(kept)
