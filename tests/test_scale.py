"""What keeps a large fleet within its limits: measured broadcasts, few exchanges, small batches and files."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from fleetshape.compare import FleetDiff
from fleetshape.model import COLUMN_FIELDS
from fleetshape.operators import assemble
from fleetshape.operators import columns as C
from fleetshape.operators import constraints as K
from fleetshape.operators import corpus
from fleetshape.session import FLEET_CONF, configure, configure_fleet
from fleetshape.sources import snapshots


def test_fleet_queries_broadcast_by_measured_size(spark):
    before = {k: spark.conf.get(k, None) for k in FLEET_CONF}
    try:
        configure_fleet(configure_fleet(spark))
        assert {k: spark.conf.get(k) for k in FLEET_CONF} == FLEET_CONF
    finally:
        configure(spark)
    assert {k: spark.conf.get(k, None) for k in FLEET_CONF} == before


def test_counted_items_tell_the_same_changes(spark):
    row = lambda name, definition: (1, "dbo", "T", 1, name, False, definition, False, False)
    schema = ("pair_id long, schema_name string, table_name string, ordinal int, name string, is_system_named boolean, definition string, "
              "is_not_trusted boolean, is_disabled boolean")
    src, tgt = (spark.createDataFrame(x, schema) for x in (
        [row("a", "x > 1"), row("b", "x > 2"), row("c", None), row("s", "y")], [row("A", "X  > 1"), row("b", "x > 3"), row("c", None), row("t", "y")]))
    tables = spark.createDataFrame([(1, "TABLE:DBO.T", "[dbo].[T]", False)], "pair_id long, obj_key string, table_ident string, include_drops boolean")
    key = src.select(K.table_key(F.col("schema_name"), F.col("table_name"))).first()[0]
    tables = tables.withColumn("obj_key", F.lit(key))
    lean = K.count_items(K.match_constraints(K.counted_items({"checks": src}), K.counted_items({"checks": tgt}), tables))
    full = K.count_items(K.match_constraints(K.constraint_items({"checks": src}, False), K.constraint_items({"checks": tgt}, False), tables))
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, full.collect())) == [(1, key, 0, 1), (1, key, 1, 0), (1, key, 1, 0)]
    assert K.counted_items({"checks": src}).schema["row"].dataType.simpleString() == "struct<facets:array<bigint>>"


@pytest.fixture
def orders(spark, tmp_path):
    """Two orders under one key, one order without a customer, and lines of each."""
    day = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(2, "c")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(4, 2, day), (4, 2, day), (5, None, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(4, 6, 3, 1), (4, 7, 3, 2), (5, 6, 3, 1), (9, 6, 3, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_relations_of_lines_take_their_names_along(spark, orders):
    from workload import fleet

    rows = fleet.columns(spark, orders, "src")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    # A table that is there twice has its columns twice; a table without a database has none.
    assert sorted((r["object_id"], r["table_name"], r["name"]) for r in rows.collect()) == [(4, "Tbl_4", n) for n in ("Col_1", "Col_1", "Col_2", "Col_2")]


def test_scripts_travel_in_small_batches(spark):
    scripts = spark.createDataFrame([(1, "a\nGO\nb")], "script_id long, text string")
    assert [r["text"] for r in corpus.split_batches(scripts).orderBy("batch_no").collect()] == ["a", "b"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(corpus.BATCH_ROWS)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(corpus.BATCH_BYTES)


def test_documents_are_compressed():
    class Writer:
        write = property(lambda self: self)

        def json(self, path, compression=None):
            self.said = (path, compression)

    told = Writer()
    nest, snapshots.nest_documents = snapshots.nest_documents, lambda relations: told
    try:
        snapshots.write_snapshots({}, "there")
    finally:
        snapshots.nest_documents = nest
    assert told.said == ("there", "gzip")


def test_foreign_keys_and_objects_are_not_written_or_moved_again(spark, orders):
    from workload import fleet

    for name in ("foreign_keys", "columns", "checks", "indexes", "objects"):
        assert "Exchange" not in fleet.relation(spark, orders, "src", name)._jdf.queryExecution().executedPlan().toString()
    assert all(f.startswith(f"file:{orders}") or f.startswith(f"file://{orders}") for f in fleet.relation(spark, orders, "src", "objects").inputFiles())
    # Order 4 is there twice: one edge, and each of its tables with each of those it refers to.
    found = fleet.relation(spark, orders, "src", "foreign_keys").select("schema_name", "table_name", "referenced_schema", "referenced_table").collect()
    assert [tuple(r) for r in found] == [("dbo", "Tbl_4", "dbo", "Tbl_4")] * 4


#: Columns of both sides of a table, and whether the table has a change or a warning.
_CASES = [
    ([{}], [{}], False), ([{"name": "A"}], [{"name": "a", "ordinal": 3}], False), ([{}], [{"type_name": "INT"}], False),
    ([{}], [{"type_name": "bigint"}], True), ([{"type_name": None}], [{}], False), ([{"is_nullable": None}], [{"is_nullable": True}], False),
    ([{"is_nullable": False}], [{"is_nullable": True}], True), ([{"is_row_guid": True}], [{}], True),
    ([{"is_nullable": None, "is_row_guid": True}], [{"is_nullable": True}], True),
    ([{"collation_name": None}], [{"collation_name": "x"}], True), ([{"collation_name": "X"}], [{"collation_name": "x"}], False),
    ([{"collation_name": "x", "identity_seed": None}], [{"collation_name": None, "identity_seed": "x"}], True),
    ([{"default_definition": None}], [{"default_definition": " "}], False), ([{"default_definition": "(0)"}], [{"default_definition": "(1)"}], True),
    ([{"computed_definition": "a  b"}], [{"computed_definition": "A b"}], False), ([{"default_name": "p"}], [{"default_name": "q"}], False),
    ([{}, {"name": "b"}], [{}], True), ([{}], [{}, {"name": "b"}], True),
    ([{}], [{"ordinal": 1, "type_name": "bigint"}, {"ordinal": 2}], False), ([{}, {"type_name": "bigint"}], [{}], True),
]


def test_touched_tables_are_those_with_counts(spark):
    given = {"ordinal": 1, "name": "a", "type_schema": "sys", "type_name": "int", "max_length": 4, "precision": 0, "scale": 0}
    fields = ", ".join(f"{n} {t.simpleString()}" for n, t in COLUMN_FIELDS.items())

    def side(place):
        rows = [(i % 2, "dbo", f"T{i}", *[{**given, **row}.get(f, False if t.simpleString() == "boolean" else None) for f, t in COLUMN_FIELDS.items()])
                for i, case in enumerate(_CASES) for row in case[place]]
        objects = [(i % 2, "Table", "dbo", f"T{i}", "x", True) for i in range(len(_CASES))]
        return {"columns": spark.createDataFrame(rows, f"pair_id long, schema_name string, table_name string, {fields}"),
                "objects": spark.createDataFrame(objects, "pair_id long, obj_type string, schema_name string, obj_name string, definition string, has_model boolean")}

    pairs = spark.createDataFrame([(0, False, False, False, False), (1, True, True, False, False)],
                                  "pair_id long, include_drops boolean, include_table_drops boolean, allow_rebuild boolean, add_only boolean")
    diff = FleetDiff(pairs, side(0), side(1))
    want = sorted((i % 2, f"TABLE:DBO.T{i}") for i, case in enumerate(_CASES) if case[2])
    assert sorted(map(tuple, diff.touched.collect())) == want
    assert sorted((r["pair_id"], r["obj_key"]) for r in diff.table_counts.collect()) == want
    assert sorted((r["pair_id"], r["obj_key"]) for r in diff.actions.where("action = 'alter'").collect()) == want
    # No text of a column but its table's key travels.
    assert C.compared_columns(diff.src["columns"]).schema["row"].dataType.simpleString() == "struct<a:bigint,b:bigint,known:int,value:int>"


def test_item_changes_read_no_columns(spark):
    row = lambda name, definition: (1, "dbo", "T", 1, name, False, definition, False, False)
    schema = ("pair_id long, schema_name string, table_name string, ordinal int, name string, is_system_named boolean, definition string, "
              "is_not_trusted boolean, is_disabled boolean")
    objects = spark.createDataFrame([(1, "Table", "dbo", "T", "x", True)],
                                    "pair_id long, obj_type string, schema_name string, obj_name string, definition string, has_model boolean")
    src, tgt = ({"objects": objects, "checks": spark.createDataFrame(x, schema)} for x in ([row("a", "x"), row("b", "y")], [row("A", "X"), row("b", "z")]))
    pairs = spark.createDataFrame([(1, False, False, False, False)],
                                  "pair_id long, include_drops boolean, include_table_drops boolean, allow_rebuild boolean, add_only boolean")
    assert [(r["name"], r["outcome"]) for r in FleetDiff(pairs, src, tgt).item_changes.collect()] == [("b", "changed")]


def test_objects_are_assembled_from_their_own_views(spark):
    cat = {
        "sys_tables": spark.createDataFrame([(1, 7, 1, "T", False, 0)], "snapshot_id long, object_id long, schema_id int, name string, is_ms_shipped boolean, temporal_type int"),
        "sys_schemas": spark.createDataFrame([(1, 1, "dbo")], "snapshot_id long, schema_id int, name string"),
        "sys_objects": spark.createDataFrame([(1, 8, 1, "v", "V ", False)], "snapshot_id long, object_id long, schema_id int, name string, type string, is_ms_shipped boolean"),
        "sys_sql_modules": spark.createDataFrame([(1, 8, " x ")], "snapshot_id long, object_id long, definition string")}
    rows = assemble.snapshot_summary(assemble.assemble_objects(cat)).collect()
    assert [r.asDict() for r in rows] == [{"snapshot_id": 1, "tables": 1, "views": 1, "procs": 0, "funcs": 0}]


def test_text_of_a_catalog_drift_is_written_once_per_database(spark, orders, monkeypatch):
    from workload import catalog_queries as CQ

    written = []
    monkeypatch.setattr(CQ, "stored", lambda df, label: written.append(label) or df)
    CQ.q_catalog_drift(spark, orders)
    assert written and "objects" not in written


def _documents(spark, path, monkeypatch, **given):
    """What the round trip of these tables writes, and the (first two) keys by which its columns and checks are moved."""
    from fleetshape.sources import snapshots
    from workload import catalog_queries as CQ

    for name, value in given.items():
        monkeypatch.setattr(assemble, name, value)
    with assemble.by_database(CQ.catalog(spark, path)) as cat:
        relations = assemble.assemble(cat)
        relations["snapshots"] = relations["objects"].select("snapshot_id").distinct().selectExpr(
            "snapshot_id", "'x' as database_name", "cast(null as timestamp) as generated_at")
        relations["schemas"] = relations["objects"].select("snapshot_id", "schema_name").distinct()
        plan = "".join(relations[n]._jdf.queryExecution().executedPlan().toString() for n in ("columns", "checks"))
        keys = set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (?:(\w+)#)?", plan))
        return sorted(r[0] for r in snapshots.nest_documents(relations).select(F.to_json(F.struct("*"))).collect()), keys


def test_a_catalog_is_nested_where_its_views_were_brought(spark, orders, monkeypatch):
    configure_fleet(spark).conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where databases are many
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    try:
        before = spark.conf.get(key, None)
        moved, keys = _documents(spark, orders, monkeypatch, LEAST_PARTITIONS=2)
        assert spark.conf.get(key, None) == before
        # Order 4 is there twice, with two columns.
        assert keys == {("snapshot_id", "")} and any('"Columns":[{"Name":"Col_1"' in x for x in moved)
        # A database that is too large for a task is joined on the views' own keys, with the same documents.
        documents, keys = _documents(spark, orders, monkeypatch, TOGETHER=0)
        assert documents == moved and ("snapshot_id", "object_id") in keys
    finally:
        configure(spark)


def test_rows_of_unwanted_tables_stay_where_they_are(spark):
    from fleetshape.operators import digests

    rows = spark.range(400).selectExpr("id % 7 as snapshot_id", "concat('TABLE:DBO.T', id) as obj_key", "id as n")
    wanted = rows.where("n % 40 = 3").select("snapshot_id", "obj_key")
    words = digests.marks(wanted)
    kept = digests.marked(rows, words)
    assert kept.columns == rows.columns and sorted(r["n"] for r in kept.collect()) == list(range(3, 400, 40))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert digests.marked(rows, digests.marks(wanted.where("false"))).count() == 0


def test_a_pruned_comparison_moves_marked_rows_alone(spark, monkeypatch):
    from catalogs import column, side, table
    from fleetshape.operators import digests, objects

    own = {0: [table("a", column("x")), table("b", column("y"))], 1: [table("a", column("x")), table("b", column("y", "bigint"))]}
    tree = digests.build_tree(side(spark, list(own.items()), "snapshot_id"))
    pairs = objects.with_mode_defaults(spark.createDataFrame([(5, 0, 1)], "pair_id long, source_snapshot_id long, target_snapshot_id long"), "drift")
    left, keep = [], digests.marked
    monkeypatch.setattr(digests, "marked", lambda rows, words: left.append(keep(rows, words)) or left[-1])
    diff = digests.pruned_diff(pairs, tree, tree)
    assert sum(df.count() for df in left) == 2
    assert [tuple(r)[1:4] for r in diff.drift.select("pair_id", "added", "changed", "removed").collect()] == [(0, 1, 0)]
