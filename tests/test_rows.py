"""Row-level work, documents and audit."""

import pytest
from catalogs import column, index, item, key, module, reference, side, table
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetshape.compare import FleetDiff
from fleetshape.model import OPTIONAL_FIELDS
from fleetshape.operators import rows as R
from fleetshape.operators.assemble import table_deps, with_definitions
from fleetshape.plans.ordering import numbered
from fleetshape.plans.prerequisites import used_schemas
from fleetshape.session import scratch_path
from fleetshape.sources import audit, snapshots


def test_numbering_survives_a_key_shared_by_most_rows(spark):
    df = spark.range(5000, numPartitions=7).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1))
    got = sorted((r.position, r.k) for r in numbered(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(5000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_identity(spark):
    got = R.add_identity(spark.range(10), "row_id", [F.desc("id")], 100, 5).orderBy("id").collect()
    assert [r.row_id for r in got] == [145 - 5 * i for i in range(10)]


def test_add_column_fills_only_not_null(spark):
    df = R.add_column(R.add_column(spark.range(2), "a", "int", F.lit(1), nullable=False), "b", "int", F.lit(1))
    assert [(r.a, r.b) for r in df.collect()] == [(1, None)] * 2


def test_narrowing(spark):
    df = spark.createDataFrame([("abc", 1.5, 300), ("abcdef", 1.25, 3), (None, None, None), ("", 12345.0, -129)], "s string, d double, i int")
    specs = [R.Narrowing("s", max_chars=5), R.Narrowing("d", dtype="decimal(4,1)"), R.Narrowing("i", dtype="tinyint")]
    got = {r.column_name: (r.does_not_fit, r.loses_digits) for r in R.check_narrowing(df, specs).collect()}
    assert got == {"s": (1, 0), "d": (1, 1), "i": (2, 0)}


def test_unique_allows_one_null_row(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert [(r.k, r.copies) for r in R.check_unique(df, ["k"]).collect()] == [(1, 2)]
    assert {r.k for r in R.check_unique(df, ["k"], primary_key=True).collect()} == {1, None}
    assert R.check_unique(df.union(spark.createDataFrame([(None,)], "k int")), ["k"]).where("k is null").first().copies == 2


def test_foreign_key(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None), (3, "a"), (3, "a")], "x int, y string")
    parent = spark.createDataFrame([(1, "a")], "p int, q string")
    got = sorted((r.x, r.y, r.rows) for r in R.check_fk(child, parent, {"x": "p", "y": "q"}).collect())
    assert got == [(1, "b", 1), (3, "a", 2)]
    assert R.check_fk(child, parent, {"x": "p", "y": "q"}, trusted=False).count() == 0


def test_check_lets_unknown_pass(spark):
    df = spark.createDataFrame([(1,), (50,), (None,)], "v int")
    assert R.check_predicate(df, F.col("v") <= 45, "ck").first().offending == 1


def test_conservation(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert R.conserved(df, df.withColumn("n", F.lit(1)), ["id", "v"], "t").first().conserved
    assert not R.conserved(df, df.where("id < 99"), ["id", "v"], "t").first().conserved
    moved = df.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))
    assert not R.conserved(df, moved, ["id", "v"], "t").first().conserved
    assert [r.id for r in R.changed_keys(df, moved, ["id"], ["v"]).collect()] == [7]


def test_align_and_rebuild(spark):
    wanted = T.StructType([T.StructField("B", T.LongType()), T.StructField("a", T.StringType()), T.StructField("c", T.IntegerType())])
    df = spark.createDataFrame([(1, 2)], "A int, b int")
    assert tuple(R.align(df, wanted).first()) == (2, "1", None)
    assert R.rebuild(df, wanted).count() == 0 and R.rebuild(df, wanted).columns == ["B", "a", "c"]


def test_lost_rows_are_found_and_little_is_shuffled(spark):
    before = spark.createDataFrame([(i % 400 if i else None, i % 7, f"v{i}") for i in range(1000)], "k int, g int, v string")
    keys, cols = ["k"], ["g", "v"]
    assert R.unequal_buckets(before, before.repartition(5), keys, cols).count() == 0 == R.lost_rows(before, before, keys, cols).count()
    after = before.where("k is not null and v <> 'v77'").withColumn("v", F.when(F.col("v") != "v12", F.col("v"))).unionByName(before.where("v = 'v9'"))
    got = {r.k: (r.rows_before, r.rows_after, r.change) for r in R.lost_rows(before, after, keys, cols).collect()}
    assert got == {None: (1, 0, "lost"), 77: (3, 2, "lost"), 12: (3, 3, "changed"), 9: (3, 4, "added")}
    assert R.unequal_buckets(before, after, keys, cols).count() == 4
    # A value that moves to the next column is a change, though the values hash alike.
    left, right = (spark.createDataFrame([(1, a, b)], "k int, a string, b string") for a, b in ((None, "x"), ("x", None)))
    assert R.lost_rows(left, right, ["k"], ["a", "b"]).count() == 1


def test_shape_gate_sees_order_only_when_asked(spark):
    a = spark.createDataFrame([(1, 1, "x", "int"), (1, 2, "y", "int")], "t int, ordinal int, name string, type_text string")
    b = spark.createDataFrame([(1, 2, "X", "int"), (1, 1, "y", "int")], "t int, ordinal int, name string, type_text string")
    assert tuple(R.same_shape(a, b, ["t"]).first()) == (1, 2, 2)
    assert tuple(R.same_shape(a, b, ["t"], ordered=False).first()) == (1, 0, 0)


@pytest.fixture(scope="module")
def relations(spark):
    objects = [
        table("Depot", column("no", is_identity=True, is_nullable=False, identity_seed="1", identity_increment="1"), key("P_Depot", "no")),
        table("Crate", column("no"), column("tag", "nvarchar", max_length=10, collation_name="Plain_CI"),
              reference("R_Depot", "no", "Depot", "no", is_disabled=True),
              item("checks", name="C_no", definition="(no>(3))", is_disabled=True),
              item("checks", name="C__1", definition="(3>2)", is_system_named=True, is_disabled=True),
              index("I_no", "no tag", included=("tag",), is_disabled=True), schema="geo"),
        table("Legacy", model=False, definition="CREATE TABLE Legacy (x int)"),
        module("View", "Heap", "CREATE VIEW Heap AS SELECT 7"),
    ]
    rel = side(spark, [(1, objects), (2, objects[:1])], "snapshot_id")
    rel["objects"] = rel["objects"].withColumn("definition", F.when(~F.col("has_model"), F.col("definition")))
    rel = with_definitions(rel)
    rel["dependencies"] = table_deps(rel["foreign_keys"])
    rel["alias_types"] = spark.createDataFrame([(1, "geo", "Dial", "varchar", 19, 0, 0, True, None)], (
        "snapshot_id long, schema_name string, name string, base_type_name string, max_length int, precision int, scale int, is_nullable boolean, "
        "collation_name string"))
    rel["schemas"] = used_schemas(rel["objects"], rel["alias_types"], "snapshot_id")
    rel["snapshots"] = spark.createDataFrame([(1, "One"), (2, "Two")], "snapshot_id long, database_name string").withColumn(
        "generated_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    return rel


def test_text_length_counts_units_and_bytes(spark):
    df = spark.createDataFrame([("abc",), ("\u00e9\u00e9",), ("\U0001f600\U0001f600",), (None,), ("",)], "s string")
    for spec, want in ((R.Narrowing("s", max_chars=3), 1), (R.Narrowing("s", max_bytes=3), 2), (R.Narrowing("s", max_bytes=8), 0)):
        assert R.check_narrowing(df, [spec]).first().does_not_fit == want


def test_keys_without_case_and_trailing_blanks(spark):
    child = spark.createDataFrame([("ab ", 1), ("AB", 1), (" ab", 1), (None, 2), ("zz", 3)], "k string, n int")
    assert {(r.k, r.copies) for r in R.check_unique(child, ["k"], ignore_case=("k",)).collect()} == {("AB", 2)}
    parent = spark.createDataFrame([("aB  ",), (" AB",)], "p string")
    assert {(r.k, r.rows) for r in R.check_fk(child, parent, {"k": "p"}, ignore_case=("k",)).collect()} == {("ZZ", 1)}


def test_create_table_text(relations):
    text = relations["objects"].where("obj_name = 'Crate'").first().definition
    assert text == (
        "CREATE TABLE [geo].[Crate]\n(\n    [no] int NULL,\n    [tag] nvarchar(5) COLLATE Plain_CI NULL\n);\nGO\n\n"
        "ALTER TABLE [geo].[Crate] WITH CHECK ADD CONSTRAINT [R_Depot] FOREIGN KEY ([no]) REFERENCES [store].[Depot] ([no]);\nGO\n"
        "ALTER TABLE [geo].[Crate] NOCHECK CONSTRAINT [R_Depot];\nGO\n\n"
        "ALTER TABLE [geo].[Crate] WITH CHECK ADD CONSTRAINT [C_no] CHECK (no>(3));\nGO\n"
        "ALTER TABLE [geo].[Crate] NOCHECK CONSTRAINT [C_no];\nGO\n\n"
        "ALTER TABLE [geo].[Crate] WITH CHECK ADD CHECK (3>2);\nGO\n\n"
        "CREATE NONCLUSTERED INDEX [I_no] ON [geo].[Crate] ([no] ASC) INCLUDE ([tag]);\nGO\n"
        "ALTER INDEX [I_no] ON [geo].[Crate] DISABLE;\nGO")


def test_documents_round_trip(spark, relations):
    path = scratch_path(spark, "docs")
    snapshots.write_snapshots(relations, path)
    back = snapshots.read_snapshots(spark, path, multi_line=False)
    for name in ("snapshots", "objects", "columns", "keys", "foreign_keys", "checks", "indexes", "dependencies", "alias_types"):
        cols = back[name].columns
        assert sorted(map(str, relations[name].select(cols).collect())) == sorted(map(str, back[name].collect())), name


def test_old_pretty_printed_document(spark, tmp_path):
    (tmp_path / "old.json").write_text('{\n "DatabaseName": "Old",\n "Objects": [\n  {"Type": "Table", "Schema": "dbo", "Name": "T", "Definition": "X"}\n ]\n}')
    back = snapshots.read_snapshots(spark, str(tmp_path))
    assert [(r.obj_name, r.has_model) for r in back["objects"].collect()] == [("T", False)]
    assert back["columns"].count() == 0 and back["schemas"].count() == 0


def test_sparse_documents_take_defaults(spark, tmp_path):
    (tmp_path / "sparse.json").write_text('''{"DatabaseName": "Sparse", "Objects": [
      {"Type": "Table", "Schema": "store", "Name": "Crate", "Table": {
        "Columns": [{"Name": "n", "TypeName": "decimal", "Precision": 9}, null], "KeyConstraints": [{"Name": "K", "Columns": [{"Name": "n"}]}],
        "ForeignKeys": [{"Name": "R"}], "Indexes": [{"Name": "I", "Columns": null}]}},
      {"Type": "View", "Name": "Heap"}]}''')
    back = snapshots.read_snapshots(spark, str(tmp_path))
    row = back["columns"].first().asDict()
    assert (row["scale"], row["max_length"], row["is_nullable"], row["type_schema"], row["table_name"]) == (0, 0, False, "", "Crate")
    assert {f for f, v in row.items() if v is None} == OPTIONAL_FIELDS - {"filter_definition"}
    assert [c.asDict() for c in back["keys"].first()["columns"]] == [{"name": "n", "key_ordinal": 0, "is_descending": False, "is_included": False, "index_column_id": 0}]
    assert back["foreign_keys"].first()["columns"] == back["indexes"].first()["columns"] == []
    assert ("View", "", "Heap", "", False) in [tuple(r)[1:] for r in back["objects"].collect()]
    # The statement that a missing field once made NULL, and so lost.
    scoped = {n: df.withColumnRenamed("snapshot_id", "pair_id") for n, df in back.items()}
    bare = {**scoped, "columns": scoped["columns"].where("false")}
    pairs = scoped["objects"].select("pair_id").distinct().selectExpr("pair_id", "false include_drops", "false include_table_drops", "false allow_rebuild", "false add_only")
    steps = [(r.action, r.stmt) for r in FleetDiff(pairs, {n: scoped[n] for n in ("objects", "columns")}, {n: bare[n] for n in ("objects", "columns")}).steps.collect()]
    assert ("add_column", "ALTER TABLE [store].[Crate] ADD [n] decimal(9,0) NOT NULL;") in steps


def test_rejects_name_what_is_broken(spark, tmp_path):
    good = '{"SnapshotId": %d, "DatabaseName": "D%d", "Objects": [{"Type": "View", "Schema": "s", "Name": "V"}]}'
    files = {"a.json": good % (1, 1), "b.json": good % (2, 2), "c.json": good % (2, 3), "d.json": (good % (4, 4))[:-9], "e.json": "no json", "f.json": '{"Objects": 7, "SnapshotId": 6}',
             "snapshot_id=9/g.json": "[", "h.json": good % (8, 8)}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    relations, rejects = snapshots.read_with_rejects(spark, str(tmp_path))
    got = {(r.file.rsplit("/", 1)[1], r.snapshot_id, r.reason) for r in rejects.collect()}
    unnamed = next(i for f, i, _ in got if f == "e.json")
    assert got == {("b.json", 2, "duplicate_id"), ("c.json", 2, "duplicate_id"), ("d.json", 4, "unreadable"), ("e.json", unnamed, "unreadable"),
                   ("f.json", 6, "unreadable"), ("g.json", 9, "unreadable")}
    assert sorted(r.snapshot_id for r in relations["objects"].collect()) == [1, 8] == sorted(r.snapshot_id for r in relations["snapshots"].collect())
    pairs = spark.createDataFrame([(1, 1, 8), (2, 1, 2), (3, 4, 9)], "pair_id long, source_snapshot_id long, target_snapshot_id long")
    usable, refused = snapshots.refuse_pairs(pairs, rejects)
    assert [r.pair_id for r in usable.collect()] == [1]
    assert {(r.pair_id, r.side, r.snapshot_id) for r in refused.collect()} == {(2, "target", 2), (3, "source", 4), (3, "target", 9)}


def test_audit_keeps_real_runs(spark, tmp_path):
    runs = spark.createDataFrame([(1, True, True, False), (2, False, True, False), (3, False, False, False), (4, True, True, True)],
                                 "id int, ok boolean, tx boolean, dry_run boolean").withColumn("started_at", F.timestamp_seconds(F.lit(0)))
    runs = runs.withColumn("outcome", audit.audit_outcome(F.col("ok"), F.col("tx")))
    for n in (1, 2):
        audit.append_audit(runs.where(F.col("id") % 2 == n % 2), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {r.id: r.outcome for r in log.collect()} == {1: "applied", 2: "rolled-back", 3: "failed"}
