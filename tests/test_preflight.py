"""Preflights and changes from the plan, over small tables."""

import pytest
from catalogs import Case, column, fleet, key, reference, table
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetshape.functions import types as Y
from fleetshape.model import relation_schema
from fleetshape.plans import preflight as P


def works(spark, source, target, given=None, **options):
    """The work on the one table of a comparison."""
    diff = fleet(spark, [Case([table("Crate", *source)], [table("Crate", *target)], **options)])
    return P.work_of(0, "Table:store.Crate", P.column_work(diff), P.key_work(diff), given)


def found(work, df):
    return {(r.column_name, r.check): r.offending for r in work.preflight(df).collect()}


def test_types_and_limits(spark):
    rows = [("nvarchar", 60, 0, 0), ("NCHAR", 8, 0, 0), ("varchar", 60, 0, 0), ("varchar", -1, 0, 0), ("varbinary", 9, 0, 0), ("decimal", 9, 12, 3),
            ("Numeric", 9, 5, 0), ("tinyint", 1, 0, 0), ("BIT", 1, 0, 0), ("datetime2", 8, 0, 7), ("unheard", 5, 0, 0)]
    df = spark.createDataFrame(rows, "name string, max_length int, p int, s int")
    got = [(r[0], tuple(r[1]) if r[1] else None) for r in df.select(
        Y.spark_type(F.col("name"), F.col("p"), F.col("s")), Y.text_limit(F.col("name"), F.col("max_length"))).collect()]
    assert got == [("string", ("utf16", 30)), ("string", ("utf16", 4)), ("string", ("bytes", 60)), ("string", None), ("binary", ("bytes", 9)), ("decimal(12,3)", None),
                   ("decimal(5,0)", None), ("smallint", None), ("boolean", None), ("timestamp_ntz", None), ("string", None)]


def test_aliases_stand_for_their_base(spark):
    names = [("a", "store", "DIAL", True), ("b", "store", "Unknown", True), ("c", "sys", "int", False)]
    cols = spark.createDataFrame([{**column(n)[1], "pair_id": 1, "schema_name": "store", "table_name": "Crate", "type_schema": s, "type_name": t, "is_user_defined": u}
                                  for n, s, t, u in names], relation_schema("columns"))
    alias = spark.createDataFrame([(1, "Store", "Dial", "varchar", 19, 0, 0, True, None), (2, "store", "Unknown", "int", 4, 0, 0, True, None)], relation_schema("alias_types"))
    got = {r.name: (r.type_name, r.max_length, r.is_user_defined) for r in Y.resolve_aliases(cols, alias).collect()}
    assert got == {"a": ("varchar", 19, False), "b": ("Unknown", 0, True), "c": ("int", 0, False)}


@pytest.mark.parametrize("text, value", [("((7))", "7"), ("(-2.50)", "-2.50"), ("(N'it''s')", "it's"), ("'x'", "x"), ("(NULL)", None), ("( ( .5 ) )", ".5")])
def test_literal_defaults(spark, text, value):
    assert spark.range(1).select(P.literal_of(text).cast("string")).first()[0] == value


@pytest.mark.parametrize("text", ["(getdate())", "('a'+'b')", "(7)+(8)", "NEXT VALUE FOR s"])
def test_other_defaults_are_no_literals(text):
    assert P.literal_of(text) is None


def test_each_check_counts_its_rows(spark):
    df = spark.createDataFrame([(300, "abc", 1.25, "x", 5, None), (20, None, 99.5, None, None, 2), (-1, "äö", 123456.0, "y", 7, 3)],
                               "tiny int, word string, price double, old string, plain int, need int")
    wide = {"type_name": "nvarchar", "max_length": -1}
    target = [column("tiny"), column("word", **wide), column("price", "float"), column("old", **wide), column("plain"), column("need")]
    source = [column("tiny", "tinyint"), column("word", "varchar", max_length=3), column("price", "decimal", precision=5, scale=1),
              column("plain", is_computed=True, computed_definition="(tiny+1)"), column("need", is_nullable=False), column("fresh", "bit", is_nullable=False),
              column("filled", "bit", is_nullable=False, default_definition="((1))")]
    work = works(spark, source, target, include_drops=True)
    assert found(work, df) == {("tiny", "does_not_fit"): 2, ("tiny", "loses_digits"): 0, ("word", "does_not_fit"): 1, ("price", "does_not_fit"): 1, ("price", "loses_digits"): 1,
                               ("old", "lost"): 2, ("plain", "lost"): 2, ("need", "null"): 1, ("fresh", "no_value"): 3}
    assert set(found(work, df.limit(0)).values()) == {0}
    plan = work.preflight(df.repartition(2))._jdf.queryExecution().toString()
    assert plan.count("Scan ExistingRDD") <= 3  # one each in the analysed, optimised and physical plan


def test_nothing_to_do(spark):
    own = [column("a"), column("b", is_row_guid=True)]
    work = works(spark, own, own)
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert found(work, df) == {} and work.evolve(df).collect() == df.collect() and work.key_checks(df, {}).count() == 0


def test_change_keeps_rows_and_order(spark):
    df = spark.createDataFrame([(2, "b", 9), (1, "a", 8), (3, None, 7)], "id int, word string, gone int")
    target = [column("id"), column("word", "nvarchar", max_length=-1), column("gone")]
    source = [column("id", "bigint"), column("word", "varchar", max_length=5), column("twice", is_computed=True, computed_definition="(id*2)"),
              column("note", "nvarchar", max_length=40, default_definition="('none')"), column("web", "bit", is_nullable=False, default_definition="((1))"),
              column("no", "bigint", is_nullable=False, is_identity=True, identity_seed="10", identity_increment="3")]
    work = works(spark, source, target, {"twice": F.col("id") * 2}, include_drops=True)
    out = work.evolve(df, ["id"])
    assert out.columns == ["id", "word", "twice", "note", "web", "no"]
    assert sorted(map(tuple, out.collect())) == [(1, "a", 2, None, True, 10), (2, "b", 4, None, True, 13), (3, None, 6, None, True, 16)]
    assert isinstance(out.schema["id"].dataType, T.LongType)
    entries = P.describe(spark, 0, {"Crate": out.schema}, "store")
    again = works(spark, source, [("columns", {k: v for k, v in r.asDict().items() if k not in ("pair_id", "schema_name", "table_name", "ordinal")})
                                  for r in entries["columns"].orderBy("ordinal").collect()])
    assert again.columns == []


@pytest.mark.parametrize("facets", [{"default_definition": "(newid())"}, {}])
def test_a_value_nobody_knows_is_refused(spark, facets):
    work = works(spark, [column("a"), column("b", is_nullable=False, **facets)], [column("a")])
    with pytest.raises(ValueError, match="column b"):
        work.evolve(spark.createDataFrame([(1,)], "a int"))
    work.given = {"b": F.lit(4)}
    assert work.evolve(spark.createDataFrame([(1,)], "a int")).collect() == [(1, 4)]


def test_added_keys_meet_the_rows(spark):
    own = [column("a"), column("b")]
    source = [*own, key("P", "a"), key("U", "a b", type_code="UQ"),
              reference("R", "b", "Depot", "x"), reference("R_off", "a", "Depot", "x", is_not_trusted=True)]
    work = works(spark, source, own)
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (4, None), (5, 3), (1, 1)], "a int, b int")
    depot = spark.createDataFrame([(1,), (2,)], "x int")
    got = {(r.name, r.kind): r.offending for r in work.key_checks(df, {"TABLE:STORE.DEPOT": depot}).collect()}
    assert got == {("P", "PK"): 2, ("U", "UQ"): 1, ("R", "FK"): 1}
