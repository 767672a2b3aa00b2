"""What travels between the tasks of a comparison: fields once, nothing that follows from them, and no step of one table by way of all."""

from __future__ import annotations

import re

from catalogs import Case, column, fleet, index, key, reference, table
from pyspark.sql import functions as F

from fleetshape.operators import columns as C
from fleetshape.operators import constraints as K
from fleetshape.operators import matching
from fleetshape.operators import objects as O
from fleetshape.plans import script
from fleetshape.session import FLEET_CONF, configure, configure_fleet


def _restored(spark):
    """A rewritten column under a key, an index and a reference, beside an index that changes."""
    items = [key("pk", "a"), index("i", "a b", descending=("a",)), index("j", "b", included=("b",)), reference("f", "a", "U", "x")]
    return fleet(spark, [Case([table("T", column("a", "bigint"), column("b"), *items)],
                              [table("T", column("a"), column("b"), *items[:2], index("j", "b"), items[3])], include_drops=True)])


def test_fields_of_items_travel_once_and_restore_the_same(spark):
    diff = _restored(spark)
    carried = K.constraint_items(diff.src)
    assert set(carried.columns) == {"pair_id", "obj_key", "kind_rank", "ordinal", *K.KINDS}
    assert "ordinal" not in carried.schema["indexes"].dataType.names
    assert carried.schema["indexes"].dataType["columns"].dataType.elementType.names == ["name", "is_descending", "is_included"]
    steps = {(r["action"], r["name"]): r["stmt"] for r in K.constraint_steps(diff.constraint_diff).collect()}
    assert set(steps) == {(a, n) for a in ("take_down", "restore") for n in ("pk", "i", "f")} | {("drop_item", "j"), ("add_item", "j")}
    assert steps["restore", "i"] == "CREATE NONCLUSTERED INDEX [i] ON [store].[T] ([a] DESC, [b] ASC);"
    assert steps["add_item", "j"] == "CREATE NONCLUSTERED INDEX [j] ON [store].[T] () INCLUDE ([b]);"


def test_columns_travel_as_their_fields_alone(spark):
    assert C._keyed(_restored(spark).src["columns"]).columns == ["pair_id", "obj_key", "row"]


def test_steps_of_one_relation_alone_are_written(spark):
    diff = _restored(spark)
    diff.src, diff.tgt = ({n: side[n] for n in ("objects", "columns", "checks", "indexes")} for side in (diff.src, diff.tgt))
    assert {r["name"] for r in K.constraint_steps(diff.constraint_diff).collect()} == {"i", "j"}


def test_lines_of_a_table_are_numbered_where_they_are(spark):
    diff = _restored(spark)
    placed = script.table_lines(diff.steps)
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    rows = placed.orderBy("line_no").collect()
    order = [(r["phase"], r["kind_rank"], r["side"], r["ordinal"], r["sub"]) for r in rows]
    assert order == sorted(order) and [r["line_no"] for r in rows] == list(range(diff.steps.where(F.col("stmt").isNotNull()).count()))


def test_a_plan_tells_touched_tables_from_what_it_wrote(spark, monkeypatch):
    """As the hashes do: a change, an item of one side alone, an item that only steps aside, an item with unknown facets, nothing at all."""
    from fleetshape import compare

    def case(source, target):
        return Case([table("T", column("a"), *source)], [table("T", column("a"), *target)])

    cases = [case([], []), case([column("b")], [column("b", "bigint")]), case([index("i", "a")], []), case([], [index("i", "a")]),
             case([index("i", "a", filter_definition="x")], [index("I", "a", filter_definition="X")]), case([index("i", "a")], [index("i", "a", is_unique=True)]),
             case([column("b"), index("i", "b")], [column("b", "bigint"), index("i", "b")]), case([index("i", "a", columns=None)], [index("i", "a", columns=None)])]
    want = sorted(map(tuple, fleet(spark, cases).touched.collect()))
    assert [i for i, _ in want] == [1, 2, 3, 5, 6]
    monkeypatch.setattr(compare, "touched", None)  # no hashes are compared
    assert sorted(map(tuple, fleet(spark, cases).share().touched.collect())) == want


def test_fleets_start_from_many_partitions_whatever_the_session_has(spark):
    """A window or an aggregate reads whole partitions: by the session's own number they grow with the fleet."""
    try:
        configure_fleet(spark)
        plan = _restored(spark).touched._jdf.queryExecution().executedPlan().toString()
        parts = {int(n) for n in re.findall(r"hashpartitioning\(pair_id#\d+L, obj_key#\d+, (\d+)\)", plan)}
        assert parts == {int(FLEET_CONF["spark.sql.adaptive.coalescePartitions.initialPartitionNum"])}
    finally:
        configure(spark)


def _compared(spark, rows):
    return spark.createDataFrame([(p, "T", k, o, r) for p, k, o, r in rows], "pair_id long, obj_key string, key long, ordinal int, row struct<a:long,b:long,known:int,value:int>")


def test_touched_tables_are_told_from_flat_rows(spark):
    same = (5, 6, 3, 1)
    src = [(1, 1, 1, same), (2, 1, 1, same), (4, 1, 1, (None, 6, 3, 1)), (5, 1, 1, same), (6, 1, 1, same), (7, 1, 1, same), (7, 1, 2, (4, 6, 3, 1)),
           (8, 1, 1, same), (9, 1, 1, (5, 6, 2, 0)), (10, 1, 1, same), (11, 1, 1, same), (11, 1, 2, (5, 6, 3, 3))]
    tgt = [(1, 1, 1, same), (3, 1, 1, same), (4, 1, 1, (9, 6, 3, 1)), (5, 1, 1, (5, 7, 3, 1)), (6, 1, 1, (5, 6, 3, 3)), (7, 1, 1, same),
           (8, 1, 1, (9, 6, 3, 1)), (8, 1, 2, same), (9, 1, 1, (5, 6, 1, 1)), (10, 1, None, same), (11, 1, 1, same)]
    found = matching.touched(_compared(spark, src), _compared(spark, tgt))
    # Alone on a side, b or a bit unlike, one of two source rows unlike, no target row with an ordinal.
    assert sorted(r["pair_id"] for r in found.collect()) == [2, 3, 5, 6, 7, 10, 11]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_half_a_digest_travels_with_an_object(spark):
    objects = _restored(spark).src["objects"]
    assert O.match_objects(objects, objects).select(F.length("s.digest")).first()[0] == 16


def test_facets_of_index_columns_are_hashed_without_a_lambda(spark):
    def side(names, **given):
        return fleet(spark, [Case([table("T", column("a"), index("i", names, **given), key("k", names))], [])]).src

    def hashes(s):
        return [r["a"] for r in K.compared_items(s).select("key", "row.a").orderBy("key").collect()]

    one = side("a b")
    assert "lambda" not in K.compared_items({"indexes": one["indexes"]})._jdf.queryExecution().optimizedPlan().toString()
    assert hashes(one) == hashes(side("A B")) and all(x != y for x, y in zip(hashes(one), hashes(side("a B2"))))
    assert hashes(side("a b", descending=("a",))) != hashes(side("a b", descending=("b",))) != hashes(side("a b", included=("b",)))
    assert [hashes(side("a", columns=None))[i] is None for i in (0, 1)].count(True) == 1
