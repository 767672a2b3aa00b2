"""Object comparison, filters and the script of a pair."""

import random

import pytest
from catalogs import Case, column, fleet, module, reference, side, table
from pyspark.sql import functions as F

from fleetshape.operators import assemble, filters
from fleetshape.operators import objects as O
from fleetshape.operators.corpus import split_script
from fleetshape.plans import levels, ordering, script

A = column("a", is_nullable=False)
ALIASED = column("tel", "Dial", type_schema="store", is_user_defined=True)
REPORT = module("View", "Report", "CREATE VIEW Report AS SELECT 7 AS n")


def linked(name, *others):
    return table(name, A, *[reference(f"R_{name}_{o}", "a", o, "a") for o in others])


#: Name: (case, added, changed, removed, skipped).
CASES = {
    "one more table": (Case([table("Crate", A), table("Barrel", A)], [table("Crate", A)]), 1, 0, 0, 0),
    "nothing but additions": (Case([table("Crate", A, column("b"))], [table("Crate", A)], include_drops=True, add_only=True), 0, 1, 0, 2),
    "tables stay, views go": (Case([], [table("Crate", A), REPORT], include_drops=True), 0, 0, 1, 1),
    "tables go": (Case([], [table("Crate", A)], include_drops=True, include_table_drops=True), 0, 0, 1, 0),
    "all stay": (Case([], [table("Crate", A)]), 0, 0, 0, 0),
    "rebuild": (Case([table("Crate", A, definition="CREATE TABLE Crate (new)")], [table("Crate", A, definition="CREATE TABLE Crate (old)")], allow_rebuild=True), 0, 1, 0, 0),
    "one view": (Case([REPORT], []), 1, 0, 0, 0),
    "own schema and type": (Case([table("Crate", A, ALIASED, schema="geo", definition="CREATE TABLE Crate (tel)")], []), 1, 0, 0, 0),
    "known schema": (Case([table("Crate", A, schema="geo")], [table("Crate", A, schema="geo")]), 0, 0, 0, 0),
    "references": (Case([linked("Aisle", "Yard"), linked("Yard"), REPORT], []), 3, 0, 0, 0),
    "ring": (Case([linked("Aisle", "Yard"), linked("Yard", "Aisle"), linked("Zone")], []), 3, 0, 0, 0),
    "changed procedure": (Case([module("StoredProcedure", "Fill", "-- first\nCREATE PROCEDURE Fill AS SELECT 7")],
                               [module("StoredProcedure", "Fill", "CREATE PROCEDURE Fill AS SELECT 8")]), 0, 1, 0, 0),
    "warning alone": (Case([table("Crate", A)], [table("Crate", A, column("b"))]), 0, 1, 0, 0),
}
NAMES = list(CASES)


@pytest.fixture(scope="module")
def result(spark):
    diff = fleet(spark, [c[0] for c in CASES.values()])
    types = spark.createDataFrame(
        [(i, s, "Dial", "varchar", 19, 0, 0, False, None) for i in range(len(CASES)) for s in ("store", "unused")],
        "pair_id long, schema_name string, name string, base_type_name string, max_length int, precision int, scale int, "
        "is_nullable boolean, collation_name string")
    diff.src["alias_types"] = types
    plan = ordering.stored(script.migration_plan(diff, assemble.table_deps(diff.src["foreign_keys"], "pair_id")), "plan")
    scripts, lists = {}, {}
    for r in script.diff_scripts(plan, diff.accepted).orderBy("pair_id", "line_no").collect():
        scripts[NAMES[r.pair_id]] = scripts.get(NAMES[r.pair_id], "") + "\n" * (r.line_no > 0) + r.line
    for r in script.drift_lists(diff.actions).orderBy("pair_id", "outcome", "list_no").collect():
        lists.setdefault((NAMES[r.pair_id], r.outcome), []).append(r.identifier)
    return {NAMES[r.pair_id]: r for r in diff.drift.collect()}, scripts, lists


@pytest.mark.parametrize("name", NAMES)
def test_drift(result, name):
    row = result[0][name]
    assert (row.added, row.changed, row.removed, row.skipped) == CASES[name][1:]
    assert row.drifted == (row.added + row.changed + row.removed > 0)


def test_lists_name_the_objects(result):
    assert result[2][("one more table", "added")] == ["[store].[Barrel]"]
    assert result[2][("references", "added")] == ["[store].[Aisle]", "[store].[Yard]", "[store].[Report]"]


def test_every_script_sets_session_options(result):
    assert all("SET ANSI_NULLS ON;" in text and "SET QUOTED_IDENTIFIER ON;" in text for text in result[1].values())


def test_a_created_view_has_a_batch_of_its_own(result):
    assert [b for b, _ in split_script(result[1]["one view"]) if "CREATE VIEW" in b] == [REPORT["definition"]]


def placed(text, *parts):
    at = [text.index(p) for p in parts]
    return at == sorted(at)


def test_prerequisites_come_first(result):
    text = result[1]["own schema and type"]
    assert placed(text, "IF SCHEMA_ID(N'geo') IS NULL", "CREATE SCHEMA [geo]", "CREATE TYPE [store].[Dial] FROM varchar(19) NOT NULL;", "CREATE TABLE")
    assert "[unused]" not in text and "CREATE SCHEMA" not in result[1]["known schema"]


def test_creates_follow_dependencies(result):
    assert placed(result[1]["references"], "store.Yard", "store.Aisle")
    assert placed(result[1]["ring"], "store.Zone", "-- warning dependency_cycle", "store.Aisle")


def test_changed_module_becomes_create_or_alter(result):
    assert "-- first\nCREATE OR ALTER PROCEDURE Fill AS SELECT 7\nGO" in result[1]["changed procedure"]


def test_rebuild_drops_then_creates(result):
    assert placed(result[1]["rebuild"], "DROP TABLE [store].[Crate];", "CREATE TABLE Crate (new)")


def test_block_of_warnings_ends_its_batch(result):
    text = result[1]["warning alone"]
    assert text.startswith("-- ") and text.endswith("\nGO")


#: One set of names for all rules of patterns: (type, schema, name).
CATALOG = [("Table", "store", "Crate"), ("Table", "store", "Crate2"), ("Table", "store", "a+b"), ("Table", "store", "aab"), ("Table", "geo", "crate"),
           ("View", "geo", "Heap"), ("StoredProcedure", "store", "Fill"), ("Function", "store", "count_all"), ("Table", "store", "count%all")]


def test_hidden_objects_are_neither_dropped_nor_read(spark):
    diff = fleet(spark, [Case([table("Crate", A)], [table("Crate", A), table("Barrel", A)], True, True)])
    for name in ("src", "tgt"):
        setattr(diff, name, filters.filter_side(getattr(diff, name), exclude="*.Barrel"))
    assert diff.drift.first().removed == 0 and diff.tgt["columns"].count() == 1


#: Rule: (include, exclude, what stays of CATALOG by place).
RULES = {
    "none": (None, None, range(9)), "blank parts": (" , ,", None, range(9)),
    "type alone": ("VIEW:", None, [5]), "type and star": ("procs: *", None, [6]), "type and glob": ("tables:cr*", None, [0, 1, 4]),
    "one letter": ("store.crate?", None, [1]), "any letters": ("*count*", None, [7, 8]), "whole name only": ("crat", None, []),
    "bare or qualified": ("CRATE", None, [0, 4]), "plus is plain": ("a+b", None, [2]), "percent is plain": ("count%all", None, [8]), "underscore is plain": ("count_all", None, [7]),
    "end alone": ("*_all", None, [7]), "both ends": ("g*p", None, [5]), "two patterns": ("geo.*, func:", None, [4, 5, 7]),
    "left out": (None, "geo.*,table:a*", [0, 1, 6, 7, 8]), "left out of chosen": ("store.*", "*2, proc:fill", [0, 2, 3, 7, 8]),
    "unknown type": ("thing:crate", None, []), "leading colon": (":crate", None, []),
}


@pytest.fixture(scope="module")
def ruled(spark):
    """What each rule leaves when it stands for one pair of many: all rules at once."""
    rows = [(i, *o) for i in range(len(RULES)) for o in CATALOG]
    objects = spark.createDataFrame(rows, "pair_id long, obj_type string, schema_name string, obj_name string")
    texts = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(RULES.values())], "pair_id long, include string, exclude string")
    out = {n: [] for n in RULES}
    for r in filters.filter_per_pair(objects, filters.pattern_rows(texts)).collect():
        out[list(RULES)[r.pair_id]].append(CATALOG.index((r.obj_type, r.schema_name, r.obj_name)))
    return out


@pytest.mark.parametrize("name", RULES)
def test_patterns(spark, ruled, name):
    include, exclude, stay = RULES[name]
    objects = spark.createDataFrame(CATALOG, "obj_type string, schema_name string, obj_name string")
    got = [CATALOG.index(tuple(r)) for r in filters.filter_objects(objects, include, exclude).collect()]
    assert sorted(got) == list(stay) == sorted(ruled[name])


def test_patterns_of_pairs_are_joined_by_equality(spark):
    objects = spark.createDataFrame([(1, *o) for o in CATALOG], "pair_id long, obj_type string, schema_name string, obj_name string")
    texts = spark.createDataFrame([(1, "a*,*b", "x")], "pair_id long, include string, exclude string")
    plan = filters.filter_per_pair(objects, filters.pattern_rows(texts))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_duplicate_keys_refuse_the_pair(spark):
    diff = fleet(spark, [Case([table("Crate", A), table("CRATE", A)], []), Case([table("Crate", A)], []), Case([], [REPORT, REPORT])])
    assert sorted((r.pair_id, r.side, r.obj_key, r.copies) for r in diff.rejects.collect()) == [
        (0, "source", "TABLE:STORE.CRATE", 2), (2, "target", "VIEW:STORE.REPORT", 2)]
    assert [(r.pair_id, r.added) for r in diff.drift.collect()] == [(1, 1)]
    assert {r.pair_id for r in diff.actions.collect()} == {1} and diff.steps.isEmpty()


def test_one_source_may_serve_many_targets(spark):
    relations = side(spark, [(7, [table("Crate", A)])], "snapshot_id")
    pairs = spark.createDataFrame([(1, 7, 8), (2, 7, 9)], "pair_id long, source_snapshot_id long, target_snapshot_id long")
    attached = O.attach_side(relations, pairs, "source")
    assert sorted(r.pair_id for r in attached["columns"].collect()) == [1, 2]


def test_levels_against_brute_force(spark):
    rnd = random.Random(5)
    nodes, edges = [], []
    for pair in range(6):
        nodes += [(pair, f"N{i}") for i in range(30)]
        edges += [(pair, f"N{rnd.randrange(30)}", f"N{rnd.randrange(30)}") for _ in range(12 + 6 * pair)]
    nodes += [(6, f"N{i}") for i in range(12)]
    edges += [(6, f"N{i + 1}", f"N{i}") for i in range(11)]
    n = spark.createDataFrame(nodes, "pair_id long, obj_key string")
    e = spark.createDataFrame(edges, "pair_id long, obj_key string, dep_key string")
    want, placed = dict.fromkeys(nodes), True
    while placed:
        placed = {}
        for pair, node in (k for k, level in want.items() if level is None):
            needs = [want[pair, d] for p, k, d in edges if (p, k) == (pair, node) and d != node]
            if None not in needs:
                placed[pair, node] = max(needs, default=-1) + 1
        want.update(placed)
    assert {(p, k): level for p, k, level in levels.create_levels(n, e).collect()} == want
    assert None in want.values() and 11 in want.values()
    alone = levels.create_levels(n, e.limit(0))
    assert {r.level for r in alone.collect()} == {0}


def test_cycles_against_brute_force(spark):
    rnd = random.Random(9)
    nodes = [(p, f"N{i:02}") for p in range(8) for i in range(24)]
    edges = [(p, f"N{rnd.randrange(24):02}", f"N{rnd.randrange(24):02}") for p in range(8) for _ in range(10 + 5 * p)]
    # Two rings, one behind the other, a chain between them and a chain behind both.
    ring = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("E", "D"), ("F", "E"), ("F", "G"), ("G", "F"), ("H", "G"), ("I", "I")]
    nodes, edges = nodes + [(9, n) for n in "ABCDEFGHI"], edges + [(9, a, b) for a, b in ring]
    reach = {(p, a, b) for p, a, b in edges if a != b}
    while more := {(p, a, d) for p, a, b in reach for q, c, d in edges if p == q and b == c and c != d} - reach:
        reach |= more
    on = {(p, a): min(b for q, x, b in reach if (q, x) == (p, a) and (p, b, a) in reach) for p, a, b in reach if a == b}
    blocked = {n for n in nodes if n in on or any((p, b) in on for p, a, b in reach if (p, a) == n)}
    n = spark.createDataFrame(nodes, "pair_id long, obj_key string")
    e = spark.createDataFrame(edges, "pair_id long, obj_key string, dep_key string")
    got = {(r.pair_id, r.obj_key): r.cycle for r in levels.cycle_members(levels.create_levels(n, e), e).collect()}
    assert got == {k: on.get(k) for k in blocked} and len(set(on.values())) >= 4
    assert levels.cycle_members(levels.create_levels(n, e.limit(0)), e.limit(0)).count() == 0


def test_one_long_script_is_one_ordered_script(spark, tmp_path):
    rows = spark.range(0, 100_000, 1, 4).select(
        F.when(F.col("id") % 50 == 0, 2).otherwise(1).alias("pair_id"), (F.col("id") * 7 % 100_003).alias("o"), F.col("id").cast("string").alias("line"))
    placed = ordering.stored(ordering.lined(rows, ["pair_id"], ["o"]).select("pair_id", "line_no", "line"), "lines")
    for pair in (1, 2):
        want = sorted((i for i in range(100_000) if (i % 50 == 0) == (pair == 2)), key=lambda i: i * 7 % 100_003)
        got = placed.where(F.col("pair_id") == pair).orderBy("line_no").collect()
        assert [(r.line_no, r.line) for r in got] == [(n, str(i)) for n, i in enumerate(want)]
    script.write_script(placed, 1, str(tmp_path / "one"))
    files = sorted((tmp_path / "one").glob("part-*"))
    assert "".join(f.read_text() for f in files).split() == [r.line for r in placed.where("pair_id = 1").orderBy("line_no").collect()]
    script.write_scripts(placed, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 100_000
