"""Comparison inside tables, one case per field of the model and outcome: all cases form one fleet, compared once.

What a field does when it differs is stated here; fields are taken from the model, so a new one has to be stated too.
"""

import pytest
from catalogs import Case, column, fleet, index, item, key, module, reference, spots, table

from fleetshape.model import CHECK_FIELDS, COLUMN_FIELDS, FK_FIELDS, INDEX_FIELDS, KEY_FIELDS

ALTER, IDENTITY, RECOMPUTE = ["alter_column"], ["warn_identity", "none"], ["drop_computed", "add_computed"]
TEXT = {"type_name": "varchar", "collation_name": "Plain_CI"}
NUMBER = {"type_name": "decimal"}

#: Field: (facets on both sides, one value, another, steps from the other to the one, steps back).
FACETS = {
    "type_schema": ({"type_name": "Code", "is_user_defined": True}, "geo", "store", ALTER, ALTER),
    "type_name": ({}, "bigint", "int", ALTER, ALTER),
    "is_user_defined": ({"type_name": "Code", "type_schema": "store"}, True, False, ALTER, ALTER),
    "max_length": (TEXT, 70, 30, ALTER, ["warn_narrowing", *ALTER]),
    "precision": ({**NUMBER, "scale": 2}, 12, 9, ALTER, ["warn_narrowing", *ALTER]),
    "scale": ({**NUMBER, "precision": 12}, 4, 3, ALTER, ["warn_narrowing", *ALTER]),
    "is_nullable": ({}, True, False, ALTER, ["warn_not_null", *ALTER]),
    "is_identity": ({"identity_seed": "3", "identity_increment": "2"}, True, False, IDENTITY, IDENTITY),
    "identity_seed": ({"is_identity": True, "identity_increment": "2"}, "3", "4", IDENTITY, IDENTITY),
    "identity_increment": ({"is_identity": True, "identity_seed": "3"}, "2", "5", IDENTITY, IDENTITY),
    "is_computed": ({"computed_definition": "(other+1)"}, True, False, RECOMPUTE, RECOMPUTE),
    "computed_definition": ({"is_computed": True}, "(other+1)", "(other+2)", RECOMPUTE, RECOMPUTE),
    "is_persisted": ({"is_computed": True, "computed_definition": "(other+1)"}, True, False, RECOMPUTE, RECOMPUTE),
    "collation_name": ({**TEXT, "max_length": 30}, "Plain_CI", "Plain_CS", ALTER, ALTER),
    "is_row_guid": ({}, True, False, ["none"], ["none"]),
    "default_definition": ({"default_name": "DF_own"}, "(7)", "(8)", ["drop_default", "add_default"], ["drop_default", "add_default"]),
    "default_name": ({"default_definition": "(7)"}, "DF_one", "DF_two", [], []),
    "default_is_system_named": ({"default_definition": "(7)", "default_name": "DF_own"}, True, False, [], []),
}

#: Kind: (an item by name, its fields whose difference replaces it with another value for each, fields that do not count).
ITEMS = {
    "key": (KEY_FIELDS, lambda name, **f: key(name, "a b", **f),
            {"type_code": "UQ", "index_type_desc": "NONCLUSTERED", "columns": spots("b a")}, {}),
    "check": (CHECK_FIELDS, lambda name, **f: item("checks", **{"name": name, "definition": "(a>(3))", **f}),
              {"definition": "(a>(4))", "is_not_trusted": True}, {"is_disabled": True}),
    "reference": (FK_FIELDS, lambda name, **f: reference(name, "a b", "Depot", "x y", **f),
                  {"referenced_schema": "geo", "referenced_table": "Port", "delete_action": "CASCADE", "update_action": "SET_NULL",
                   "is_not_for_replication": True, "columns": [{"parent_column": "a", "referenced_column": "y"}]},
                  {"is_not_trusted": True, "is_disabled": True}),
    "index": (INDEX_FIELDS, lambda name, **f: index(name, "a b", **f),
              {"is_unique": True, "type_desc": "CLUSTERED", "filter_definition": "(a>(3))", "columns": spots("a b", descending=("b",))}, {"is_disabled": True}),
}
AB = (column("a"), column("b"))


def differ(source, target, **options):
    return Case([table("Crate", *source)], [table("Crate", *target)], **options)


def cases():
    """Name: (case, steps in order, changes, warnings)."""
    out = {}

    def add(name, case, steps, changes=None):
        warned = sum(s.startswith("warn") for s in steps)
        out[name] = (case, steps, changes if changes is not None else int(len(steps) > warned), warned)

    for name, (both, one, other, there, back) in FACETS.items():
        sides = [column("own", **{**both, name: v}) for v in (one, other)]
        add(f"{name} differs", differ(sides[:1], sides[1:]), there)
        add(f"{name} differs back", differ(sides[1:], sides[:1]), back)
        add(f"{name} stays", differ(sides[:1], sides[:1]), [])

    home = column("a")
    for name, facets, steps in [
            ("nullable", {}, ["add_column"]), ("wanting a value", {"is_nullable": False}, ["warn_add_not_null", "add_column"]),
            ("with a default", {"is_nullable": False, "default_name": "DF_n", "default_definition": "(7)"}, ["add_column"]),
            ("numbered", {"is_nullable": False, "is_identity": True}, ["add_column"]),
            ("computed", {"is_nullable": False, "is_computed": True, "computed_definition": "(a+1)"}, ["add_column"])]:
        add(f"new column {name}", differ([home, column("n", **facets)], [home]), steps)
    only = column("n", default_name="DF_n", default_definition="(7)")
    add("old column stays", differ([home], [home, only]), ["warn_column_kept"], 0)
    add("old column goes", differ([home], [home, only], include_drops=True), ["warn_column_dropped", "drop_default", "drop_column"])
    add("other order and letters", differ([column("a"), column("b")], [column("B"), column("A")]), [])
    add("longest is widest", differ([column("t", max_length=30, **TEXT)], [column("t", max_length=-1, **TEXT)]), ["warn_narrowing", *ALTER])
    add("to longest", differ([column("t", max_length=-1, **TEXT)], [column("t", max_length=30, **TEXT)]), ALTER)
    add("white space of a text", differ([column("c", is_computed=True, computed_definition="(a  +\n1)")], [column("c", is_computed=True, computed_definition="(A + 1)")]), [])

    for kind, (fields, build, telling, silent) in ITEMS.items():
        assert set(fields) == {"ordinal", "name", "is_system_named", *telling, *silent} - ({"is_system_named"} if kind == "index" else set())
        own = build("X_own")
        add(f"{kind} stays", differ([*AB, own], [*AB, build("x_OWN")]), [])
        add(f"{kind} is new", differ([*AB, own], AB), ["add_item"])
        add(f"{kind} is kept", differ(AB, [*AB, own]), ["warn_item_kept"], 0)
        add(f"{kind} goes", differ(AB, [*AB, own], include_drops=True), ["drop_item"])
        for f, value in telling.items():
            add(f"{kind} {f} differs", differ([*AB, own], [*AB, build("X_own", **{f: value})]), ["drop_item", "add_item"], 1)
        for f, value in silent.items():
            add(f"{kind} {f} differs", differ([*AB, own], [*AB, build("X_own", **{f: value})]), [])
        if kind != "index":
            chosen = [build(n, is_system_named=True) for n in ("X__1", "X__2")]
            add(f"{kind} with a chosen name", differ([*AB, chosen[0]], [*AB, chosen[1]]), [])
            add(f"{kind} twice with chosen names", differ([*AB, *chosen], [*AB, *chosen]), [])
        wider = [column("b", "bigint"), column("a")], [column("b"), column("a")]
        aside = [] if kind == "check" else ["take_down"]
        back = [] if kind == "check" else ["restore"]
        add(f"{kind} over a rewritten column", differ([*wider[0], own], [*wider[1], own]), [*aside, *ALTER, *back])
        add(f"old {kind} over a rewritten column", differ(wider[0], [*wider[1], own]), ["warn_item_kept", *aside, *ALTER, *back])
        elsewhere = [column("c", "bigint"), *AB, own], [column("c"), *AB, own]
        add(f"{kind} beside a rewritten column", differ(*elsewhere), ALTER)
    covering = index("X_own", "a b", included=("b",))
    add("included column rewritten", differ([column("b", "bigint"), column("a"), covering], [*AB[::-1], covering]), ["take_down", *ALTER, "restore"])
    add("chosen key in other order", differ([*AB, key("X__1", "b a", is_system_named=True)], [*AB, key("X__2", "a b", is_system_named=True)]), ["warn_item_kept", "add_item"])
    return out


CASES = cases()
NAMES = list(CASES)


@pytest.fixture(scope="module")
def result(spark):
    diff = fleet(spark, [c[0] for c in CASES.values()])
    steps = {n: [] for n in NAMES}
    for r in sorted(diff.steps.collect(), key=lambda r: (r.phase, r.kind_rank, r.side, r.ordinal, r["sub"])):
        steps[NAMES[r.pair_id]].append(r)
    counts = {NAMES[r.pair_id]: (r.changes, r.warnings) for r in diff.table_counts.collect()}
    return steps, counts, {NAMES[r.pair_id]: r for r in diff.drift.collect()}


def test_every_column_field_has_a_case():
    assert set(FACETS) == set(COLUMN_FIELDS) - {"ordinal", "name"}


@pytest.mark.parametrize("name", NAMES)
def test_steps_and_counts(result, name):
    _, want, changes, warnings = CASES[name]
    steps, counts, drift = result
    assert [r.action for r in steps[name]] == want
    assert counts.get(name, (0, 0)) == (changes, warnings)
    assert drift[name].changed == int(changes + warnings > 0) == int(drift[name].drifted)


@pytest.mark.parametrize("name, action, text", [
    ("new column with a default", "add_column", "ALTER TABLE [store].[Crate] ADD [n] int NOT NULL CONSTRAINT [DF_n] DEFAULT (7);"),
    ("max_length differs", "alter_column", "ALTER TABLE [store].[Crate] ALTER COLUMN [own] varchar(70) COLLATE Plain_CI NULL;"),
    ("longest is widest", "warn_narrowing", "-- warning narrower [t] varchar(MAX) -> varchar(30)"),
    ("old column goes", "drop_column", "ALTER TABLE [store].[Crate] DROP COLUMN [n];"),
    ("index is_unique differs", "add_item", "CREATE NONCLUSTERED INDEX [X_own] ON [store].[Crate] ([a] ASC, [b] ASC);"),
    ("key index_type_desc differs", "add_item", "ALTER TABLE [store].[Crate] ADD CONSTRAINT [X_own] PRIMARY KEY CLUSTERED ([a] ASC, [b] ASC);"),
    ("chosen key in other order", "add_item", "ALTER TABLE [store].[Crate] ADD PRIMARY KEY CLUSTERED ([b] ASC, [a] ASC);"),
    ("reference goes", "drop_item", "ALTER TABLE [store].[Crate] DROP CONSTRAINT [X_own];"),
])
def test_text(result, name, action, text):
    assert [r.stmt for r in result[0][name] if r.action == action] == [text]


def test_compared_by_text(spark):
    legacy = [table("Crate", column("a"), model=False, definition=d) for d in ("one", "two")]
    views = [module("View", n, d) for n, d in (("Heap", "one"), ("heap", "two"))]
    got = fleet(spark, [Case(legacy[:1], legacy[1:]), Case(views[:1], views[1:])]).drift.orderBy("pair_id").collect()
    assert [(r.changed, r.skipped) for r in got] == [(1, 1), (1, 0)]


def test_difference_with_itself_is_empty(spark):
    own = [{**o, "obj_name": f"Crate{i}"} for i, o in enumerate(o for c, *_ in CASES.values() for o in c.source)]
    diff = fleet(spark, [Case(own, own, include_drops=True)])
    assert diff.steps.isEmpty() and not diff.drift.first().drifted


def test_pruning_changes_nothing(spark):
    """Every case as two snapshots, each pair of snapshots both ways and each snapshot with itself: pruned and whole comparison agree."""
    from catalogs import side
    from fleetshape.operators import digests, objects
    own = [(2 * i + k, getattr(c[0], name)) for i, c in enumerate(CASES.values()) for k, name in enumerate(("source", "target"))]
    relations = side(spark, own, "snapshot_id")
    ids = [(4 * i + 2 * k + m, 2 * i + k, 2 * i + m) for i in range(len(CASES)) for k in (0, 1) for m in (0, 1)]
    pairs = spark.createDataFrame([(*x, x[0] % 3 == 0, False, x[0] % 7 == 0, False) for x in ids], "pair_id long, source_snapshot_id long, target_snapshot_id long, "
                                  "include_drops boolean, include_table_drops boolean, allow_rebuild boolean, add_only boolean")
    tree = digests.build_tree(relations)
    whole = fleet(spark, [])
    whole.pairs, whole.src, whole.tgt = pairs, *(objects.attach_side(relations, pairs, s) for s in ("source", "target"))
    pruned = digests.pruned_diff(pairs, tree, tree)
    for name in ("drift", "table_counts", "steps"):
        assert sorted(map(str, getattr(pruned, name).collect())) == sorted(map(str, getattr(whole, name).collect())), name
    left = {r.pair_id for r in digests.unequal_pairs(pairs, tree, tree).collect()}
    silent = {4 * i + k for i, (n, c) in enumerate(CASES.items()) if c[1] == [] and "twice" not in n for k in (1, 2)}
    # A case's definition counts its items only: silent differences leave equal databases.
    assert not left & (silent | {x for i, n in enumerate(CASES) if "twice" not in n for x in (4 * i, 4 * i + 3)})
    assert pruned.src["columns"].count() < whole.src["columns"].count() / 2
