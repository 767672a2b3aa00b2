"""Scalar expressions and the script splitter."""

import random

import pytest
from catalogs import column, side, table
from pyspark.sql import functions as F

from fleetshape.functions import modules, render, text
from fleetshape.operators.corpus import batch_counts, separator_count, split_batches, split_script


def run(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_normalised_text_forgets_case_and_spacing(spark):
    rnd = random.Random(11)
    for n in range(5):
        words = [rnd.choice(["alpha", "Beta", "[gamma]", "7"]) for _ in range(n)]
        spaced = "".join(w + rnd.choice([" ", "\t\t", "\r\n", "\n  "]) for w in words)
        assert run(spark, spaced, text.normalize_text) == " ".join(words).upper()
    assert run(spark, None, text.normalize_text) == ""


def test_quotes_are_doubled(spark):
    assert run(spark, "rack]]7", text.quote) == "[rack]]]]7]"
    assert run(spark, "'n'", text.literal) == "''n''"


RENDERED = [
    (column("Shelf", "varchar", max_length=30, collation_name="Latin1_General_BIN"), "[Shelf] varchar(30) COLLATE Latin1_General_BIN NULL"),
    (column("Label", "nvarchar", max_length=90, is_nullable=False), "[Label] nvarchar(45) NOT NULL"),
    (column("Photo", "varbinary", max_length=-1), "[Photo] varbinary(MAX) NULL"),
    (column("Weight", "decimal", precision=9, scale=3), "[Weight] decimal(9,3) NULL"),
    (column("Opens", "time", scale=5), "[Opens] time(5) NULL"),
    (column("No", "bigint", is_identity=True, identity_seed="10", identity_increment="5", is_nullable=False), "[No] bigint IDENTITY(10,5) NOT NULL"),
    (column("Tag", "uniqueidentifier", is_row_guid=True, is_nullable=False), "[Tag] uniqueidentifier ROWGUIDCOL NOT NULL"),
    (column("Twice", is_computed=True, computed_definition="([No]*(2))"), "[Twice] AS ([No]*(2))"),
    (column("Bin", default_name="df_bin", default_definition="((7))", is_nullable=False), "[Bin] int NOT NULL CONSTRAINT [df_bin] DEFAULT ((7))"),
    (column("Code", "BinCode", type_schema="store", is_user_defined=True), "[Code] [store].[BinCode] NULL"),
]


@pytest.mark.parametrize("case, want", RENDERED)
def test_column_definition(spark, case, want):
    rows = side(spark, [(1, [table("Rack", case)])])["columns"]
    assert rows.select(render.column_definition(render.fields()).alias("d")).first().d == want


def test_clustered_flag_ignores_case_and_blanks(spark):
    seen = {v: run(spark, v, render.is_clustered) for v in ("clustered", "  CLUSTERED", "NonClustered", "HEAP", None)}
    assert seen == {"clustered": True, "  CLUSTERED": True, "NonClustered": False, "HEAP": False, None: False}


def test_referential_actions(spark):
    for action in ("CASCADE", "SET_NULL", "SET_DEFAULT"):
        for spelt in (action, action.lower()):
            assert run(spark, spelt, render.ref_action) == action.replace("_", " ")
    assert run(spark, "NO_ACTION", render.ref_action) is None


def test_type_codes(spark):
    kinds = {"U": "Table", "V": "View", "P": "StoredProcedure", **dict.fromkeys(["FN", "IF", "TF", "FS", "FT"], "Function")}
    for code, kind in kinds.items():
        assert run(spark, code.ljust(2), modules.object_type) == kind
    with pytest.raises(Exception, match="Unsupported SQL object type code"):
        run(spark, "ZZ", modules.object_type)


HEADERS = ["", "\n\t", "-- made by hand\n", "/* two\nlines */ ", "/**/-- both\n/* again */\r\n"]


@pytest.mark.parametrize("header", HEADERS)
@pytest.mark.parametrize("kind", ["VIEW", "procedure", "Function"])
def test_create_becomes_create_or_alter(spark, header, kind):
    rest = f"  {kind} store.Stock -- CREATE {kind} stays in comments\n AS ..."
    assert run(spark, f"{header}CREATE{rest}", modules.to_create_or_alter) == f"{header}CREATE OR ALTER{rest}"


@pytest.mark.parametrize("value", ["", "CREATE", "CREATES VIEW a", "alter view a as ...", "create or alter view a as ...", "-- create view a", "/* create view a"])
def test_what_is_no_create_stays(spark, value):
    assert run(spark, value, modules.to_create_or_alter) == value


def test_create_or_alter_survives_long_headers(spark):
    header = "-- x\n /* y * / */ " * 20_000
    assert run(spark, header + "CREATE VIEW v AS SELECT 1", modules.to_create_or_alter) == header + "CREATE OR ALTER VIEW v AS SELECT 1"


#: Batches that hold a separator line where it does not count, by what encloses it.
ENCLOSED = {
    "block comment": "a /* b\nGO\nc */ d",
    "comment in a comment": "a /* b /* c */\nGO 4\n*/ d",
    "string": "a = 'b\nGO\nc'",
    "string with a quote": "a = 'b'''\n+ '\ngo\n'",
    "bracket": "a.[b\nGO\nc]",
    "bracket with a bracket": "a.[b]]\nGO\nc]",
    "quoted name": 'a."b\nGO\nc"',
    "quoted name with a quote": 'a."b""\nGO\nc"',
}
PLAIN = ["b 1", "GOES on", "x; GO", "go to 5x", "b -- it's [open\nc", "d\n\ne"]
#: Separator lines and how often they run the batch before them.
SEPARATORS = {"GO": 1, "go": 1, "\tGo  ": 1, "GO 2": 2, "GO -- stop": 1, "GO 3 -- thrice": 3}


@pytest.mark.parametrize("kind", ENCLOSED)
def test_enclosed_separators_do_not_split(kind):
    assert split_script(f"first\nGO\n{ENCLOSED[kind]}\nGO\nlast") == [("first", 1), (ENCLOSED[kind], 1), ("last", 1)]


@pytest.mark.parametrize("opener", ["/*", "'", "[", '"'])
def test_what_is_never_closed_takes_the_rest(opener):
    rest = f"a {opener} b\nGO\nc"
    assert split_script(f"first\nGO\n{rest}") == [("first", 1), (rest, 1)]


def random_scripts(n=60):
    """Scripts put together from batches and separators, with the batches they must give."""
    rnd = random.Random(3)
    made = [("", []), ("\n \n\t", []), ("GO\n GO \n", [])]
    for _ in range(n):
        lines, want = [], []
        for _ in range(rnd.randrange(1, 6)):
            if rnd.random() < 0.2:  # an empty batch gives nothing
                lines += ["", rnd.choice(list(SEPARATORS))]
                continue
            batch, (line, times) = rnd.choice([*PLAIN, *ENCLOSED.values()]), rnd.choice(list(SEPARATORS.items()))
            lines += [batch, line]
            want.append((batch, times))
        made.append((rnd.choice(["\n", "\r\n"] if all("\n" not in b for b, _ in want) else ["\n"]).join(lines), want))
    return made


def test_split_of_random_scripts():
    for script, want in random_scripts():
        assert split_script(script) == want, script


def test_separator_lines():
    for line, times in SEPARATORS.items():
        assert separator_count(line) == times
    for line in ("", "GO away", "GO 0", "GO -2", "GO 1.5", "GO;", "AGO", "GO /* no */", f"GO {10 ** 12}"):
        assert separator_count(line) is None


def test_split_as_a_job(spark):
    cases = [(s, [b for b, n in want for _ in range(n)]) for s, want in random_scripts()]
    scripts = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "script_id long, text string")
    got = {}
    for r in split_batches(scripts).orderBy("script_id", "batch_no").collect():
        got.setdefault(r.script_id, []).append((r.batch_no, r.text))
    assert got == {i: list(enumerate(w, 1)) for i, (_, w) in enumerate(cases) if w}
    assert {r.script_id: r.batches for r in batch_counts(scripts).collect()} == {i: len(w) for i, (_, w) in enumerate(cases)}
