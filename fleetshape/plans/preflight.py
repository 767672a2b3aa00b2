"""From plan rows to work on rows: what a change of a table's columns and keys would lose, and the change itself.

The comparison says which columns of a table are added, retyped, dropped or recomputed
(`FleetDiff.column_diff`) and which keys are added (`FleetDiff.constraint_diff`). `column_work` and
`key_work` turn that into rows for the whole fleet; `work_of` hands over the rows of one table - as many as
the catalog gives it columns - and `Work` compiles them: every column check of a table into one
aggregate, hence one scan, and every column change into one projection.

Defaults and computed expressions are opaque text of the described server. Literals are read
(numbers, quoted text, null); anything else has to be given as a Spark column, or the change is refused by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetshape.compare import FleetDiff
from fleetshape.functions.types import described_type, resolve_aliases, spark_type, text_limit
from fleetshape.model import RELATION_FIELDS, TABLE, relation_schema, table_key
from fleetshape.operators import rows as R

ADD, RETYPE, DROP, RECOMPUTE, REDEFAULT = "add", "retype", "drop", "recompute", "default"

#: Metadata of a Spark column that holds its catalog entry, so that a changed table still tells what it was changed to.
ENTRY = "catalog_entry"


def resolved(diff: FleetDiff, src_types: DataFrame, tgt_types: DataFrame) -> FleetDiff:
    """The comparison with alias types resolved on both sides: going from an alias to its base type is no change to rows."""
    sides = [{**side, "columns": resolve_aliases(side["columns"], types)} for side, types in ((diff.src, src_types), (diff.tgt, tgt_types))]
    return FleetDiff(diff.pairs, *sides)


def column_work(diff: FleetDiff) -> DataFrame:
    """One row per column change of the plan, with the Spark type it leads to and the column's new catalog entry."""
    rows = diff.column_diff.withColumns({
        "change": F.expr(f"""case when outcome = 'added' then '{ADD}' when outcome = 'target_only' then if(changes > 0, '{DROP}', null)
            when s.is_computed or t.is_computed then '{RECOMPUTE}' when rewritten then '{RETYPE}'
            when not (s.default_definition <=> t.default_definition) then '{REDEFAULT}' end"""),
        "name": F.coalesce("t.name", "s.name"), "ordinal": F.coalesce("s.ordinal", "t.ordinal")})
    s = lambda f: F.col(f"s.{f}")
    return rows.where("change is not null").select(
        "pair_id", "obj_key", "change", "name", "ordinal", spark_type(s("type_name"), s("precision"), s("scale")).alias("kind"),
        text_limit(s("type_name"), s("max_length")).alias("limit"), (F.lower(s("type_name")) == "tinyint").alias("unsigned"),
        s("is_nullable").alias("nullable"), (~s("is_nullable") & F.coalesce("t.is_nullable", F.lit(False))).alias("becomes_not_null"),
        (F.col("s_type") != F.col("t_type")).alias("retyped"), s("default_definition").alias("default"), s("computed_definition").alias("computed"),
        F.coalesce("t.is_computed", F.lit(False)).alias("was_computed"),
        F.when(s("is_identity"), s("identity_seed")).alias("seed"), F.when(s("is_identity"), s("identity_increment")).alias("increment"),
        F.col("s").alias("entry"))


def key_work(diff: FleetDiff) -> DataFrame:
    """Keys, unique indexes and foreign keys that the plan adds: pair_id, obj_key, kind, name, columns, referenced, filter.

    A row's `kind` is PK, UQ, UX (unique index) or FK. What the plan adds without check (an untrusted foreign key) is left out.
    """
    added = diff.constraint_changes.where("outcome in ('added', 'changed')").select("pair_id", "obj_key", "kind_rank", F.upper("name").alias("item"))
    key = table_key(F.col("schema_name"), F.col("table_name")).alias("obj_key")
    plain = lambda cols: F.transform(F.filter(cols, lambda c: ~c["is_included"]), lambda c: c["name"])
    none, no_pairs = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    parts = [
        ("keys", 1, F.trim("type_code"), plain("columns"), none, no_pairs, none, F.lit(True)),
        ("indexes", 4, F.lit("UX"), plain("columns"), none, no_pairs, F.col("filter_definition"), F.col("is_unique")),
        ("foreign_keys", 3, F.lit("FK"), F.transform("columns", lambda c: c["parent_column"]),
         table_key(F.col("referenced_schema"), F.col("referenced_table")), F.transform("columns", lambda c: c["referenced_column"]), none, ~F.col("is_not_trusted")),
    ]
    found = None
    for relation, rank, kind, columns, referenced, others, condition, wanted in parts:
        if relation not in diff.src:
            continue
        rows = diff.src[relation].where(wanted).select(
            "pair_id", key, F.lit(rank).alias("kind_rank"), F.upper("name").alias("item"), "name", kind.alias("kind"), columns.alias("columns"),
            referenced.alias("referenced"), others.alias("referenced_columns"), condition.alias("filter"))
        found = rows if found is None else found.unionByName(rows)
    return found.join(added, ["pair_id", "obj_key", "kind_rank", "item"], "left_semi").drop("kind_rank", "item")


def literal_of(text: str) -> Column | None:
    """The value of a default that is a literal in any number of brackets; None where it is no literal."""
    inner = text.strip()
    while inner.startswith("(") and inner.endswith(")"):
        inner = inner[1:-1].strip()
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", inner):
        return F.lit(inner)
    if quoted := re.fullmatch(r"N?'((?:[^']|'')*)'", inner, re.DOTALL):
        return F.lit(quoted.group(1).replace("''", "'"))
    return F.lit(None) if inner.lower() == "null" else None


def _no_fit(value: Column, row) -> tuple[Column, Column | None]:
    """(does not fit, fits but loses digits) of a retyped column; text has no digits to lose."""
    lost, digits = [], None
    if row["kind"] in ("string", "binary"):
        text = value.cast(row["kind"])
        if row["limit"] is not None:
            size = F.octet_length(F.encode(text, "UTF-16BE")) if row["limit"]["unit"] == "utf16" else F.octet_length(text)
            lost.append(size > row["limit"]["most"] * (2 if row["limit"]["unit"] == "utf16" else 1))
    else:
        kept = value.try_cast(row["kind"])
        lost.append(value.isNotNull() & kept.isNull())
        if row["unsigned"]:
            lost.append((kept < 0) | (kept > 255))
        digits = F.coalesce(kept != value, F.lit(False))
    whole = F.lit(False)
    for bad in lost:
        whole = whole | F.coalesce(bad, F.lit(False))
    return whole, None if digits is None else digits & ~whole


@dataclass
class Work:
    """What the plan has to do to one table. `given` holds Spark columns for defaults and computed expressions by column name."""

    columns: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    given: dict[str, Column] = field(default_factory=dict)

    def _value(self, row) -> Column:
        if row["name"] in self.given:
            return self.given[row["name"]]
        value = literal_of(row["default"]) if row["change"] != RECOMPUTE and row["default"] is not None else None
        if value is None:
            raise ValueError(f"column {row['name']}: give a Spark column for {row['computed'] or row['default']}")
        return value

    def checks(self) -> dict[tuple[str, str], Column]:
        """Condition of an offending row by (column, check)."""
        out = {}
        for row in self.columns:
            name, change = row["name"], row["change"]
            value = F.col(f"`{name}`")
            if change == ADD and not row["nullable"] and row["seed"] is None and row["computed"] is None and row["default"] is None:
                out[name, "no_value"] = F.lit(True)
            elif change == DROP or (change == RECOMPUTE and not row["was_computed"]):
                out[name, "lost"] = value.isNotNull()
            elif change == RETYPE:
                if row["becomes_not_null"]:
                    out[name, "null"] = value.isNull()
                if row["retyped"]:
                    out[name, "does_not_fit"], digits = _no_fit(value, row)
                    if digits is not None:
                        out[name, "loses_digits"] = digits
        return out

    def preflight(self, df: DataFrame) -> DataFrame:
        """column_name, check, offending: every column check of the table in one aggregate over one scan."""
        checks = self.checks()
        kind = "array<struct<column_name: string, check: string, offending: bigint>>"
        if not checks:
            return df.sparkSession.createDataFrame([], "column_name string, `check` string, offending bigint")
        counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(checks.values())])
        entries = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check"), F.col(f"n{i}").alias("offending")) for i, (c, k) in enumerate(checks)]
        return counts.select(F.inline(F.array(*entries).cast(kind)))

    def evolve(self, df: DataFrame, order: list[str] = ()) -> DataFrame:
        """The table after the change, in one projection: retyped in place, dropped ones left out, recomputed and added ones last.

        `order` sorts the rows that an added identity column numbers.
        """
        by_name = {r["name"].upper(): r for r in self.columns}

        def named(value: Column, row, name: str) -> Column:
            entry = {k: v for k, v in row["entry"].asDict().items() if k not in ("name", "ordinal")}
            return value.cast(row["kind"]).alias(name, metadata={ENTRY: entry})
        kept = []
        for c in df.columns:
            row = by_name.get(c.upper())
            if row is None:
                kept.append(F.col(f"`{c}`"))
            elif row["change"] in (RETYPE, REDEFAULT):
                kept.append(named(F.col(f"`{c}`"), row, c))
        for row in sorted(self.columns, key=lambda r: (r["change"] == ADD, r["ordinal"])):
            if row["change"] == RECOMPUTE or (row["change"] == ADD and row["computed"] is not None):
                kept.append(named(self._value({**row.asDict(), "change": RECOMPUTE}), row, row["name"]))
            elif row["change"] == ADD and row["seed"] is None:
                value = F.lit(None) if row["nullable"] else self._value(row)
                kept.append(named(value, row, row["name"]))
        out = df.select(*kept)
        for row in self.columns:
            if row["change"] == ADD and row["seed"] is not None:
                out = R.add_identity(out, row["name"], list(order) or out.columns[:1], int(row["seed"]), int(row["increment"] or 1))
                out = out.select(*[F.col(f"`{c}`") for c in out.columns[:-1]], named(F.col(f"`{row['name']}`"), row, row["name"]))
        return out

    def key_checks(self, df: DataFrame, others: dict[str, DataFrame], where: dict[str, Column] | None = None,
                   ignore_case: tuple[str, ...] = ()) -> DataFrame:
        """name, kind, offending: key values that repeat (or are null in a primary key), and child values without a parent.

        `others` are the referenced tables by key; `where` the filters of filtered unique indexes, by name; a filtered one without is
        refused. `ignore_case` names text columns of a case-insensitive collation.
        """
        parts = []
        for row in self.keys:
            folded = tuple(c for c in row["columns"] if c in ignore_case)
            if row["kind"] == "FK":
                parent = others[row["referenced"]]
                found = R.check_fk(df, parent, dict(zip(row["columns"], row["referenced_columns"])), ignore_case=folded)
            else:
                if row["filter"] is not None and row["name"] not in (where or {}):
                    raise ValueError(f"index {row['name']}: give a Spark column for {row['filter']}")
                found = R.check_unique(df, row["columns"], (where or {}).get(row["name"]), row["kind"] == "PK", folded)
            parts.append(found.agg(F.count(F.lit(1)).alias("offending")).select(
                F.lit(row["name"]).alias("name"), F.lit(row["kind"]).alias("kind"), "offending"))
        if not parts:
            return df.sparkSession.createDataFrame([], "name string, kind string, offending bigint")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def work_of(pair_id: int, obj_key: str, columns: DataFrame, keys: DataFrame | None = None, given: dict[str, Column] | None = None) -> Work:
    """The work on one table of one pair. Its rows are as many as its columns and keys, so they come to the driver that plans its scan."""
    own = lambda df: df.where((F.col("pair_id") == pair_id) & (F.col("obj_key") == obj_key.upper())).collect()
    return Work(own(columns), own(keys) if keys is not None else [], given or {})


def describe(spark, pair_id: int, tables: dict[str, T.StructType], schema_name: str = "dbo") -> dict[str, DataFrame]:
    """Catalog relations (objects, columns) of Spark tables by name: what a table looks like to the comparison. A column's own
    entry (ENTRY) counts more than its Spark type, which knows no lengths."""
    objects = [{"pair_id": pair_id, "obj_type": TABLE, "schema_name": schema_name, "obj_name": n, "definition": "", "has_model": True} for n in tables]
    blank = {T.BooleanType: False, T.IntegerType: 0}
    columns = []
    for name, schema in tables.items():
        for i, f in enumerate(schema, 1):
            row = {k: blank.get(type(t)) for k, t in RELATION_FIELDS["columns"].items()}
            columns.append({**row, "pair_id": pair_id, "schema_name": schema_name, "table_name": name, "ordinal": i, "name": f.name,
                            "type_schema": "sys", "is_nullable": f.nullable, **described_type(f.dataType), **f.metadata.get(ENTRY, {})})
    return {"objects": spark.createDataFrame(objects, relation_schema("objects")), "columns": spark.createDataFrame(columns, relation_schema("columns"))}
