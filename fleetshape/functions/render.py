"""Statement text built from catalog rows, as column expressions.

`row` arguments are accessors: a function from a field name to the Column holding it, so
the same expression serves a flat relation and a struct (`fields("s")`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetshape.functions.text import is_blank, literal, quote, quote2

Row = Callable[[str], Column]

# Required session options in front of every script; fixed value.
SESSION_PREAMBLE = "SET ANSI_NULLS ON;\r\nSET QUOTED_IDENTIFIER ON;"

# Types that carry a length in bytes, a length in characters, precision+scale, or a scale; fixed values.
BYTE_LENGTH_TYPES = ["varchar", "char", "varbinary", "binary"]
CHAR_LENGTH_TYPES = ["nvarchar", "nchar"]
PRECISE_TYPES = ["decimal", "numeric"]
SCALED_TYPES = ["datetime2", "datetimeoffset", "time"]


def fields(struct: str | None = None) -> Row:
    """Accessor over the fields of a struct column, or over top-level columns."""
    return lambda name: F.col(f"{struct}.{name}" if struct else name)


def type_text(name: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """System type with its facets."""
    kind = F.lower(name)

    def length(value: Column) -> Column:
        return F.when(max_length == -1, "MAX").otherwise(value.cast("string"))

    return (
        F.when(kind.isin(BYTE_LENGTH_TYPES), F.concat(name, F.lit("("), length(max_length), F.lit(")")))
        .when(kind.isin(CHAR_LENGTH_TYPES),
              F.concat(name, F.lit("("), length(F.call_function("div", max_length, F.lit(2))), F.lit(")")))
        .when(kind.isin(PRECISE_TYPES),
              F.concat(name, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when(kind.isin(SCALED_TYPES), F.concat(name, F.lit("("), scale.cast("string"), F.lit(")")))
        .otherwise(name)
    )


def column_type(row: Row) -> Column:
    """Type of a column; an alias type is its quoted name and nothing else."""
    return F.when(row("is_user_defined"), quote2(row("type_schema"), row("type_name"))).otherwise(
        type_text(row("type_name"), row("max_length"), row("precision"), row("scale"))
    )


def collate_clause(row: Row) -> Column:
    """COLLATE, never restated for an alias type."""
    wanted = ~is_blank(row("collation_name")) & ~row("is_user_defined")
    return F.when(wanted, F.concat(F.lit(" COLLATE "), row("collation_name"))).otherwise("")


def null_clause(row: Row) -> Column:
    return F.when(row("is_nullable"), " NULL").otherwise(" NOT NULL")


def name_clause(name: Column, is_system_named: Column) -> Column:
    """CONSTRAINT clause; nothing when the server chose the name."""
    return F.when(is_system_named | is_blank(name), "").otherwise(F.concat(F.lit(" CONSTRAINT "), quote(name)))


def column_definition(row: Row) -> Column:
    """Column as it stands in CREATE TABLE or ADD."""
    def or_one(c: Column) -> Column:
        return F.when(is_blank(c), "1").otherwise(c)

    identity = F.when(
        row("is_identity"),
        F.concat(F.lit(" IDENTITY("), or_one(row("identity_seed")), F.lit(","),
                 or_one(row("identity_increment")), F.lit(")")),
    ).otherwise("")
    default = F.when(
        ~is_blank(row("default_definition")),
        F.concat(name_clause(row("default_name"), row("default_is_system_named")),
                 F.lit(" DEFAULT "), row("default_definition")),
    ).otherwise("")
    stored = F.concat(
        quote(row("name")), F.lit(" "), column_type(row), collate_clause(row), identity,
        F.when(row("is_row_guid"), " ROWGUIDCOL").otherwise(""), null_clause(row), default,
    )
    computed = F.concat(
        quote(row("name")), F.lit(" AS "), F.coalesce(row("computed_definition"), F.lit("")),
        F.when(row("is_persisted"), " PERSISTED").otherwise(""),
    )
    return F.when(row("is_computed"), computed).otherwise(stored)


def index_column(c: Column) -> Column:
    """One index column: name with direction, or the bare name when included."""
    direction = F.when(c["is_descending"], " DESC").otherwise(" ASC")
    return F.when(c["is_included"], quote(c["name"])).otherwise(F.concat(quote(c["name"]), direction))


def is_clustered(desc: Column) -> Column:
    """Whole-word test: NONCLUSTERED contains CLUSTERED."""
    return F.coalesce(F.upper(F.trim(desc)) == "CLUSTERED", F.lit(False))


def ref_action(desc: Column) -> Column:
    """Referential action keyword; null when none is to be written."""
    kind = F.upper(desc)
    return F.when(kind == "CASCADE", "CASCADE").when(kind == "SET_NULL", "SET NULL").when(
        kind == "SET_DEFAULT", "SET DEFAULT")


def check_mode(row: Row) -> Column:
    return F.when(row("is_not_trusted"), "WITH NOCHECK").otherwise("WITH CHECK")


# Statements about a table are kept as (head, tail) around its identifier: which table name
# is written is known only after the two sides are matched.

def around(parts: tuple[Column, Column], table: Column) -> Column:
    return F.concat(parts[0], table, parts[1])


def key_add(row: Row) -> tuple[Column, Column]:
    """ADD of a primary key or unique constraint."""
    kind = F.when(row("type_code") == "PK", "PRIMARY KEY").otherwise("UNIQUE")
    clustered = F.when(is_clustered(row("index_type_desc")), "CLUSTERED").otherwise("NONCLUSTERED")
    columns = F.array_join(F.transform(row("columns"), index_column), ", ")
    return F.lit("ALTER TABLE "), F.concat(
        F.lit(" ADD"), name_clause(row("name"), row("is_system_named")), F.lit(" "), kind, F.lit(" "), clustered,
        F.lit(" ("), columns, F.lit(");"))


def fk_add(row: Row) -> tuple[Column, Column]:
    """ADD of a foreign key."""
    def on(event: str, action: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f" ON {event} "), ref_action(action)), F.lit(""))

    def names(part: str) -> Column:
        return F.array_join(F.transform(row("columns"), lambda c: quote(c[part])), ", ")

    return F.lit("ALTER TABLE "), F.concat(
        F.lit(" "), check_mode(row), F.lit(" ADD"), name_clause(row("name"), row("is_system_named")),
        F.lit(" FOREIGN KEY ("), names("parent_column"), F.lit(") REFERENCES "),
        quote2(row("referenced_schema"), row("referenced_table")), F.lit(" ("), names("referenced_column"), F.lit(")"),
        on("DELETE", row("delete_action")), on("UPDATE", row("update_action")),
        F.when(row("is_not_for_replication"), " NOT FOR REPLICATION").otherwise(""), F.lit(";"))


def check_add(row: Row) -> tuple[Column, Column]:
    """ADD of a check constraint."""
    return F.lit("ALTER TABLE "), F.concat(
        F.lit(" "), check_mode(row), F.lit(" ADD"), name_clause(row("name"), row("is_system_named")),
        F.lit(" CHECK "), row("definition"), F.lit(";"))


def index_create(row: Row) -> tuple[Column, Column]:
    """CREATE INDEX with key, included and filter parts."""
    included = F.filter(row("columns"), lambda c: c["is_included"])
    keys = F.transform(F.filter(row("columns"), lambda c: ~c["is_included"]), index_column)
    head = F.concat(
        F.lit("CREATE "), F.when(row("is_unique"), "UNIQUE ").otherwise(""),
        F.replace(row("type_desc"), F.lit("_"), F.lit(" ")), F.lit(" INDEX "), quote(row("name")), F.lit(" ON "))
    tail = F.concat(
        F.lit(" ("), F.array_join(keys, ", "), F.lit(")"),
        F.when(F.size(included) > 0,
               F.concat(F.lit(" INCLUDE ("), F.array_join(F.transform(included, index_column), ", "), F.lit(")"))
               ).otherwise(""),
        F.when(~is_blank(row("filter_definition")), F.concat(F.lit(" WHERE "), row("filter_definition"))).otherwise(""),
        F.lit(";"))
    return head, tail


def index_drop(name: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("DROP INDEX "), quote(name), F.lit(" ON ")), F.lit(";")


def constraint_drop(name: Column) -> tuple[Column, Column]:
    return F.lit("ALTER TABLE "), F.concat(F.lit(" DROP CONSTRAINT "), quote(name), F.lit(";"))


def alter_column(table: Column, row: Row, type_sql: Column) -> Column:
    """ALTER COLUMN to the type, collation and nullability of `row`."""
    return F.concat(F.lit("ALTER TABLE "), table, F.lit(" ALTER COLUMN "), quote(row("name")), F.lit(" "),
                    type_sql, collate_clause(row), null_clause(row), F.lit(";"))


def add_column_stmt(table: Column, row: Row) -> Column:
    return F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD "), column_definition(row), F.lit(";"))


def drop_column_stmt(table: Column, name: Column) -> Column:
    return F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP COLUMN "), quote(name), F.lit(";"))


def add_default_stmt(table: Column, row: Row) -> Column:
    named = F.ltrim(name_clause(row("default_name"), row("default_is_system_named")))
    prefix = F.when(named == "", "").otherwise(F.concat(named, F.lit(" ")))
    return F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD "), prefix, F.lit("DEFAULT "),
                    row("default_definition"), F.lit(" FOR "), quote(row("name")), F.lit(";"))


def create_schema(schema: Column) -> Column:
    """Guarded CREATE SCHEMA, inside EXEC so it may follow IF."""
    return F.concat(F.lit("IF SCHEMA_ID(N'"), literal(schema), F.lit("') IS NULL\n    EXEC(N'CREATE SCHEMA "),
                    literal(quote(schema)), F.lit("');"))


def create_type(row: Row) -> Column:
    """Guarded CREATE TYPE of an alias type."""
    base = type_text(row("base_type_name"), row("max_length"), row("precision"), row("scale"))
    return F.concat(
        F.lit("IF TYPE_ID(N'"), literal(row("schema_name")), F.lit("."), literal(row("name")),
        F.lit("') IS NULL\n    CREATE TYPE "), quote2(row("schema_name"), row("name")), F.lit(" FROM "), base,
        null_clause(row), F.lit(";"))
