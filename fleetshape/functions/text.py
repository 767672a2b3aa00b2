"""Text expressions shared by comparison and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """Whitespace runs to one space, trimmed, upper-cased; null and blank become ''."""
    return F.coalesce(F.upper(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit(""))


def text_digest(c: Column) -> Column:
    """SHA-256 of the normalised text: lets a comparison shuffle 32 bytes, not a module body."""
    return F.unhex(F.sha2(normalize_text(c), 256))


def is_blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*$")


def quote(c: Column) -> Column:
    """Bracket-quoted identifier."""
    return F.concat(F.lit("["), F.replace(c, F.lit("]"), F.lit("]]")), F.lit("]"))


def quote2(schema: Column, name: Column) -> Column:
    """`[schema].[name]` with both parts escaped."""
    return F.concat(quote(schema), F.lit("."), quote(name))


def literal(c: Column) -> Column:
    """Text made safe inside a single-quoted literal."""
    return F.replace(c, F.lit("'"), F.lit("''"))


def same_ci(a: Column, b: Column) -> Column:
    """Null-safe equality ignoring case."""
    return F.upper(a).eqNullSafe(F.upper(b))


def trim_ws(c: Column) -> Column:
    """Both-side trim of any whitespace, newlines included."""
    return F.regexp_replace(c, r"(?U)^\s++|\s+$", "")


def rtrim_ws(c: Column) -> Column:
    """Right trim of any whitespace, newlines included."""
    return F.regexp_replace(c, r"(?U)\s+$", "")
