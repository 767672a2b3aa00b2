"""Expressions over programmable objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetshape.model import FUNCTION, PROCEDURE, TABLE, VIEW

# Catalog type codes, fixed values.
MODULE_CODES = ["V", "P", "FN", "IF", "TF", "FS", "FT"]
FUNCTION_CODES = ["FN", "IF", "TF", "FS", "FT"]

# Whitespace, line comments and (non-nesting) block comments in front of a keyword.
# Possessive throughout: a long comment header must not grow the regex stack.
_TRIVIA = r"(?:\s++|--[^\n]*+(?:\n|$)|/\*(?:[^*]++|\*(?!/))*+\*/)*+"
_CREATE = rf"(?isU)^({_TRIVIA}create)(?=\s)(?!{_TRIVIA}or)"


def to_create_or_alter(definition: Column) -> Column:
    """The leading CREATE becomes CREATE OR ALTER; anything else is left as it is."""
    return F.regexp_replace(definition, _CREATE, "$1 OR ALTER")


def object_type(code: Column) -> Column:
    """Catalog type code (char(2), padded) to object type; an unknown code fails the job."""
    trimmed = F.trim(code)
    return (
        F.when(trimmed == "U", TABLE)
        .when(trimmed == "V", VIEW)
        .when(trimmed == "P", PROCEDURE)
        .when(trimmed.isin(FUNCTION_CODES), FUNCTION)
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported SQL object type code: "), trimmed)).cast("string"))
    )


def create_rank(obj_type: Column) -> Column:
    """Creation order by type: tables, functions, views, procedures."""
    return (
        F.when(obj_type == TABLE, 0).when(obj_type == FUNCTION, 1)
        .when(obj_type == VIEW, 2).when(obj_type == PROCEDURE, 3).otherwise(99)
    )


def drop_rank(obj_type: Column) -> Column:
    """Drop order by type: views, procedures, functions, tables."""
    return (
        F.when(obj_type == VIEW, 0).when(obj_type == PROCEDURE, 1)
        .when(obj_type == FUNCTION, 2).when(obj_type == TABLE, 3).otherwise(99)
    )


def drop_object(obj_type: Column, ident: Column) -> Column:
    """Guarded DROP of an object."""
    keyword = (
        F.when(obj_type == TABLE, "TABLE").when(obj_type == VIEW, "VIEW")
        .when(obj_type == PROCEDURE, "PROCEDURE").when(obj_type == FUNCTION, "FUNCTION")
    )
    return F.concat(
        F.lit("IF OBJECT_ID(N'"), ident, F.lit("') IS NOT NULL\n    DROP "), keyword, F.lit(" "), ident, F.lit(";")
    )
