"""Described column types and the Spark types that hold their values.

The catalog names types of the described server; row-level work needs to know which Spark type a column
is read and written as, and which values of that type it cannot hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark type of the types without facets. The smallest integer is unsigned, so it needs the next larger one.
PLAIN_TYPES = {
    "bit": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint",
    "real": "float", "float": "double", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)",
    "date": "date", "smalldatetime": "timestamp_ntz", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "datetimeoffset": "timestamp",
    "rowversion": "binary", "timestamp": "binary", "image": "binary",
}
DECIMALS, BYTE_TEXT, WIDE_TEXT, BYTES = ("decimal", "numeric"), ("varchar", "char"), ("nvarchar", "nchar", "sysname"), ("varbinary", "binary")


def spark_type(name: Column, precision: Column, scale: Column) -> Column:
    """DDL of the Spark type for a described type; types this does not know are read as text."""
    known = F.create_map(*[F.lit(x) for pair in PLAIN_TYPES.items() for x in pair])
    low = F.lower(name)
    return (
        F.when(low.isin(*DECIMALS), F.concat(F.lit("decimal("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when(low.isin(*BYTES), "binary").otherwise(F.coalesce(known[low], F.lit("string")))
    )


def text_limit(name: Column, max_length: Column) -> Column:
    """Struct (unit, most) of what a text or binary type holds; null where there is no bound."""
    low = F.lower(name)
    unit = F.when(low.isin(*WIDE_TEXT), "utf16").when(low.isin(*BYTE_TEXT, *BYTES), "bytes")
    most = F.when(low.isin(*WIDE_TEXT), F.expr("1") * F.floor(max_length / 2)).otherwise(max_length).cast("int")
    return F.when(unit.isNotNull() & (max_length >= 0), F.struct(unit.alias("unit"), most.alias("most")))


def resolve_aliases(columns: DataFrame, alias_types: DataFrame, scope: str = "pair_id") -> DataFrame:
    """`columns` with alias types replaced by what they stand for. An alias nobody declares keeps its own name, hence reads as text.

    The base type's facets are those of the alias; a column cannot change them. Its collation is the column's own.
    """
    facets = ("max_length", "precision", "scale")
    known = alias_types.select(
        scope, F.upper("schema_name").alias("__schema"), F.upper("name").alias("__name"), F.col("base_type_name").alias("__base"),
        *[F.col(f).alias(f"__{f}") for f in facets]).dropDuplicates([scope, "__schema", "__name"])
    keyed = columns.withColumns({"__schema": F.upper("type_schema"), "__name": F.when(F.col("is_user_defined"), F.upper("type_name"))})
    found = keyed.join(known, [scope, "__schema", "__name"], "left")
    hit = F.col("__base").isNotNull()
    return found.withColumns({
        "type_name": F.coalesce("__base", "type_name"), "is_user_defined": F.col("is_user_defined") & ~hit,
        **{f: F.coalesce(f"__{f}", f) for f in facets},
    }).select(*columns.columns)


def described_type(dtype: T.DataType) -> dict[str, object]:
    """Type facets under which a Spark column enters a catalog; text and binary have no bound."""
    if isinstance(dtype, T.DecimalType):
        return {"type_name": "decimal", "max_length": 17, "precision": dtype.precision, "scale": dtype.scale}
    names = {T.BooleanType: ("bit", 1), T.ByteType: ("smallint", 2), T.ShortType: ("smallint", 2), T.IntegerType: ("int", 4), T.LongType: ("bigint", 8),
             T.FloatType: ("real", 4), T.DoubleType: ("float", 8), T.DateType: ("date", 3), T.TimestampNTZType: ("datetime2", 8),
             T.TimestampType: ("datetimeoffset", 10), T.BinaryType: ("varbinary", -1)}
    name, length = names.get(type(dtype), ("nvarchar", -1))
    return {"type_name": name, "max_length": length, "precision": 0, "scale": 7 if "time" in name else 0}
