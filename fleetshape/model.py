"""Relations of the engine and the nested snapshot document.

Flat relations carry a scope column: `snapshot_id` when they describe one database, or
`pair_id` once they have been attached to one side of a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_COLUMN = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("key_ordinal", T.IntegerType()),
    T.StructField("is_descending", T.BooleanType()),
    T.StructField("is_included", T.BooleanType()),
    T.StructField("index_column_id", T.IntegerType()),
])

FK_COLUMN = T.StructType([
    T.StructField("parent_column", T.StringType()),
    T.StructField("referenced_column", T.StringType()),
])

# Field name -> type, in relation order, without the scope and table columns.
# max_length keeps the catalog convention: bytes, -1 meaning MAX.
COLUMN_FIELDS = {
    "ordinal": T.IntegerType(),
    "name": T.StringType(),
    "type_schema": T.StringType(),
    "type_name": T.StringType(),
    "is_user_defined": T.BooleanType(),
    "max_length": T.IntegerType(),
    "precision": T.IntegerType(),
    "scale": T.IntegerType(),
    "is_nullable": T.BooleanType(),
    "is_identity": T.BooleanType(),
    "is_computed": T.BooleanType(),
    "collation_name": T.StringType(),
    "is_row_guid": T.BooleanType(),
    "computed_definition": T.StringType(),
    "is_persisted": T.BooleanType(),
    "default_name": T.StringType(),
    "default_definition": T.StringType(),
    "default_is_system_named": T.BooleanType(),
    "identity_seed": T.StringType(),
    "identity_increment": T.StringType(),
}

KEY_FIELDS = {
    "ordinal": T.IntegerType(),
    "type_code": T.StringType(),
    "name": T.StringType(),
    "is_system_named": T.BooleanType(),
    "index_type_desc": T.StringType(),
    "columns": T.ArrayType(INDEX_COLUMN),
}

FK_FIELDS = {
    "ordinal": T.IntegerType(),
    "name": T.StringType(),
    "is_system_named": T.BooleanType(),
    "referenced_schema": T.StringType(),
    "referenced_table": T.StringType(),
    "delete_action": T.StringType(),
    "update_action": T.StringType(),
    "is_not_for_replication": T.BooleanType(),
    "is_not_trusted": T.BooleanType(),
    "is_disabled": T.BooleanType(),
    "columns": T.ArrayType(FK_COLUMN),
}

CHECK_FIELDS = {
    "ordinal": T.IntegerType(),
    "name": T.StringType(),
    "is_system_named": T.BooleanType(),
    "definition": T.StringType(),
    "is_not_trusted": T.BooleanType(),
    "is_disabled": T.BooleanType(),
}

INDEX_FIELDS = {
    "ordinal": T.IntegerType(),
    "name": T.StringType(),
    "is_unique": T.BooleanType(),
    "type_desc": T.StringType(),
    "filter_definition": T.StringType(),
    "is_disabled": T.BooleanType(),
    "columns": T.ArrayType(INDEX_COLUMN),
}

ALIAS_TYPE_FIELDS = {
    "schema_name": T.StringType(),
    "name": T.StringType(),
    "base_type_name": T.StringType(),
    "max_length": T.IntegerType(),
    "precision": T.IntegerType(),
    "scale": T.IntegerType(),
    "is_nullable": T.BooleanType(),
    "collation_name": T.StringType(),
}

OBJECT_FIELDS = {
    "obj_type": T.StringType(),
    "schema_name": T.StringType(),
    "obj_name": T.StringType(),
    "definition": T.StringType(),
    "has_model": T.BooleanType(),
}

TABLE_SCOPE = {"schema_name": T.StringType(), "table_name": T.StringType()}

RELATION_FIELDS = {
    "objects": OBJECT_FIELDS,
    "columns": {**TABLE_SCOPE, **COLUMN_FIELDS},
    "keys": {**TABLE_SCOPE, **KEY_FIELDS},
    "foreign_keys": {**TABLE_SCOPE, **FK_FIELDS},
    "checks": {**TABLE_SCOPE, **CHECK_FIELDS},
    "indexes": {**TABLE_SCOPE, **INDEX_FIELDS},
    "alias_types": ALIAS_TYPE_FIELDS,
    "dependencies": {"obj_key": T.StringType(), "dep_key": T.StringType()},
}


#: Fields that a document may leave empty; every other field has a default by its type.
OPTIONAL_FIELDS = {"collation_name", "computed_definition", "default_name", "default_definition", "identity_seed", "identity_increment",
                   "filter_definition"}


def with_default(field: str, dtype: T.DataType, value: Column) -> Column:
    """`value`, or what its field holds where a document says nothing: false, 0, '' or an empty list."""
    if field in OPTIONAL_FIELDS:
        return value
    empty = {T.BooleanType: F.lit(False), T.IntegerType: F.lit(0), T.StringType: F.lit("")}.get(type(dtype), F.array().cast(dtype))
    return F.coalesce(value, empty)


def relation_schema(name: str, scope: str = "pair_id") -> T.StructType:
    """Schema of one relation with its scope column in front."""
    fields = [T.StructField(scope, T.LongType())]
    fields += [T.StructField(n, t) for n, t in RELATION_FIELDS[name].items()]
    return T.StructType(fields)


# Object type names, fixed values.
TABLE, VIEW, PROCEDURE, FUNCTION = "Table", "View", "StoredProcedure", "Function"
OBJECT_TYPES = [TABLE, VIEW, PROCEDURE, FUNCTION]


def obj_key(obj_type: Column, schema: Column, name: Column) -> Column:
    """Case-insensitive identity of an object: `TYPE:SCHEMA.NAME`."""
    return F.upper(F.concat(obj_type, F.lit(":"), schema, F.lit("."), name))


def table_key(schema: Column, name: Column) -> Column:
    """`obj_key` of a table."""
    return obj_key(F.lit(TABLE), schema, name)


def identifier(schema: Column, name: Column) -> Column:
    """Display form `[schema].[name]`; brackets inside a name stay as they are."""
    return F.concat(F.lit("["), schema, F.lit("].["), name, F.lit("]"))
