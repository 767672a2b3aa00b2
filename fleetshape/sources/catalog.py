"""Catalog-view dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Views the assembly reads, fixed values.
CATALOG_VIEWS = [
    "sys_schemas", "sys_types", "sys_tables", "sys_columns", "sys_computed_columns", "sys_default_constraints",
    "sys_identity_columns", "sys_indexes", "sys_index_columns", "sys_key_constraints", "sys_foreign_keys",
    "sys_foreign_key_columns", "sys_check_constraints", "sys_objects", "sys_sql_modules", "sys_sql_expression_dependencies",
]


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Dumps of the catalog views, one Parquet folder each; every row carries its `snapshot_id`."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in CATALOG_VIEWS}
