"""Assembly of raw catalog views into the engine's relations, for all snapshots at once.

Every view carries `snapshot_id`; columns are named as in the catalog, except `precision`,
which a dump may also call `prec`. Small per-database views (schemas, types) are joined on
`(snapshot_id, id)`; a database that owns a large share of the rows is split by AQE's
skew join, which `session.SESSION_CONF` forces on. `by_database` moves every view once, to its
database, where no database is too large for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetshape.functions import messages
from fleetshape.functions.modules import MODULE_CODES, object_type
from fleetshape.functions.text import trim_ws
from fleetshape.model import TABLE, identifier, obj_key
from fleetshape.operators.matching import union_all
from fleetshape.session import together

Catalog = dict[str, DataFrame]

#: Tables of one database up to which a task holds its whole catalog; tables that a partition of whole databases holds on average.
TOGETHER, PER_PARTITION, LEAST_PARTITIONS = 50_000, 15_000, 16
#: Views of tables, of what tables have, and of references; modules, whose text is large and may sit in few databases, stay where they are.
OF_DATABASE = {
    "sys_schemas", "sys_types", "sys_tables", "sys_columns", "sys_computed_columns", "sys_default_constraints", "sys_identity_columns", "sys_indexes",
    "sys_index_columns", "sys_key_constraints", "sys_foreign_keys", "sys_foreign_key_columns", "sys_check_constraints",
    "sys_sql_expression_dependencies"}


class _ByDatabase(dict):
    """The views of a catalog, those of tables with all rows of a database in one partition."""

    def __init__(self, cat: Catalog):
        self.load = lambda name: cat[name].repartition("snapshot_id") if name in OF_DATABASE else cat[name]

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.load(name)
        return self[name]


@contextmanager
def by_database(cat: Catalog) -> Iterator[Catalog]:
    """`cat` with each view moved once, to its database: what is executed within needs no other exchange to join or number its rows.

    A task then holds whole databases; where one has more than `TOGETHER` tables `cat` stays as it is, and is joined on each view's keys.
    """
    sizes = cat["sys_tables"].groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    largest, whole = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if largest > TOGETHER:
        yield cat
        return
    with together(sizes.sparkSession, max(LEAST_PARTITIONS, whole // PER_PARTITION)):
        yield _ByDatabase(cat)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _precision(df: DataFrame) -> Column:
    return F.col("precision" if "precision" in df.columns else "prec").cast("int")


def user_tables(cat: Catalog) -> DataFrame:
    """User tables with their schema name and temporal type."""
    shipped = cat["sys_tables"].where(~F.col("is_ms_shipped")).select(
        "snapshot_id", "object_id", "schema_id", F.col("name").alias("table_name"), "temporal_type")
    return shipped.join(_schema_names(cat), ["snapshot_id", "schema_id"]).drop("schema_id")


def _schema_names(cat: Catalog, alias: str = "schema_name") -> DataFrame:
    return cat["sys_schemas"].select("snapshot_id", "schema_id", F.col("name").alias(alias))


def captured_tables(tables: DataFrame) -> DataFrame:
    """History tables are left to the server; everything else is captured."""
    return tables.where(~F.col("temporal_type").eqNullSafe(1))


def temporal_notices(tables: DataFrame) -> DataFrame:
    ident = identifier(F.col("schema_name"), F.col("table_name"))
    return tables.where(F.col("temporal_type").isin(1, 2)).select(
        "snapshot_id",
        F.when(F.col("temporal_type") == 1, messages.history_skipped(ident)).otherwise(messages.versioned(ident)).alias("notice"))


def _table_ids(cat: Catalog) -> DataFrame:
    return cat["sys_tables"].where(~F.col("is_ms_shipped")).select("snapshot_id", "object_id")


def _of_user_tables(rows: DataFrame, cat: Catalog, every: bool) -> DataFrame:
    """Rows of user tables; with `every` those of other tables stay, for callers that join the tables they want."""
    return rows if every else rows.join(_table_ids(cat), ["snapshot_id", "object_id"], "left_semi")


def _of_captured(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Child rows given the schema and name of their captured table."""
    names = captured_tables(tables).select("snapshot_id", "object_id", "schema_name", "table_name")
    return rows.join(names, ["snapshot_id", "object_id"])


def assemble_columns(cat: Catalog, every: bool = False) -> DataFrame:
    """Columns with type names, computed text, defaults and identity; absent parts become null or false."""
    types = cat["sys_types"].select("snapshot_id", "user_type_id", "schema_id", F.col("name").alias("type_name"),
                                    F.col("is_user_defined"))
    types = types.join(_schema_names(cat, "type_schema"), ["snapshot_id", "schema_id"]).drop("schema_id")
    computed = cat["sys_computed_columns"].select(
        "snapshot_id", "object_id", "column_id", F.col("definition").alias("computed_definition"), "is_persisted")
    defaults = cat["sys_default_constraints"].select(
        "snapshot_id", F.col("object_id").alias("default_object_id"), F.col("name").alias("default_name"),
        F.col("definition").alias("default_definition"), F.col("is_system_named").alias("default_is_system_named"))
    identity = cat["sys_identity_columns"].select(
        "snapshot_id", "object_id", "column_id", F.col("seed_value").cast("string").alias("identity_seed"),
        F.col("increment_value").cast("string").alias("identity_increment"))
    columns = cat["sys_columns"]
    return (
        _of_user_tables(columns, cat, every)
        .join(computed, ["snapshot_id", "object_id", "column_id"], "left")
        .join(identity, ["snapshot_id", "object_id", "column_id"], "left")
        .join(types, ["snapshot_id", "user_type_id"])
        .join(defaults, ["snapshot_id", "default_object_id"], "left")
        .select(
            "snapshot_id", "object_id", F.col("column_id").cast("int").alias("ordinal"), "name", "type_schema", "type_name",
            "is_user_defined", F.col("max_length").cast("int").alias("max_length"), _precision(columns).alias("precision"),
            F.col("scale").cast("int").alias("scale"), "is_nullable", "is_identity", "is_computed", "collation_name",
            F.col("is_rowguidcol").alias("is_row_guid"), "computed_definition", _flag(F.col("is_persisted")).alias("is_persisted"),
            "default_name", "default_definition", _flag(F.col("default_is_system_named")).alias("default_is_system_named"),
            "identity_seed", "identity_increment")
    )


def index_columns(cat: Catalog, every: bool = False) -> DataFrame:
    """Ordered column list of every index: keys by ordinal, then included columns."""
    names = cat["sys_columns"].select("snapshot_id", "object_id", "column_id", "name")
    rows = (
        _of_user_tables(cat["sys_index_columns"], cat, every)
        .join(names, ["snapshot_id", "object_id", "column_id"])
    )
    entry = F.struct(
        F.col("is_included_column").alias("o1"), F.col("key_ordinal").cast("int").alias("o2"),
        F.col("index_column_id").cast("int").alias("o3"),
        F.struct("name", F.col("key_ordinal").cast("int").alias("key_ordinal"),
                 F.col("is_descending_key").alias("is_descending"), F.col("is_included_column").alias("is_included"),
                 F.col("index_column_id").cast("int").alias("index_column_id")).alias("c"))
    return rows.groupBy("snapshot_id", "object_id", "index_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("columns"))


def _no_columns() -> Column:
    return F.array().cast("array<struct<name:string,key_ordinal:int,is_descending:boolean,is_included:boolean,index_column_id:int>>")


def assemble_keys(cat: Catalog, index_cols: DataFrame, every: bool = False) -> DataFrame:
    """Primary keys and unique constraints with their key columns; primary keys first."""
    indexes = cat["sys_indexes"].select("snapshot_id", "object_id", "index_id", F.col("type_desc").alias("index_type_desc"))
    keys = cat["sys_key_constraints"].select(
        "snapshot_id", F.col("parent_object_id").alias("object_id"), "name", F.rtrim("type").alias("type_code"),
        F.col("unique_index_id").alias("index_id"), "is_system_named")
    return (
        _of_user_tables(keys, cat, every)
        .join(indexes, ["snapshot_id", "object_id", "index_id"])
        .join(index_cols, ["snapshot_id", "object_id", "index_id"], "left")
        .withColumn("columns", F.filter(F.coalesce("columns", _no_columns()), lambda c: ~c["is_included"]))
        .withColumn("order_key", F.struct(F.when(F.col("type_code") == "PK", 0).otherwise(1), "name"))
        .drop("index_id")
    )


def fk_columns(cat: Catalog) -> DataFrame:
    """Ordered column pairs of every foreign key."""
    names = cat["sys_columns"].select("snapshot_id", "object_id", "column_id", "name")
    parent = names.select("snapshot_id", F.col("object_id").alias("parent_object_id"),
                          F.col("column_id").alias("parent_column_id"), F.col("name").alias("parent_column"))
    referenced = names.select("snapshot_id", F.col("object_id").alias("referenced_object_id"),
                              F.col("column_id").alias("referenced_column_id"), F.col("name").alias("referenced_column"))
    entry = F.struct("constraint_column_id", F.struct("parent_column", "referenced_column").alias("c"))
    return (
        cat["sys_foreign_key_columns"]
        .join(parent, ["snapshot_id", "parent_object_id", "parent_column_id"])
        .join(referenced, ["snapshot_id", "referenced_object_id", "referenced_column_id"])
        .groupBy("snapshot_id", F.col("constraint_object_id").alias("fk_object_id"))
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("columns"))
    )


def assemble_fks(cat: Catalog, fk_cols: DataFrame, every: bool = False) -> DataFrame:
    """Foreign keys with the name of the referenced table and their column pairs."""
    referenced = cat["sys_tables"].select("snapshot_id", F.col("object_id").alias("referenced_object_id"), "schema_id",
                                          F.col("name").alias("referenced_table"))
    referenced = referenced.join(_schema_names(cat, "referenced_schema"), ["snapshot_id", "schema_id"]).drop("schema_id")
    fks = cat["sys_foreign_keys"].withColumnsRenamed({
        "object_id": "fk_object_id", "parent_object_id": "object_id",
        "delete_referential_action_desc": "delete_action", "update_referential_action_desc": "update_action"})
    return (
        _of_user_tables(fks, cat, every)
        .join(referenced, ["snapshot_id", "referenced_object_id"])
        .join(fk_cols, ["snapshot_id", "fk_object_id"], "left")
        .withColumn("columns", F.coalesce("columns", F.array().cast("array<struct<parent_column:string,referenced_column:string>>")))
        .withColumn("order_key", F.struct("name")).drop("fk_object_id", "referenced_object_id")
    )


def assemble_checks(cat: Catalog, every: bool = False) -> DataFrame:
    checks = cat["sys_check_constraints"].withColumnRenamed("parent_object_id", "object_id")
    return _of_user_tables(checks, cat, every).withColumn("order_key", F.struct("name"))


def _candidate_indexes(cat: Catalog, every: bool = False) -> DataFrame:
    wanted = (~F.col("is_hypothetical") & F.col("name").isNotNull()
              & ~F.col("is_primary_key") & ~F.col("is_unique_constraint"))
    return _of_user_tables(cat["sys_indexes"].where(wanted), cat, every)


def select_indexes(cat: Catalog, index_cols: DataFrame, every: bool = False) -> DataFrame:
    """Rowstore indexes that stand on their own, with their columns."""
    return (
        _candidate_indexes(cat, every).where(F.col("type").isin(1, 2))
        .join(index_cols, ["snapshot_id", "object_id", "index_id"], "left")
        .select("snapshot_id", "object_id", "name", "is_unique", "type_desc", "filter_definition", "is_disabled",
                F.coalesce("columns", _no_columns()).alias("columns"), F.struct("name").alias("order_key"))
    )


def index_notices(cat: Catalog, tables: DataFrame) -> DataFrame:
    """Indexes of kinds that cannot be scripted are reported, never lost silently."""
    ident = identifier(F.col("schema_name"), F.col("table_name"))
    return (
        _candidate_indexes(cat).where(~F.col("type").isin(1, 2)).join(tables, ["snapshot_id", "object_id"])
        .select("snapshot_id", messages.index_skipped(F.col("name"), ident, F.col("type_desc")).alias("notice"))
    )


def alias_types(cat: Catalog) -> DataFrame:
    """User-defined alias types with the name of their base type."""
    base = cat["sys_types"].where(~F.col("is_user_defined")).select(
        "snapshot_id", F.col("user_type_id").alias("system_type_id"), F.col("name").alias("base_type_name"))
    types = cat["sys_types"]
    alias = types.where(F.col("is_user_defined") & ~F.col("is_table_type") & ~F.col("is_assembly_type"))
    return (
        alias.join(base, ["snapshot_id", "system_type_id"]).join(_schema_names(cat), ["snapshot_id", "schema_id"])
        .select("snapshot_id", "schema_name", "name", "base_type_name", F.col("max_length").cast("int").alias("max_length"),
                _precision(types).alias("precision"), F.col("scale").cast("int").alias("scale"), "is_nullable", "collation_name")
    )


def used_alias_types(types: DataFrame, columns: DataFrame) -> DataFrame:
    """Alias types some captured column uses, compared ignoring case."""
    used = columns.where("is_user_defined").select(
        "snapshot_id", F.upper("type_schema").alias("k1"), F.upper("type_name").alias("k2")).distinct()
    keyed = types.withColumns({"k1": F.upper("schema_name"), "k2": F.upper("name")})
    return keyed.join(used, ["snapshot_id", "k1", "k2"], "left_semi").drop("k1", "k2")


def assemble_modules(cat: Catalog) -> DataFrame:
    """Views, procedures and functions with their trimmed text."""
    objects = cat["sys_objects"].where(~F.col("is_ms_shipped") & F.trim("type").isin(MODULE_CODES)).select(
        "snapshot_id", "object_id", "schema_id", object_type(F.col("type")).alias("obj_type"), F.col("name").alias("obj_name"))
    return (
        objects.join(cat["sys_sql_modules"].select("snapshot_id", "object_id", "definition"), ["snapshot_id", "object_id"])
        .join(_schema_names(cat), ["snapshot_id", "schema_id"])
        .select("snapshot_id", "object_id", "obj_type", "schema_name", "obj_name", trim_ws(F.col("definition")).alias("definition"),
                F.lit(False).alias("has_model"))
    )


def module_deps(cat: Catalog) -> DataFrame:
    """Distinct edges from a module to the object it references."""
    own = ~F.col("is_ms_shipped")
    modules = cat["sys_objects"].where(own & F.trim("type").isin(MODULE_CODES)).select(
        "snapshot_id", F.col("object_id").alias("referencing_id"), object_type(F.col("type")).alias("t"), "schema_id", "name")
    referenced = cat["sys_objects"].where(own & F.trim("type").isin(["U", *MODULE_CODES])).select(
        "snapshot_id", F.col("object_id").alias("referenced_id"), "schema_id", object_type(F.col("type")).alias("t"), "name")
    schemas = _schema_names(cat)

    def keyed(objects: DataFrame, id_col: str, key: str) -> DataFrame:
        return objects.join(schemas, ["snapshot_id", "schema_id"]).select(
            "snapshot_id", id_col, obj_key(F.col("t"), F.col("schema_name"), F.col("name")).alias(key))

    return (
        cat["sys_sql_expression_dependencies"].where("referenced_id is not null")
        .join(keyed(referenced, "referenced_id", "dep_key"), ["snapshot_id", "referenced_id"])
        .join(keyed(modules, "referencing_id", "obj_key"), ["snapshot_id", "referencing_id"])
        .select("snapshot_id", "obj_key", "dep_key").distinct()
    )


def table_deps(foreign_keys: DataFrame, scope: str = "snapshot_id") -> DataFrame:
    """Distinct edges from a table to the tables its foreign keys reference."""
    return foreign_keys.select(
        scope, obj_key(F.lit(TABLE), F.col("schema_name"), F.col("table_name")).alias("obj_key"),
        obj_key(F.lit(TABLE), F.col("referenced_schema"), F.col("referenced_table")).alias("dep_key")).distinct()


def _ordinal(rows: DataFrame) -> DataFrame:
    """Place of a child among its table's children, from its order key; groups are one table's children."""
    place = F.row_number().over(Window.partitionBy("snapshot_id", "object_id").orderBy("order_key"))
    return rows.withColumn("ordinal", place).drop("order_key")


def assemble_objects(cat: Catalog) -> DataFrame:
    """Captured tables and modules; no view of columns, indexes or constraints is read."""
    modules = assemble_modules(cat).drop("object_id")
    return captured_tables(user_tables(cat)).select(
        "snapshot_id", F.lit(TABLE).alias("obj_type"), "schema_name", F.col("table_name").alias("obj_name"),
        F.lit(None).cast("string").alias("definition"), F.lit(True).alias("has_model")).unionByName(modules)


def assemble(cat: Catalog) -> dict[str, DataFrame]:
    """All relations of all snapshots, without the rendered table definitions."""
    tables = user_tables(cat)
    index_cols = index_columns(cat, every=True)

    def named(rows: DataFrame) -> DataFrame:
        """Rows of captured tables, which are user tables: the others need not be left out before."""
        return _of_captured(rows, tables).drop("object_id")

    columns = named(assemble_columns(cat, every=True))
    foreign_keys = named(_ordinal(assemble_fks(cat, fk_columns(cat), every=True)))
    return {
        "objects": assemble_objects(cat),
        "columns": columns,
        "keys": named(_ordinal(assemble_keys(cat, index_cols, every=True))),
        "foreign_keys": foreign_keys,
        "checks": named(_ordinal(assemble_checks(cat, every=True))),
        "indexes": named(_ordinal(select_indexes(cat, index_cols, every=True))),
        "alias_types": used_alias_types(alias_types(cat), columns),
        "dependencies": union_all([table_deps(foreign_keys), module_deps(cat)]),
    }


def extract_notices(cat: Catalog) -> DataFrame:
    """Everything that was skipped or only partly captured, with the reason."""
    tables = user_tables(cat)
    return temporal_notices(tables).unionByName(index_notices(cat, tables))


def with_definitions(relations: dict[str, DataFrame], scope: str = "snapshot_id") -> dict[str, DataFrame]:
    """The relations with every table's CREATE text filled in."""
    from fleetshape.plans.tables import create_table_rows

    rendered = create_table_rows(relations, scope).select(
        scope, F.lit(TABLE).alias("obj_type"), "schema_name", F.col("table_name").alias("obj_name"),
        F.col("definition").alias("rendered"))
    objects = (
        relations["objects"].join(rendered, [scope, "obj_type", "schema_name", "obj_name"], "left")
        .withColumn("definition", F.coalesce("definition", "rendered", F.lit(""))).drop("rendered")
    )
    return {**relations, "objects": objects}


def snapshot_summary(objects: DataFrame, scope: str = "snapshot_id") -> DataFrame:
    """Object counts per snapshot, one column per type."""
    counted = objects.groupBy(scope).pivot("obj_type", ["Table", "View", "StoredProcedure", "Function"]).count()
    names = {"Table": "tables", "View": "views", "StoredProcedure": "procs", "Function": "funcs"}
    return counted.select(scope, *[F.coalesce(F.col(k), F.lit(0).cast("bigint")).alias(v) for k, v in names.items()])
