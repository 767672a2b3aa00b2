"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE re-plans skewed joins; forcing it keeps one oversized database from owning a task
# even where splitting costs an extra exchange further up.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Partitions whose build side is measured small are hash-joined; the rest stay sort-merge.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # The JVM leaves methods beyond 8000 bytes of code interpreted: smaller generated pieces run compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Catalog relations repeat few values, so that a megabyte of Parquet may be a hundred of rows: by file size only what
# is tiny is broadcast, the rest by the size AQE measures behind an exchange.
FLEET_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "512k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Items and columns take up ten to twenty times their shuffled bytes while a task sorts them.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # AQE joins small partitions but splits none that a window or an aggregate reads: it has to start from many,
    # whatever the session's own number, or partitions grow with the fleet until tasks spill.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    # What is kept between jobs is read once or twice: disk is dearer than the seconds of packing it.
    "spark.sql.parquet.compression.codec": "zstd",
}
# Session -> what FLEET_CONF replaced there.
_replaced: dict[int, dict[str, str | None]] = {}


def build_session(app_name: str = "fleetshape", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **FLEET_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings to a session someone else built."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    for key, value in _replaced.pop(id(spark), {}).items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
    return spark


def configure_fleet(spark: SparkSession) -> SparkSession:
    """FLEET_CONF as well, until the next `configure`: for jobs on catalogs."""
    _replaced.setdefault(id(spark), {k: spark.conf.get(k, None) for k in FLEET_CONF})
    for key, value in FLEET_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def together(spark: SparkSession, partitions: int) -> Iterator[None]:
    """What is executed within is joined where it lies, also if it lies by some of the join's keys alone, in `partitions` that nothing joins or splits."""
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions)}
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; in local mode, and there only, a temporary one where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        if not context.getCheckpointDir():
            context.setCheckpointDir(root)
        return root
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="fleetshape-")
    context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the checkpoint root for a table written between jobs."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
