"""Audit log of applied runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ["applied", "rolled-back", "failed"]


def audit_outcome(succeeded, transactional):
    """Outcome of a run: applied, rolled back when it ran as one transaction, failed otherwise."""
    return F.when(succeeded, "applied").when(transactional, "rolled-back").otherwise("failed")


def append_audit(runs: DataFrame, path: str) -> None:
    """Append runs, one row each, by date. Dry runs leave no trace."""
    logged = runs.where(~F.col("dry_run")).drop("dry_run") if "dry_run" in runs.columns else runs
    logged.withColumn("run_date", F.to_date("started_at")).write.mode("append").partitionBy("run_date").parquet(path)
