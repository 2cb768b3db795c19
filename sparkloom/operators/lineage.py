"""Lineage control: reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one of this machine only where nothing else computes (local mode)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))
    return context.getCheckpointDir()


#: Settings of a checkpoint's execution. Its shuffle files go when it ends; what it computed stands in the
#: checkpoint by then. Constraints aren't kept with it: after a union they can name columns that it doesn't have.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.constraintPropagation.enabled": "false"}


def cut(df: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """Compute ``df`` once and return it with its lineage cut by a reliable checkpoint. ``more``: further settings of that execution."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    settings = SETTINGS | (more or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return df.select("*").checkpoint(eager=True)  # a new execution, which takes the settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``cut`` and aggregates over its rows, by the same job.

    The figures are taken where the rows are written, in the job's last stage, whose tasks count once even if an
    executor is lost and earlier stages run again.
    """
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return out, {name: seen.get.get(name) for name in figures}
