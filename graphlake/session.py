"""Checkpoints in the folder that the session names, and the package for Python workers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidError

_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ship(spark: SparkSession) -> None:
    """Let Python workers of this machine find the package where the driver does; clusters get it as any dependency."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's; where neither is set, a temporary one, on one machine only."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise InvalidError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder; they are removed once nothing refers to them."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    if not sc._conf.contains(_CLEAN):
        sc._jsc.sc().conf().set(_CLEAN, "true")  # read whenever a checkpoint goes out of use


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame) -> DataFrame:
    """As cut, for a table that is dealt by a column: joins on it find it in place, as its plan isn't an adaptive one."""
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df)
    finally:
        spark.conf.set(name, before)
