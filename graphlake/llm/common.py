"""Session and table helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir, shared_folder

__all__ = ["FOLDED", "SPACE", "WORD", "cut", "ensure_checkpoint_dir", "fold", "pow2_at_least", "removed", "scratch", "shared_folder", "ship", "shuffles_removed", "small_batches", "table", "text_or_empty", "written"]

#: White space and words as all contracts define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers of this machine find the package where the driver does; clusters get it as any dependency."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset in `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pow2_at_least(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A folder for written tables in the shared checkpoint folder, removed when the block ends."""
    ensure_checkpoint_dir(spark)
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        removed(spark, path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs inside go with the end of the action that made them, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Arrow batches of fewer rows for what runs inside, where rows hold whole sets or texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Elements of an array that `fold` takes in one inner step.
FOLDED = 256


def fold(items, state, empty, step):
    """Column: what `step` puts out over an array of structs, in order, as one array.

    state: column of the first state; empty: an empty array of the output's type; step(state, item) gives a struct of
    the next `state` and the array `out` of what the item adds. An array that grows by one element a step is copied
    each time; here only those of a block are, so that time doesn't grow with the square of the array's size.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int")), lambda b: F.slice(items, b * FOLDED + 1, F.lit(FOLDED)))

    def inner(acc, x):
        return F.transform(F.array(step(acc["state"], x)), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))[0]

    def outer(acc, block):
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), empty.alias("out")), inner)
        return F.transform(F.array(done), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    none = F.slice(F.array(empty), F.lit(1), F.lit(0))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, F.struct(state.alias("state"), none.alias("out")), outer, lambda acc: acc["out"]))).otherwise(empty)
