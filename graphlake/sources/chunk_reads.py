"""Small chunks of edges that tasks read themselves, from folders that all machines have mounted.

Spark's readers list all files on the way to a plan, open each as a split of its own, and join column groups by an
exchange: for chunks of a few hundred rows that is far more than the rows. Here a task takes some chunks and lays
their column groups side by side. What chunks a part has is looked up in its folder, by tasks too, and chunks are dealt
anew after that: a hub's part has many.

The numbers of chunks come as RDDs, of whose size Spark's planner knows nothing. As tables they were few small rows, and
so was to the planner what is read from them: it broadcast all edges and offsets in joins.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names
from ..errors import StorageError
from ..session import ship

#: Rows of a chunk up to which tasks read it, whole; files that a task reads, folders that it lists, about; rows of a batch.
MOST_ROWS, FILES_A_TASK, FOLDERS_A_TASK, ROWS_A_BATCH = 1 << 16, 512, 512, 10_000
#: Files that are left to Spark where they are known by name, at most.
FEW_FILES = 32
_P, _C = names.hidden("in_part"), names.hidden("in_chunk")


def can_read(spark: SparkSession, file_type: str, fields: list[T.StructField]) -> bool:
    """Whether files of this type give the same values here as in Spark."""
    if file_type == "parquet":
        return True
    # times in ORC are of the wall clock, in the zone of the JVM
    timed = any("timestamp" in f.dataType.simpleString() for f in fields)
    return file_type == "orc" and (not timed or spark._jvm.java.util.TimeZone.getDefault().getID() in ("UTC", "Etc/UTC", "GMT"))


def _tasks(spark: SparkSession, n: int, each: int) -> int:
    return max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // each))


def places_in(spark: SparkSession, parts: range, folder: str, held: int) -> DataFrame:
    """(part, chunk) of the chunk files in folders of parts; held: about how many files that is."""

    def look(numbers: Iterator[int]) -> Iterator[tuple[int, int]]:
        for p in numbers:
            try:
                there = os.listdir(f"{folder}part{p}")
            except FileNotFoundError:
                continue
            yield from ((p, c) for c in sorted(int(x[5:]) for x in there if re.fullmatch(r"chunk\d+", x)))

    ship(spark)
    numbers = spark.sparkContext.parallelize(parts, _tasks(spark, len(parts), FOLDERS_A_TASK))
    return spark.createDataFrame(numbers.mapPartitions(look).repartition(_tasks(spark, held, FILES_A_TASK)), f"{_P} long, {_C} long")


def places_of(spark: SparkSession, chunks: list[tuple[int, int]]) -> DataFrame:
    """(part, chunk) of chunks that are known."""
    return spark.createDataFrame(spark.sparkContext.parallelize(chunks, _tasks(spark, len(chunks), FILES_A_TASK)), f"{_P} long, {_C} long")


def read(places: DataFrame, files: list[tuple[str, str, list[T.StructField]]], indexes: list[str], keys: list[str], in_parts: bool = True) -> DataFrame:
    """Columns of all files of each chunk side by side, and the keys of the rows (part, chunk, place).

    files: folder, type and columns; a chunk's file is `part<p>/chunk<c>` below the folder, or `chunk<c>` if not in_parts.
    """
    from .datasource import _Store, arrow_type

    typed: list[tuple[str, str, list[tuple[str, pa.DataType]], list[str]]] = []
    for k, (folder, file_type, fields) in enumerate(files):
        typed.append((folder, file_type, [(f.name, arrow_type(f.dataType)) for f in fields], indexes if k == 0 else []))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for _, _, fields in files for f in fields), *(T.StructField(k, T.LongType()) for k in keys)])
    return places.mapInArrow(_reading(typed, keys, in_parts, _Store), schema)


def _reading(typed: list[tuple[str, str, list[tuple[str, pa.DataType]], list[str]]], keys: list[str], in_parts: bool, store: Callable[[str], Any]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def chunk(p: int, c: int) -> pa.Table:
        below, columns, rows = f"part{p}/chunk{c}" if in_parts else f"chunk{c}", {}, None
        for folder, file_type, wanted, indexes in typed:
            try:
                own = store("/").table(folder + below, file_type, wanted, indexes)
            except FileNotFoundError:
                raise StorageError(f"no file {folder}{below}") from None
            if rows is not None and own.num_rows != rows:
                raise StorageError(f"{folder}{below} has {own.num_rows} rows, the groups beside it {rows}")
            rows = own.num_rows
            columns |= {n: own.column(n) for n, _ in wanted}
        n = rows or 0
        at = [pa.array([p], pa.int64()).take(pa.nulls(n, pa.int64()).fill_null(0)), pa.array([c], pa.int64()).take(pa.nulls(n, pa.int64()).fill_null(0)), pa.array(range(n), pa.int64())]
        return pa.table(columns | dict(zip(keys, at, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(chunk(p, c))
                n += held[-1].num_rows
                if n >= ROWS_A_BATCH:
                    yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=ROWS_A_BATCH)
                    held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=ROWS_A_BATCH)

    return run
