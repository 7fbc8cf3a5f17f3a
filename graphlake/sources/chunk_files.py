"""Chunk files that tasks write themselves, under their final names, in folders that all machines have mounted.

Hadoop's local file system starts a process for each file and each folder that it makes, and Spark's writers leave
names to the driver: with small chunks both cost far more than the rows. Rows come to a task dealt and sorted by the
chunk's number, and are written as they come, so a task holds no more than a group of rows of one file. Several column
groups are written in one pass over the rows, and a small file in one call. Text formats are Spark's own lines (to_csv,
to_json).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names
from ..session import ship

#: Files that a task writes where there are more chunks than tasks; rows and bytes that it holds at most.
FILES_A_TASK, ROWS_HELD, BYTES_HELD = 256, 1_000_000, 64 << 20
_CODECS = {"none": "NONE", "uncompressed": "NONE", "snappy": "SNAPPY", "gzip": "GZIP", "zstd": "ZSTD"}
_LINE, _REFORM = names.hidden("line"), "1582-10-17"


def can_write(rows: DataFrame, file_type: str, options: dict[str, Any]) -> bool:
    """Whether these are types, options and values that are written here as Spark writes them."""
    if file_type == "csv":
        return set(options) == {"header"} and options["header"] is True
    if file_type == "json":
        return not options
    if not set(options) <= {"compression"} or str(options.get("compression", "zstd")).lower() not in _CODECS:
        return False
    dated = [f for f in rows.schema.fields if any(t in f.dataType.simpleString() for t in ("date", "timestamp"))]
    if file_type == "parquet" or not dated:
        return file_type in ("parquet", "orc")
    if any(not isinstance(f.dataType, (T.DateType, T.TimestampType)) for f in dated):
        return False
    # ORC files say which calendar they follow before its reform, and pyarrow can't say Spark's
    return not rows.agg(F.max(F.greatest(F.lit(False), *(F.coalesce(F.col(f"`{f.name}`") < F.lit(_REFORM).cast("date"), F.lit(False)) for f in dated)))).head()[0]


@dataclass(frozen=True)
class Output:
    """Columns that go to a folder's files, under the names that they have there."""

    columns: list[str]
    file_type: str
    folder: str
    options: dict[str, Any]


class _File:
    """A file that comes out whole, whatever attempts of its task are lost.

    A small one is made under its own name, in one call, if there is none: a rename costs as much again. Where an attempt
    left one, maybe in part, and for large ones, a file is written under a hidden name and then takes its own.
    """

    def __init__(self, path: str, attempt: int, kind: str, schema: pa.Schema, settings: dict[str, Any], most_bytes: int, made: set[str]):
        folder, base = os.path.split(path)
        if folder not in made:
            os.makedirs(folder, exist_ok=True)
            made.add(folder)
        self.path, self.hidden = path, f"{folder}/.{base}-{attempt}"
        self.kind, self.schema, self.settings, self.most_bytes = kind, schema, settings, most_bytes
        self.held: list[pa.RecordBatch] = []
        self.rows = self.bytes = 0
        self.writer: Any = None

    def _open(self, sink: Any) -> Any:
        if self.kind == "parquet":
            import pyarrow.parquet as pq

            return pq.ParquetWriter(sink, self.schema, store_schema=False, write_page_index=True, **self.settings)
        if self.kind == "orc":
            from pyarrow import orc

            return orc.ORCWriter(sink, **self.settings)
        return _Lines(sink, **self.settings)

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows, self.bytes = self.rows + batch.num_rows, self.bytes + batch.nbytes
        if self.rows >= ROWS_HELD or self.bytes >= self.most_bytes:
            self.writer = self.writer or self._open(self.hidden)
            self._flush(self.writer)

    def _flush(self, writer: Any) -> None:
        if self.held:
            table = pa.Table.from_batches(self.held).combine_chunks()
            writer.write(table) if not hasattr(writer, "write_table") else writer.write_table(table, row_group_size=ROWS_HELD)
            self.held, self.rows, self.bytes = [], 0, 0

    def close(self) -> None:
        if self.writer is not None:
            self._flush(self.writer)
            self.writer.close()
            os.replace(self.hidden, self.path)
            return
        sink = pa.BufferOutputStream()
        writer = self._open(sink)
        self._flush(writer)
        writer.close()
        data = sink.getvalue()
        try:
            with open(self.path, "xb") as f:
                f.write(data)
        except FileExistsError:
            with open(self.hidden, "wb") as f:
                f.write(data)
            os.replace(self.hidden, self.path)


class _Lines:
    def __init__(self, sink: Any, head: str | None = None):
        self.own = isinstance(sink, str)
        self.file = open(sink, "wb") if self.own else sink  # noqa: SIM115
        if head is not None:
            self.file.write(f"{head}\n".encode())

    def write(self, table: pa.Table) -> None:
        self.file.write("".join(f"{line}\n" for line in table.column(0).to_pylist()).encode())

    def close(self) -> None:
        if self.own:
            self.file.close()


def _putting(outputs: list[tuple[str, str, list[str], dict[str, Any]]], name: Callable[[int], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """outputs: folder, file type, names and settings; batches have the chunk's number and then the columns of all."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, at, out, files, made = TaskContext.get().taskAttemptId(), None, [], 0, set()
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            bodies, k = [], 1
            for _, _, own, _ in outputs:
                schema = pa.schema([batch.schema.field(k + i).with_name(c) for i, c in enumerate(own)])
                bodies.append(pa.RecordBatch.from_arrays(batch.columns[k : k + len(own)], schema=schema))
                k += len(own)
            starts = [] if not len(numbers) else [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()]
            for lo, hi in zip(starts, [*starts[1:], len(numbers)], strict=bool(starts)):
                if numbers[lo] != at:
                    for f in out:
                        f.close()
                    at, files = numbers[lo], files + 1
                    below = name(int(at))
                    out = [_File(f"{folder}/{below}", attempt, kind, body.schema, settings, BYTES_HELD // len(outputs), made) for (folder, kind, _, settings), body in zip(outputs, bodies, strict=True)]
                for f, body in zip(out, bodies, strict=True):
                    f.add(body.slice(lo, hi - lo))
        for f in out:
            f.close()
        yield pa.record_batch({"files": pa.array([files], pa.int64())})

    return put


def write(rows: DataFrame, n: int, number: str, order: list[str], outputs: list[Output], name: Callable[[int], str], encoded: bool) -> int:
    """For each number below n that rows have a file in each output's folder, rows in order, as `name(number)`; how many numbers there are."""
    spark = rows.sparkSession
    ship(spark)
    tasks = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // FILES_A_TASK))
    dealt = rows.repartitionById(tasks, (F.col(number) % tasks).cast("int")).sortWithinPartitions(number, *order)
    columns, puts = [], []
    for o in outputs:
        fields = [rows.schema[c] for c in o.columns]
        settings: dict[str, Any] = {}
        if o.file_type in ("csv", "json"):
            own = F.struct(*(F.col(f"`{c}`") for c in o.columns))
            columns.append(F.to_csv(own) if o.file_type == "csv" else F.to_json(own))
            if o.file_type == "csv":
                settings["head"] = spark.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(f"c{i}") for i, c in enumerate(o.columns))))).head()[0]
            puts.append((o.folder, o.file_type, [_LINE], settings))
            continue
        codec = _CODECS[str(o.options.get("compression", "zstd")).lower()]
        if o.file_type == "orc":
            zone, own_zone = spark.conf.get("spark.sql.session.timeZone"), spark._jvm.java.util.TimeZone.getDefault().getID()
            wall = lambda c, zone=zone, own_zone=own_zone: F.convert_timezone(F.lit(zone), F.lit(own_zone), F.col(f"`{c}`").cast("timestamp_ntz"))
            columns += [wall(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in fields]
            settings["compression"] = "UNCOMPRESSED" if codec == "NONE" else "ZLIB" if codec == "GZIP" else codec
        else:
            columns += [F.col(f"`{c}`") for c in o.columns]
            settings["compression"] = codec
            if encoded:  # as writer.parquet_encodings
                whole = [f.name for f in fields if f.dataType.simpleString() in ("bigint", "int")]
                flags = [f.name for f in fields if f.dataType.simpleString() == "boolean"]
                settings |= {"data_page_version": "2.0", "use_dictionary": [f.name for f in fields if f.name not in (*whole, *flags)], "column_encoding": {c: "DELTA_BINARY_PACKED" for c in whole} | dict.fromkeys(flags, "RLE")}
                if not settings["column_encoding"]:
                    del settings["column_encoding"]
        puts.append((o.folder, o.file_type, o.columns, settings))
    dealt = dealt.select(number, *(c.alias(names.hidden(f"c{i}")) for i, c in enumerate(columns)))
    return dealt.mapInArrow(_putting(puts, name), "files long").agg(F.sum("files")).head()[0] or 0
