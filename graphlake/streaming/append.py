"""Structured Streaming into a vertex table: new rows become whole new chunks with the next ids.

Chunks of the format have a fixed number of rows, so a micro-batch is appended after the rows that are stored; only
the last, short chunk is written again. Windowed counts with a watermark are given as a stream of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import names
from ..operators import layout as lay
from ..operators.ranking import number_rows
from ..plans.info import VertexInfo
from ..session import cut
from ..sources.fs import Files
from ..sources.reader import VertexReader
from ..sources.writer import VertexWriter


def append_batch(spark: SparkSession, prefix: str, info: VertexInfo, rows: DataFrame, key: str, batch: int | None = None) -> int:
    """Appends rows in the order of their key after those stored; returns the new number of vertices.

    With `batch`, a marker names the batch and the number of vertices after it; it is renamed into place before the
    count file is written. A batch that is repeated is either done already, or overwrites what its first try left
    beyond the vertices that are counted.
    """
    files, root = Files(spark), prefix if prefix.endswith("/") else prefix + "/"
    marker, counted = f"{root}{info.prefix}last_batch", f"{root}{info.count_path()}"
    have = files.read_count(counted) if files.exists(counted) else 0
    if batch is not None and files.exists(marker):
        last, after = map(int, files.read_text(marker).split())
        if after != have:  # the last try ended between the two files
            files.write_count(counted, after)
            have = after
        if last >= batch:
            return have
    whole = have - have % info.chunk_size
    new = number_rows(rows, [F.col(key)], names.VERTEX).withColumn(names.VERTEX, F.col(names.VERTEX) + have)
    if have > whole:
        tail = VertexReader(spark, root, info).select(info.property_names).filter((F.col(names.VERTEX) >= whole) & (F.col(names.VERTEX) < have))
        new = tail.unionByName(new.select(names.VERTEX, *info.property_names))
    new = cut(new)
    added = new.count()
    if not added:
        return have
    for group in info.groups:
        spare = f"{root}tmp-append-{uuid.uuid4().hex}/"
        writer = VertexWriter(spare, info, new, count=added)
        writer.write_group(group)
        folder = f"{spare}{info.group_path(group)}"
        for name in files.list(folder):
            files.move(f"{folder}{name}", f"{root}{info.group_path(group)}{name}")
        files.delete(spare)
    if batch is not None:
        spare = f"{root}tmp-marker-{uuid.uuid4().hex}"
        files.write_text(spare, f"{batch} {whole + added}")
        files.move(spare, marker)
    files.write_count(counted, whole + added)
    return whole + added


def stream_into(stream: DataFrame, prefix: str, info: VertexInfo, key: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends every micro-batch once and ends when all available input is taken."""
    def each(batch: DataFrame, number: int) -> None:
        append_batch(batch.sparkSession, prefix, info, batch, key, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, end, key, n, total) per window and key; rows later than the watermark are left out in a stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    found = stream.withWatermark(time, lateness).groupBy(window.alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col(by), "n")


def chunk_count(spark: SparkSession, prefix: str, info: VertexInfo) -> int:
    return lay.chunks(VertexReader(spark, prefix, info).count(), info.chunk_size)
