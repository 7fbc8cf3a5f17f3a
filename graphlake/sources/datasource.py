"""Stored graphs as a data source: `spark.read.format("graphlake")` and `df.write.format("graphlake")`.

Reading, a partition is a chunk with all its column groups, or some small chunks where there are many: groups are laid
side by side where they are read, so no exchange joins them, and a chunk is never split. Filters are taken over: those on the ids by which a table is cut leave
out chunk files, others are applied while reading. Writing, a task gives its files their final names in a folder beside
the table, which takes the table's place when all tasks have ended: one rename, whatever the number of chunks.

    register(spark)
    spark.read.format("graphlake").option("vertex", "person").option("columns", "name,age").load("/graphs/g/g.graph.yml")
    spark.read.format("graphlake").option("edge", "person,knows,person").option("layout", "ordered_by_source").load(path)
    by_chunk(df, info).write.format("graphlake").option("vertex", "person").option("group", "name,age").mode("overwrite").save(path)

Files are opened by the tasks themselves, of any store that pyarrow knows (local, HDFS, S3, GCS); other stores and JSON
are read through `Graph`, which leaves files to Spark.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .. import names
from ..errors import InvalidError, MissingKeyError
from ..functions import scalars
from ..operators import layout as lay
from ..plans import yaml_io
from ..plans.info import GraphInfo, Layout, PropertyGroup, VertexInfo
from ..session import ship

NAME = "graphlake"
#: Chunks up to which each is a partition; beyond, small ones share one, of so many rows at most.
MOST_PARTITIONS, ROWS_SHARED = 1_000, 1 << 16
_ARROW = {T.BooleanType: pa.bool_(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.DateType: pa.date32(), T.TimestampType: pa.timestamp("us", "UTC")}
_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def register(spark: SparkSession) -> None:
    """Lets a session read and write the format by its name."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GraphSource)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return pa.list_(arrow_type(kind.elementType)) if isinstance(kind, T.ArrayType) else _ARROW[type(kind)]


class _Store:
    """Files below a path or URI."""

    def __init__(self, path: str):
        uri = re.sub("^s3[an]:", "s3:", path)
        self.fs = arrow_fs.FileSystem.from_uri(uri)[0] if urlparse(uri).scheme else arrow_fs.LocalFileSystem()

    def at(self, path: str) -> str:
        """A path or URI as the store has it: with the bucket where there are buckets."""
        uri = urlparse(path)
        return uri.netloc + uri.path if uri.scheme.startswith(("s3", "gs", "gcs")) else uri.path if uri.scheme else path

    def text(self, path: str) -> str:
        with self.fs.open_input_stream(self.at(path)) as f:
            return f.read().decode()

    def count(self, path: str) -> int:
        if self.fs.get_file_info(self.at(path)).type == arrow_fs.FileType.NotFound:
            return 0
        with self.fs.open_input_stream(self.at(path)) as f:
            return int(np.frombuffer(f.read(), "<i8")[0])

    def table(self, path: str, file_type: str, columns: list[tuple[str, pa.DataType]], indexes: list[str]) -> pa.Table:
        """Columns of a chunk file under our names, in the declared types."""
        with self.fs.open_input_file(self.at(path)) as f:
            if file_type == "parquet":
                import pyarrow.parquet as pq

                there = pq.ParquetFile(f)
                own = {mine: c for c, mine in names.renames(list(there.schema_arrow.names), indexes).items()}
                stored = there.read([own.get(n, n) for n, _ in columns])
            elif file_type == "orc":
                from pyarrow import orc

                there = orc.ORCFile(f)
                own = {mine: c for c, mine in names.renames(list(there.schema.names), indexes).items()}
                stored = there.read([own.get(n, n) for n, _ in columns])
            elif file_type == "csv":
                from pyarrow import csv

                # Spark's writer quotes empty strings, and leaves nulls empty
                wanted = csv.ConvertOptions(column_types=dict(columns), strings_can_be_null=True, quoted_strings_can_be_null=False)
                stored = csv.read_csv(f, parse_options=csv.ParseOptions(escape_char="\\"), convert_options=wanted)
                own = {mine: c for c, mine in names.renames(stored.column_names, indexes).items()}
            else:
                raise InvalidError(f"the data source reads no {file_type}")
        return pa.table({n: _cast(stored.column(own.get(n, n)), kind) for n, kind in columns}) if columns else pa.table({"n": pa.nulls(stored.num_rows or there.metadata.num_rows)})


def _cast(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type) and column.type.tz is None:
        return column.cast(pa.timestamp("us"), safe=False).cast(kind)
    return column.cast(kind, safe=not pa.types.is_timestamp(kind))


#: A chunk: for each column group its file, type and columns.
ChunkFiles = list[tuple[str, str, list[str]]]


@dataclass
class Chunks(InputPartition):
    """Chunks that are read one after the other."""

    chunks: list[ChunkFiles]

    def __init__(self, chunks):
        super().__init__(chunks)
        self.chunks = chunks


class _Table:
    """What options name: a vertex type, or an edge type in a layout, and some of its columns."""

    def __init__(self, options):
        path = options.get("path")
        if not path:
            raise InvalidError("load() needs the path of the graph's metadata")
        self.store = _Store(path)
        self.info: GraphInfo = yaml_io.load_graph(self.store.text(path), posixpath.dirname(path) or ".", self.store.text)
        self.prefix = self.info.prefix if self.info.prefix.endswith("/") else self.info.prefix + "/"
        if options.get("vertex"):
            self.kind = self.info.vertex(options["vertex"])
            self.indexes, self.cut_by, self.size = [names.VERTEX], names.VERTEX, self.kind.chunk_size
        elif options.get("edge"):
            self.kind = self.info.edge(*(x.strip() for x in options["edge"].split(",")))
            self.layout = Layout(options["layout"]) if options.get("layout") else self.kind.adj_lists[0].layout
            self.kind.adj_list(self.layout)
            self.indexes, self.cut_by, self.size = [names.SRC, names.DST], lay.ends(self.layout)[0], self.kind.part_size(self.layout)
        else:
            raise InvalidError("name a vertex type or an edge type")
        wanted = [x.strip() for x in options["columns"].split(",") if x.strip()] if options.get("columns") is not None else self.kind.property_names
        self.groups: list[tuple[PropertyGroup, list[str]]] = []
        for c in wanted:
            self.kind.group_of(c)
        for g in self.kind.groups:
            if own := [c for c in g.names if c in wanted]:
                self.groups.append((g, own))
        fields = {p.name: p.field for g in self.kind.groups for p in g.properties}
        self.schema = T.StructType([*(T.StructField(i, T.LongType()) for i in self.indexes), *(fields[c] for c in wanted)])

    def chunks(self, low: int, high: int) -> list[ChunkFiles]:
        """Chunks that hold rows whose id, by which the table is cut, is from low to high."""
        out, store = [], self.store
        if isinstance(self.kind, VertexInfo):
            n = store.count(self.prefix + self.kind.count_path())
            parts = range(max(low, 0) // self.size, min(high, n - 1) // self.size + 1 if n and high >= 0 else 0)
            groups = self.groups or [(self.kind.groups[0], [])]
            for c in parts:
                out.append([(self.prefix + self.kind.chunk_path(g, c), g.file_type, [*([names.VERTEX] if k == 0 else []), *own]) for k, (g, own) in enumerate(groups)])
            return out
        n, adj = store.count(self.prefix + self.kind.vertex_count_path(self.layout)), self.kind.adj_list(self.layout)
        for p in range(max(low, 0) // self.size, min(high, n - 1) // self.size + 1 if n and high >= 0 else 0):
            held = store.count(self.prefix + self.kind.edge_count_path(self.layout, p))
            for c in range(lay.chunks(held, self.kind.chunk_size)):
                files = [(self.prefix + self.kind.adj_path(self.layout, p, c), adj.file_type, [names.SRC, names.DST])]
                out.append([*files, *((self.prefix + self.kind.group_path(g, self.layout, p, c), g.file_type, own) for g, own in self.groups)])
        return out


class GraphReader(DataSourceReader):
    def __init__(self, table: _Table):
        self.table, self.low, self.high = table, 0, (1 << 63) - 1
        self.types = {f.name: arrow_type(f.dataType) for f in table.schema.fields}
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over comparisons of whole numbers, strings and booleans with a value; Spark keeps the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = self.types.get(name)
            simple = kind is not None and (pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_boolean(kind))
            if not simple or type(f) not in (*_TESTS, In) or f.value is None:
                yield f
                continue
            value = tuple(f.value) if isinstance(f, In) else f.value
            self.tests.append((type(f), name, value))
            if name == self.table.cut_by and value != ():
                low, high = (min(value), max(value)) if isinstance(f, In) else (value, value)
                if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, low + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, high - isinstance(f, LessThan))

    def partitions(self) -> list[Chunks]:
        there = self.table.chunks(self.low, self.high) if self.low <= self.high else []
        each = max(1, min(-(-len(there) // MOST_PARTITIONS), ROWS_SHARED // self.table.kind.chunk_size))
        return [Chunks(there[i : i + each]) for i in range(0, len(there), each)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        for files in partition.chunks:
            yield from self._chunk(files)

    def _chunk(self, files: ChunkFiles) -> Iterator[pa.RecordBatch]:
        columns: dict[str, pa.ChunkedArray] = {}
        rows = None
        for path, file_type, wanted in files:
            own = self.table.store.table(path, file_type, [(c, self.types[c]) for c in wanted], self.table.indexes)
            if rows is not None and own.num_rows != rows:
                raise InvalidError(f"{path} has {own.num_rows} rows, the groups beside it {rows}")
            rows = own.num_rows
            columns |= {c: own.column(c) for c in wanted}
        if rows is None:
            return
        whole = pa.table({f.name: columns[f.name] for f in self.table.schema.fields})
        for kind, name, value in self.tests:
            mask = pc.is_in(whole.column(name), pa.array(value, self.types[name])) if kind is In else _TESTS[kind](whole.column(name), pa.scalar(value, self.types[name]))
            whole = whole.filter(mask)
        yield from whole.to_batches(max_chunksize=10_000)


@dataclass
class Written(WriterCommitMessage):
    chunks: list[int]


class VertexGroupWriter(DataSourceArrowWriter):
    """Writes one column group of a vertex type; a chunk's rows come in one task, in any order (see by_chunk)."""

    def __init__(self, table: _Table, group: PropertyGroup, schema: T.StructType):
        if group.file_type != "parquet":
            raise InvalidError("the data source writes Parquet")
        if missing := [c for c in (names.VERTEX, *group.names) if c not in schema.names]:
            raise MissingKeyError(f"the table has no columns {missing}")
        self.table, self.group = table, group
        self.target = table.store.at(table.prefix + table.kind.group_path(group)).rstrip("/")
        self.spare = f"{self.target}-new-{uuid.uuid4().hex}"
        self.types = {names.VERTEX: pa.int64(), **{p.name: arrow_type(p.field.dataType) for p in group.properties}}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written([])
        rows = pa.Table.from_batches(batches).sort_by(names.VERTEX)
        rows = pa.table({c: _cast(rows.column(c), kind) for c, kind in self.types.items()})
        number = rows.column(names.VERTEX).to_numpy() // self.table.size
        chunks, first = np.unique(number, return_index=True)
        attempt = TaskContext.get().taskAttemptId()
        self.table.store.fs.create_dir(self.spare, recursive=True)
        for chunk, lo, hi in zip(chunks, first, [*first[1:], len(number)], strict=True):
            # an attempt that is lost leaves a hidden file, and one that is repeated writes the same rows
            hidden = f"{self.spare}/.chunk{chunk}-{attempt}"
            with self.table.store.fs.open_output_stream(hidden) as f:
                pq.write_table(rows.slice(int(lo), int(hi - lo)), f, compression="zstd")
            self.table.store.fs.move(hidden, f"{self.spare}/chunk{chunk}")
        return Written([int(c) for c in chunks])

    def commit(self, messages: list[Written | None]) -> None:
        fs, chunks = self.table.store.fs, [c for m in messages if m for c in m.chunks]
        if len(chunks) != len(set(chunks)):
            self.abort(messages)
            raise InvalidError("a chunk came from several tasks: deal rows with by_chunk()")
        there = fs.get_file_info(self.target).type != arrow_fs.FileType.NotFound
        old = f"{self.target}-old-{uuid.uuid4().hex}"
        if there:
            fs.move(self.target, old)
        if chunks:
            for x in fs.get_file_info(arrow_fs.FileSelector(self.spare)):
                if x.base_name.startswith("."):
                    fs.delete_file(x.path)
            fs.move(self.spare, self.target)
        if there:
            fs.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        if self.table.store.fs.get_file_info(self.spare).type != arrow_fs.FileType.NotFound:
            self.table.store.fs.delete_dir(self.spare)


class GraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return _Table(self.options).schema

    def reader(self, schema: T.StructType) -> GraphReader:
        return GraphReader(_Table(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> VertexGroupWriter:
        table = _Table({k: v for k, v in self.options.items() if k != "columns"})
        if not isinstance(table.kind, VertexInfo) or not overwrite:
            raise InvalidError("the data source overwrites column groups of vertex types")
        wanted = [x.strip() for x in self.options.get("group", "").split(",") if x.strip()]
        group = next((g for g in table.kind.groups if g.names == wanted or not wanted), None)
        if group is None:
            raise MissingKeyError(f"no property group {wanted}")
        return VertexGroupWriter(table, group, schema)


def by_chunk(rows: DataFrame, info: VertexInfo, chunks: int) -> DataFrame:
    """Rows of a vertex table, each of its chunks a partition of its own."""
    return rows.repartitionById(max(chunks, 1), scalars.chunk_of(F.col(names.VERTEX), info.chunk_size).cast("int"))
