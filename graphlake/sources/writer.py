"""Writing vertex and edge tables in chunks whose files have the names of the format."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable
from functools import cached_property
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names
from ..errors import InvalidError, MissingKeyError, TypeMismatchError
from ..functions import scalars
from ..functions.types import Cardinality
from ..operators import labels as label_ops
from ..operators import layout as lay
from ..plans.info import EdgeInfo, Layout, PropertyGroup, ValidateLevel, VertexInfo
from ..session import cut
from . import chunk_files
from .fs import Files

#: Writer options by file type; users' options go on top.
OPTIONS: dict[str, dict[str, Any]] = {"parquet": {"compression": "zstd"}, "orc": {"compression": "zstd"}, "csv": {"header": True}, "json": {}}
#: Parts whose first chunks are broadcast: two numbers each.
_BROADCAST_PARTS = 1_000_000
#: Helper columns of stored rows.
PART, CHUNK, POSITION, NUMBER = map(names.hidden, ("part", "chunk", "position", "number"))
#: Tasks, one for each chunk, that a write has at most.
MOST_TASKS = 20_000


def parquet_encodings(rows: DataFrame) -> dict[str, Any]:
    """Options by which whole numbers are stored as differences and booleans as runs; other columns keep dictionaries.

    Ids and offsets ascend or nearly so, and a label holds for runs of vertices: both take a few bits a row.
    """
    plain = {f"parquet.enable.dictionary#{f.name}": "false" for f in rows.schema.fields if f.dataType.simpleString() in ("bigint", "int")}
    return {"parquet.writer.version": "v2", **plain}


class _Sink:
    def __init__(self, spark: SparkSession, prefix: str, options: dict[str, dict[str, Any]] | None = None, column_prefix: str = names.PREFIX, level: ValidateLevel = ValidateLevel.WEAK, encoded: bool = False):
        self.spark, self.prefix, self.column_prefix, self.level, self.encoded = spark, prefix if prefix.endswith("/") else prefix + "/", column_prefix, level, encoded
        self.options = {k: OPTIONS[k] | (options or {}).get(k, {}) for k in OPTIONS}
        self.files = Files(spark)

    def _chunks(self, rows: DataFrame, n: int, order: list[str], outputs: list[tuple[list[str], str, str]], name: Callable[[int], str]) -> None:
        """For each number below n that rows have in NUMBER a file in each output, rows in order, as `name(number)` below its target, which is replaced.

        outputs: columns, file type and target. Where all machines have the folder mounted, tasks write the files under
        their names, those of all outputs in one pass. Elsewhere Spark does: each number is a task of its own, so
        Spark's file numbers are these; beyond MOST_TASKS tasks write several files each, in folders, and files get
        their names beside the target. The whole folder then takes the target's place, so that a failure before leaves
        the old table.
        """
        spare = f"{self.prefix}tmp-{uuid.uuid4().hex}"
        mounted, own_files = self.files.mounted(spare), []
        stored = names.to_prefix(rows, self.column_prefix)
        own = dict(zip(rows.columns, stored.columns, strict=True))
        try:
            for k, (columns, file_type, target) in enumerate(outputs):
                options = self.options[file_type]
                kept = rows.select(*(f"`{c}`" for c in dict.fromkeys([NUMBER, *order, *columns])))
                helpers = [c for c in kept.columns if c != NUMBER and c not in columns]
                if mounted and chunk_files.can_write(rows.select(*(f"`{c}`" for c in columns)), file_type, options):
                    own_files.append((chunk_files.Output([own[c] for c in columns], file_type, f"{mounted}/staged{k}", options), f"{spare}/staged{k}", target))
                    continue
                if n <= MOST_TASKS:
                    dealt = kept.repartitionById(max(n, 1), F.col(NUMBER).cast("int")).sortWithinPartitions(*order).drop(NUMBER, *helpers)
                    self._save(dealt, file_type, f"{spare}/new{k}")
                    found = [(int(path.rsplit("/part-", 1)[1].split("-")[0]), path) for path in self.files.glob(f"{spare}/new{k}/part-*")]
                else:
                    # by a number of tasks: adaptive execution would leave all small files to a few
                    dealt = kept.repartitionById(MOST_TASKS, (F.col(NUMBER) % MOST_TASKS).cast("int")).sortWithinPartitions(NUMBER, *order).drop(*helpers)
                    self._save(dealt, file_type, f"{spare}/new{k}", NUMBER)
                    found = [(int(path.split("/")[-2].split("=")[1]), path) for path in self.files.glob(f"{spare}/new{k}/{NUMBER}=*/part-*")]
                self._name(found, n, name, f"{spare}/staged{k}")
                self.files.replace(f"{spare}/staged{k}", target)
            if own_files:
                chunk_files.write(stored, n, NUMBER, [own[c] for c in order], [o for o, _, _ in own_files], name, self.encoded)
                for _, staged, target in own_files:
                    self.files.replace(staged, target)
        finally:
            self.files.delete(spare)

    def _name(self, found: list[tuple[int, str]], n: int, name: Callable[[int], str], staged: str) -> None:
        moves = {f"{staged}/{name(number)}": path for number, path in found if number < n}
        if len(moves) < len([x for x, _ in found if x < n]):
            raise InvalidError("a chunk came in several files")
        self.files.rename_all([(path, to) for to, path in moves.items()])

    def _part_chunks(self, rows: DataFrame, spans: list[tuple[int, int, int]], outputs: list[tuple[list[str], str, str]]) -> None:
        """Files for each chunk of rows with PART, CHUNK and POSITION; spans: part, first chunk and end, in the order of parts.

        Chunks of all parts are numbered in one row; a span of each part is all that the driver knows of them.
        """
        ends = list(accumulate(end - first for _, first, end in spans))
        starts = [(p, before - first) for (p, first, _), before in zip(spans, [0, *ends], strict=False)]
        known = self.spark.createDataFrame(starts, f"{PART} long, {NUMBER} long")
        numbered = rows.join(known if len(spans) > _BROADCAST_PARTS else F.broadcast(known), PART).withColumn(NUMBER, F.col(NUMBER) + F.col(CHUNK))

        def name(number: int) -> str:
            at = bisect_right(ends, number)
            return f"part{spans[at][0]}/chunk{number - starts[at][1]}"

        self._chunks(numbered.drop(PART, CHUNK), ends[-1] if ends else 0, [POSITION], outputs, name)

    def _save(self, rows: DataFrame, file_type: str, path: str, *by: str) -> None:
        stored = names.to_prefix(rows, self.column_prefix)
        encodings = parquet_encodings(stored) if self.encoded and file_type == "parquet" else {}
        writer = stored.write.format(file_type).options(**encodings | self.options[file_type]).option("maxRecordsPerFile", 0)
        (writer.partitionBy(*by) if by else writer).save(path)


class VertexWriter(_Sink):
    """Writes one vertex type. `vertices` has the id column, or gets ids in the order of its primary key."""

    def __init__(self, prefix: str, info: VertexInfo, vertices: DataFrame, count: int | None = None, **settings: Any):
        super().__init__(vertices.sparkSession, prefix, **settings)
        from ..operators.index import vertex_index

        info.validate()
        self.info = info
        vertices = names.to_own(vertices, [names.VERTEX])
        names.refuse_hidden(vertices.columns)
        self.vertices = vertices if names.VERTEX in vertices.columns else vertex_index(vertices, info.primary_key)
        validate_vertices(self.vertices, info, self.level)
        n, low, high = self.vertices.agg(F.count("*"), F.min(names.VERTEX), F.max(names.VERTEX)).head()
        self.count = n if count is None else count
        #: The first chunk, which needn't be 0, and the end.
        self._range = (0, 0) if low is None else (low // info.chunk_size, high // info.chunk_size + 1)

    def _chunked(self, rows: DataFrame, outputs: list[tuple[list[str], str, str]]) -> None:
        """Rows by their chunk."""
        first, end = self._range
        rows = lay.with_vertex_chunk(rows, self.info.chunk_size, NUMBER).withColumn(NUMBER, F.col(NUMBER) - first)
        self._chunks(rows, end - first, [names.VERTEX], outputs, lambda c: f"chunk{first + c}")

    def write_count(self) -> None:
        self.files.write_count(self.prefix + self.info.count_path(), self.count)

    def _columns(self, *groups: PropertyGroup) -> list[Column]:
        return [F.col(f"`{p.name}`").cast(p.field.dataType).alias(p.name) for g in groups for p in g.properties]

    def _group_output(self, group: PropertyGroup) -> tuple[list[str], str, str]:
        return [names.VERTEX, *group.names], group.file_type, self.prefix + self.info.group_path(group)

    def write_group(self, group: PropertyGroup) -> None:
        if group not in self.info.groups:
            raise MissingKeyError("the type has no such property group")
        self._chunked(self.vertices.select(names.VERTEX, *self._columns(group)), [self._group_output(group)])

    def _labels_output(self) -> tuple[list[str], str, str]:
        self.files.delete(self.prefix + self.info.label_bitmaps_path())  # they are of the labels before
        return [names.VERTEX, *self.info.labels], "parquet", self.prefix + self.info.labels_path()

    def write_labels(self) -> None:
        if not self.info.labels:
            raise InvalidError(f"{self.info.type} declares no labels")
        self._chunked(label_ops.to_flags(self.vertices, list(self.info.labels)), [self._labels_output()])

    def write_label_bitmaps(self) -> None:
        write_label_bitmaps(self.spark, self.prefix, self.info, label_ops.to_flags(self.vertices, list(self.info.labels)))

    def write(self) -> None:
        """All groups, the count, and labels where the type declares them and the table has them; in one pass, unless a label is a property's name too."""
        self.write_count()
        labelled = bool(self.info.labels) and names.LABELS in self.vertices.columns
        flags = label_ops.flags(list(self.info.labels)) if labelled and not set(self.info.labels) & set(self.info.property_names) else []
        rows = self.vertices.select(names.VERTEX, *self._columns(*self.info.groups), *flags)
        self._chunked(rows, [*map(self._group_output, self.info.groups), *([self._labels_output()] if flags else [])])
        if labelled and not flags:
            self.write_labels()


class EdgeWriter(_Sink):
    """Writes one edge type in one layout. `edges` has both id columns."""

    def __init__(self, prefix: str, info: EdgeInfo, layout: Layout, vertices: int, edges: DataFrame, **settings: Any):
        super().__init__(edges.sparkSession, prefix, **settings)
        info.validate()
        self.info, self.layout, self.vertices = info, layout, vertices
        self.adj = info.adj_list(layout)
        edges = names.to_own(edges, [names.SRC, names.DST])
        names.refuse_hidden(edges.columns)
        if missing := [c for c in (names.SRC, names.DST) if c not in edges.columns]:
            raise MissingKeyError(f"edges have no {missing}")
        validate_edges(edges, info, self.level)
        typed = [F.col(f"`{p.name}`").cast(p.field.dataType).alias(p.name) for g in info.groups for p in g.properties]
        self.part_size = info.part_size(layout)
        ties = [p.name for g in info.groups for p in g.properties]
        # all files come from one arrangement, which is kept: the edges are read once
        self.arranged = cut(lay.arrange(edges.select(names.SRC, names.DST, *typed), layout, self.part_size, info.chunk_size, ties, (PART, POSITION, CHUNK)))

    @cached_property
    def counts(self) -> list[int]:
        """Edges of each part; one number per part comes to the driver, which names a file for each chunk of it."""
        counted = lay.edges_per_part(self.arranged, self.layout, self.part_size, self.vertices)
        out = [0] * lay.chunks(self.vertices, self.part_size)
        for row in counted.toLocalIterator():
            out[row[lay.PART]] = row["edges"]
        return out

    def write_counts(self) -> None:
        """The aligned end's vertex count and the edges of each part; there are as many files as parts."""
        self.files.write_count(self.prefix + self.info.vertex_count_path(self.layout), self.vertices)
        self.files.write_counts([(self.prefix + self.info.edge_count_path(self.layout, p), n) for p, n in enumerate(self.counts)])

    def write_offsets(self) -> None:
        place = names.hidden("place")
        rows = lay.offsets(self.arranged, self.layout, self.part_size, self.vertices).withColumnsRenamed({lay.PART: NUMBER, "place": place})
        self._chunks(rows, len(self.counts), [place], [([names.OFFSET], self.adj.file_type, self.prefix + self.info.offset_path(self.layout))], lambda p: f"chunk{p}")

    def _chunked(self, outputs: list[tuple[list[str], str, str]]) -> None:
        spans = [(p, 0, lay.chunks(n, self.info.chunk_size)) for p, n in enumerate(self.counts)]
        columns = dict.fromkeys(c for own, _, _ in outputs for c in own)
        self._part_chunks(self.arranged.select(*(f"`{n}`" for n in columns), PART, CHUNK, POSITION), spans, outputs)

    def _adj_output(self) -> tuple[list[str], str, str]:
        return [names.SRC, names.DST], self.adj.file_type, self.prefix + self.info.adj_path(self.layout)

    def _group_output(self, group: PropertyGroup) -> tuple[list[str], str, str]:
        return group.names, group.file_type, self.prefix + self.info.group_path(group, self.layout)

    def _write_facts(self) -> None:
        self.write_counts()
        if self.layout.ordered:
            self.write_offsets()

    def write_adj_list(self) -> None:
        self._chunked([self._adj_output()])
        self._write_facts()

    def write_group(self, group: PropertyGroup) -> None:
        if group not in self.info.groups:
            raise MissingKeyError("the type has no such property group")
        self._chunked([self._group_output(group)])

    def write(self) -> None:
        """The adjacency list and all groups, in one pass over the edges, then counts and offsets."""
        self._chunked([self._adj_output(), *map(self._group_output, self.info.groups)])
        self._write_facts()


def write_label_bitmaps(spark: SparkSession, prefix: str, info: VertexInfo, flags: DataFrame) -> None:
    """Bitmaps of boolean columns (a type's stored flags, say), swapped in as a folder; files hold a label's or a range of its buckets."""
    files, root = Files(spark), prefix if prefix.endswith("/") else prefix + "/"
    spare = f"{root}tmp-{uuid.uuid4().hex}"
    try:
        rows = label_ops.to_bitmaps(flags, list(info.labels)).repartitionByRange(label_ops.LABEL, label_ops.BUCKET).sortWithinPartitions(label_ops.LABEL, label_ops.BUCKET)
        rows.write.option("compression", "zstd").parquet(spare)
        files.replace(spare, root + info.label_bitmaps_path())
    finally:
        files.delete(spare)


def _schema(df: DataFrame, info, level: ValidateLevel) -> None:
    for g in info.groups:
        for p in g.properties:
            if p.name not in df.columns:
                raise MissingKeyError(f"the table has no column {p.name!r}")
            own, want = df.schema[p.name].dataType, p.field.dataType
            if level is ValidateLevel.STRONG and own != want:
                raise TypeMismatchError(f"{p.name!r} is {own.simpleString()}, declared {want.simpleString()}")


def validate_vertices(df: DataFrame, info: VertexInfo, level: ValidateLevel) -> None:
    """WEAK: columns are there; STRONG: types too, ids dense, keys unique and not null, sets without repeats. One pass over the data."""
    if level is ValidateLevel.NO:
        return
    _schema(df, info, level)
    if level is not ValidateLevel.STRONG:
        return
    from ..operators.index import require_unique

    if info.primary_key:
        require_unique(df, info.primary_key)
    facts = {"n": F.count("*"), "low": F.min(names.VERTEX), "high": F.max(names.VERTEX)}
    for g in info.groups:
        for p in g.properties:
            if not p.nullable:
                facts[f"null {p.name}"] = F.count_if(F.col(f"`{p.name}`").isNull())
            if p.cardinality is Cardinality.SET:
                facts[f"set {p.name}"] = F.count_if(~scalars.is_set(F.col(f"`{p.name}`")))
    row = df.agg(*(c.alias(k) for k, c in facts.items())).first().asDict()
    if row["n"] and (row["low"] != 0 or row["high"] != row["n"] - 1):
        raise InvalidError("ids are not dense from 0")
    if bad := [k for k, v in row.items() if k.split(" ")[0] in ("null", "set") and v]:
        raise InvalidError(f"values break the declaration: {bad}")


def validate_edges(df: DataFrame, info: EdgeInfo, level: ValidateLevel) -> None:
    if level is ValidateLevel.NO:
        return
    _schema(df, info, level)
    if level is ValidateLevel.STRONG:
        if any(df.schema[c].dataType.simpleString() != "bigint" for c in (names.SRC, names.DST)):
            raise TypeMismatchError("edge ends must be long")
        if not df.filter(F.col(names.SRC).isNull() | F.col(names.DST).isNull() | (F.col(names.SRC) < 0) | (F.col(names.DST) < 0)).isEmpty():
            raise InvalidError("edge ends must be ids")


def install_chunk(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file that is a chunk already to its place."""
    Files(spark).copy(source, target)
