"""Reading vertex and edge tables: only the column groups, parts and chunks that are asked for."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names
from ..errors import IndexRangeError, InvalidError, MissingKeyError, StorageError
from ..functions.expressions import Expression, check_members
from ..functions.scalars import label_list
from ..operators import layout as lay
from ..plans.info import EdgeInfo, Layout, PropertyGroup, VertexInfo
from . import chunk_reads
from .fs import Files

#: Keys of a row of an edge file: its part, its chunk and its place in the file.
KEYS = [names.hidden(k) for k in ("part", "chunk", "row")]
_FILE, _INDEX, _BLOCK, _START = (names.hidden(k) for k in ("file", "index", "block", "start"))


class _Source:
    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.prefix, self.files = spark, prefix if prefix.endswith("/") else prefix + "/", Files(spark)

    def _load(self, paths: str | list[str], file_type: str, indexes: list[str], fields: list[T.StructField], meta: dict[str, str] | None = None) -> DataFrame:
        """Files of one kind as index columns (long) and declared fields; `meta`: columns of _metadata to keep, and their names."""
        reader = self.spark.read.format(file_type).option("recursiveFileLookup", True)
        paths = [paths] if isinstance(paths, str) else paths
        schema = T.StructType([*(T.StructField(i, T.LongType()) for i in indexes), *fields])
        if file_type == "csv":
            df = reader.option("header", True).schema(schema).load(paths)  # names by place
        elif file_type == "json":
            df = reader.schema(self._json_schema(paths, schema, indexes)).load(paths)
        else:
            df = reader.load(paths)
        kept = [F.col(f"_metadata.{m}").alias(own) for m, own in (meta or {}).items()]
        declared = {f.name for f in fields}
        back = names.renames([c for c in df.columns if c not in declared], indexes)
        found = {own: c for c, own in back.items()} | {f.name: f.name for f in fields}
        if missing := [f.name for f in schema.fields if found.get(f.name) not in df.columns]:
            raise StorageError(f"{paths} have no columns {missing}")
        return df.select(*(F.col(f"`{found[f.name]}`").cast(f.dataType).alias(f.name) for f in schema.fields), *kept)

    def _json_schema(self, paths: list[str], schema: T.StructType, indexes: list[str]) -> T.StructType:
        """The schema under the names that the first row uses."""
        first = self.spark.read.option("recursiveFileLookup", True).text(paths).filter("value <> ''").first()
        used = {own: k for k, own in names.renames(list(json.loads(first[0])), indexes).items()} if first else {}
        return T.StructType([T.StructField(used.get(f.name, f.name), f.dataType) for f in schema.fields])


class VertexReader(_Source):
    """Reads one vertex type below a root folder."""

    def __init__(self, spark: SparkSession, prefix: str, info: VertexInfo):
        super().__init__(spark, prefix)
        self.info = info

    def count(self) -> int:
        path = self.prefix + self.info.count_path()
        if self.files.exists(path):
            return self.files.read_count(path)
        return self.group(self.info.groups[0], []).count()

    def chunk_count(self) -> int:
        return lay.chunks(self.count(), self.info.chunk_size)

    def _group(self, group: PropertyGroup, path: str | list[str], columns: list[str] | None) -> DataFrame:
        if group not in self.info.groups:
            raise MissingKeyError("the type has no such property group")
        check_members(set(columns or []), group.names, (names.VERTEX,))
        fields = [p.field for p in group.properties]
        df = self._load(path, group.file_type, [names.VERTEX], fields)
        return df if columns is None else df.select(names.VERTEX, *[c for c in columns if c != names.VERTEX])

    def chunk(self, group: PropertyGroup, number: int) -> DataFrame:
        if not 0 <= number < self.chunk_count():
            raise IndexRangeError(f"no vertex chunk {number}")
        return self._group(group, self.prefix + self.info.chunk_path(group, number), None)

    def group(self, group: PropertyGroup, columns: list[str] | None = None, chunks: Sequence[int] | None = None) -> DataFrame:
        """All of a group, or of some of its chunks; only their files are listed and read."""
        if chunks is None:
            return self._group(group, self.prefix + self.info.group_path(group), columns)
        if not chunks:
            return self._group(group, self.prefix + self.info.chunk_path(group, 0), columns).limit(0)
        return self._group(group, [self.prefix + self.info.chunk_path(group, c) for c in chunks], columns)

    def groups(self, groups: list[PropertyGroup]) -> DataFrame:
        """Several groups side by side, joined on the id; none gives a table of ids without rows."""
        if not groups:
            return self.spark.createDataFrame([], f"{names.VERTEX} long")
        return reduce(lambda a, b: a.join(b, names.VERTEX), [self.group(g) for g in groups])

    def all(self) -> DataFrame:
        return self.groups(list(self.info.groups))

    def placed_ids(self, group: PropertyGroup | None) -> DataFrame:
        """Ids in a group's files, or those of the labels (None), and `part`: the number of the chunk file that each is in."""
        path = self.info.labels_path() if group is None else self.info.group_path(group)
        rows = self._load(self.prefix + path, "parquet" if group is None else group.file_type, [names.VERTEX], [p.field for p in group.properties] if group and group.file_type == "csv" else [], {"file_path": _FILE})
        return rows.select(names.VERTEX, F.regexp_extract(_FILE, r"chunk(\d+)$", 1).cast("long").alias("part"))

    def select(self, columns: list[str], where: Expression | None = None, chunks: Sequence[int] | None = None) -> DataFrame:
        """id and the columns, of all chunks or some; only the groups that hold them or what `where` needs are read, each with its own columns."""
        wanted = list(dict.fromkeys([*columns, *(sorted(where.properties()) if where is not None else [])]))
        wanted = [c for c in wanted if c != names.VERTEX]
        by_group = {g: [c for c in wanted if g.has(c)] for g in self.info.groups}
        for c in wanted:
            self.info.group_of(c)
        parts = [self.group(g, own, chunks) for g, own in by_group.items() if own] or [self.group(self.info.groups[0], [], chunks)]
        df = reduce(lambda a, b: a.join(b, names.VERTEX), parts)
        if where is not None:
            df = df.filter(where.column())
        return df.select(names.VERTEX, *[c for c in columns if c != names.VERTEX])

    def label_flags(self, chunk: int | Sequence[int] | None = None) -> DataFrame:
        """id and one boolean per label, of all chunks, one, or some."""
        if not self.info.labels:
            raise InvalidError(f"{self.info.type} declares no labels")
        if chunk is not None and not isinstance(chunk, int) and not chunk:
            return self.label_flags(0).limit(0)
        fields = [T.StructField(x, T.BooleanType()) for x in self.info.labels]
        path = [self.prefix + self.info.labels_path(x) for x in ([chunk] if chunk is None or isinstance(chunk, int) else chunk)]
        stored = self.spark.read.option("recursiveFileLookup", True).parquet(*path)
        if names.renames(stored.columns, [names.VERTEX]):
            return self._load(path, "parquet", [names.VERTEX], fields)
        # archives without the id in label files: by place
        rows = self._load(path, "parquet", [], fields, {"file_path": _FILE, "row_index": _INDEX})
        number = F.regexp_extract(_FILE, r"chunk(\d+)$", 1).cast("long")
        return rows.select((number * self.info.chunk_size + F.col(_INDEX)).alias(names.VERTEX), *[f"`{x}`" for x in self.info.labels])

    def has_label_bitmaps(self) -> bool:
        return bool(self.info.labels) and self.files.exists(self.prefix + self.info.label_bitmaps_path())

    def label_bitmaps(self) -> DataFrame:
        """(label, bucket, bitmap), where they are stored."""
        return self.spark.read.schema("label string, bucket long, bitmap binary").parquet(self.prefix + self.info.label_bitmaps_path())

    def labels(self) -> DataFrame:
        flags = self.label_flags()
        return flags.select(names.VERTEX, label_list({x: F.col(f"`{x}`") for x in self.info.labels}).alias(names.LABELS))

    def with_labels(self) -> DataFrame:
        """All groups and the list of labels, null for vertices without a row of labels."""
        return self.all().join(self.labels(), names.VERTEX, "left")


class EdgeReader(_Source):
    """Reads one edge type in one layout."""

    def __init__(self, spark: SparkSession, prefix: str, info: EdgeInfo, layout: Layout):
        super().__init__(spark, prefix)
        self.info, self.layout, self.adj = info, layout, info.adj_list(layout)
        self.part_size = info.part_size(layout)
        self._counts: list[int] | None = None
        self._vertices: int | None = None

    def vertex_count(self) -> int:
        if self._vertices is None:
            self._vertices = self.files.read_count(self.prefix + self.info.vertex_count_path(self.layout))
        return self._vertices

    def part_count(self) -> int:
        return lay.chunks(self.vertex_count(), self.part_size)

    def _part(self, part: int) -> int:
        if not 0 <= part < self.part_count():
            raise IndexRangeError(f"no vertex chunk {part}")
        return part

    def count(self, part: int | None = None) -> int:
        """Edges of a part, or of all; count files are read once."""
        if part is not None and self._counts is None:
            return self._stored_count(self._part(part))
        if self._counts is None:
            self._counts = self.files.read_counts([self._count_path(p) for p in range(self.part_count())])
        return sum(self._counts) if part is None else self._counts[self._part(part)]

    def _stored_count(self, part: int) -> int:
        return self.files.read_counts([self._count_path(part)])[0]

    def _count_path(self, part: int) -> str:
        return self.prefix + self.info.edge_count_path(self.layout, part)

    def chunk_count(self, part: int) -> int:
        return lay.chunks(self.count(part), self.info.chunk_size)

    def chunk_counts(self) -> list[int]:
        self.count()
        return [lay.chunks(n, self.info.chunk_size) for n in self._counts or []]

    def offsets(self, part: int) -> DataFrame:
        """Offsets of a part with their places; only ordered layouts have them."""
        path = self.prefix + self.info.offset_path(self.layout, self._part(part))
        rows = self._numbered(path, self.adj.file_type, [names.OFFSET], [])
        return rows.select(F.col(KEYS[2]).alias("place"), names.OFFSET)

    def all_offsets(self, parts: Sequence[int] | None = None) -> DataFrame:
        """(part, place, offset) of all parts, or of some, of which only the files are listed."""
        folder = self.files.mounted(self.prefix + self.info.offset_path(self.layout))
        if folder and self.part_size < chunk_reads.MOST_ROWS and self._is_plain(self.adj.file_type):
            wanted = range(self.part_count()) if parts is None else [self._part(p) for p in parts]
            places = chunk_reads.places_of(self.spark, [(0, p) for p in wanted])
            rows = chunk_reads.read(places, [(folder, self.adj.file_type, [T.StructField(names.OFFSET, T.LongType())])], [names.OFFSET], KEYS, in_parts=False)
            return rows.select(F.col(KEYS[1]).alias(lay.PART), F.col(KEYS[2]).alias("place"), names.OFFSET)
        path = self.prefix + self.info.offset_path(self.layout) if parts is None else [self.prefix + self.info.offset_path(self.layout, self._part(p)) for p in parts]
        rows = self._numbered(path, self.adj.file_type, [names.OFFSET], [])
        return rows.select(F.col(KEYS[1]).alias(lay.PART), F.col(KEYS[2]).alias("place"), names.OFFSET)

    def _numbered(self, path: str | list[str], file_type: str, indexes: list[str], fields: list[T.StructField]) -> DataFrame:
        """Rows with part, chunk and place in their file. Parquet knows places; other formats are numbered by block and row."""
        if file_type == "parquet":
            rows = self._load(path, file_type, indexes, fields, {"file_path": _FILE, "row_index": KEYS[2]})
        else:
            rows = self._load(path, file_type, indexes, fields, {"file_path": _FILE, "file_block_start": _BLOCK}).withColumn(_INDEX, F.monotonically_increasing_id())
            order = Window.partitionBy(_FILE).orderBy(_BLOCK, _INDEX)  # one chunk file
            rows = rows.withColumn(KEYS[2], (F.row_number().over(order) - 1).cast("long")).drop(_BLOCK, _INDEX)
        part = F.regexp_extract(_FILE, r"part(\d+)/chunk\d+$", 1)
        rows = rows.withColumn(KEYS[0], F.when(part != "", part.cast("long"))).withColumn(KEYS[1], F.regexp_extract(_FILE, r"chunk(\d+)$", 1).cast("long"))
        return rows.drop(_FILE)

    def _empty(self, fields: list[T.StructField]) -> DataFrame:
        longs = [T.StructField(k, T.LongType()) for k in (*KEYS,)]
        return self.spark.createDataFrame([], T.StructType([*fields, *longs]))

    def _ends(self) -> list[T.StructField]:
        return [T.StructField(c, T.LongType()) for c in (names.SRC, names.DST)]

    def adj_rows(self, part: int | None = None, chunk: int | None = None, parts: range | None = None) -> DataFrame:
        """Both ids with the keys of their rows; of a chunk, a part, a range of parts, or all."""
        paths = self._paths(lambda p, c: self.prefix + self.info.adj_path(self.layout, p, c), part, chunk, parts)
        return self._numbered(paths, self.adj.file_type, [names.SRC, names.DST], []) if paths else self._empty(self._ends())

    def group_rows(self, group: PropertyGroup, part: int | None = None, chunk: int | None = None, parts: range | None = None, columns: list[str] | None = None) -> DataFrame:
        if group not in self.info.groups:
            raise MissingKeyError("the type has no such property group")
        check_members(set(columns or []), group.names)
        fields = [p.field for p in group.properties]
        paths = self._paths(lambda p, c: self.prefix + self.info.group_path(group, self.layout, p, c), part, chunk, parts)
        rows = self._numbered(paths, group.file_type, [], fields) if paths else self._empty(fields)
        return rows if columns is None else rows.select(*(f"`{c}`" for c in columns), *KEYS)

    def _paths(self, at, part: int | None, chunk: int | None, parts: range | None) -> list[str]:
        if part is None and parts is None:
            return [at(None, None)] if self.files.exists(at(None, None)) else []
        if part is None:
            return [at(p, None) for p in parts if self.count(self._part(p))]  # type: ignore[union-attr]
        n = self.chunk_count(self._part(part))
        if chunk is not None and not 0 <= chunk < n:
            raise IndexRangeError(f"part {part} has no chunk {chunk}")
        return [at(part, chunk)] if n else []

    def chunk_edges(self, chunks: Sequence[tuple[int, int]], columns: list[str] | None = None, keyed: bool = False) -> DataFrame:
        """Both ids and properties of some (part, chunk) pairs that are there; only their files are listed and read.

        keyed: with the keys of the rows.
        """
        wanted = self.info.property_names if columns is None else columns
        kept = [(g, [c for c in g.names if c in wanted]) for g in self.info.groups]
        for c in wanted:
            self.info.group_of(c)
        if not chunks:
            rows = self._empty([*self._ends(), *(p.field for g, own in kept for p in g.properties if p.name in own)])
            return self._finish(rows, [names.SRC, names.DST, *wanted, *(KEYS if keyed else [])], False)
        rows = self._beside(True, [(g, own) for g, own in kept if own], chunks=chunks)
        if rows is not None:
            return self._finish(rows, [names.SRC, names.DST, *wanted, *(KEYS if keyed else [])], False)
        rows = self._numbered([self.prefix + self.info.adj_path(self.layout, p, c) for p, c in chunks], self.adj.file_type, [names.SRC, names.DST], [])
        for g, own in kept:
            if own:
                paths = [self.prefix + self.info.group_path(g, self.layout, p, c) for p, c in chunks]
                rows = rows.join(self._numbered(paths, g.file_type, [], [p.field for p in g.properties]).select(*(f"`{c}`" for c in own), *KEYS), KEYS)
        return self._finish(rows, [names.SRC, names.DST, *wanted, *(KEYS if keyed else [])], False)

    def _finish(self, rows: DataFrame, columns: list[str], add_index: bool) -> DataFrame:
        """The columns, with the edge's id in front if asked for: its place in the layout."""
        if not add_index:
            return rows.select(*(f"`{c}`" for c in columns))
        from ..operators.ranking import number_rows

        starts = self._starts()
        if starts is None:
            rows = number_rows(rows, [F.col(k) for k in KEYS], names.EDGE)
        else:
            before = self.spark.createDataFrame(list(enumerate(starts)), f"{KEYS[0]} long, {_START} long")
            rows = rows.join(F.broadcast(before), KEYS[0])
            rows = rows.withColumn(names.EDGE, F.col(_START) + F.col(KEYS[1]) * self.info.chunk_size + F.col(KEYS[2]))
        return rows.select(names.EDGE, *(f"`{c}`" for c in columns))

    def _starts(self, most: int = 1_000_000) -> list[int] | None:
        """Edges before each part, from the count files; None for more parts than are broadcast: two numbers each."""
        if self.part_count() > most:
            return None
        self.count()
        return list(accumulate(self._counts or [], initial=0))[:-1] or [0]

    def _is_plain(self, file_type: str, fields: list[T.StructField] | None = None) -> bool:
        return chunk_reads.can_read(self.spark, file_type, fields or [])

    def _beside(self, ends: bool, groups: list[tuple[PropertyGroup, list[str]]], part: int | None = None, parts: range | None = None, chunks: Sequence[tuple[int, int]] | None = None) -> DataFrame | None:
        """Both ids (if `ends`) and groups' columns side by side with the keys of the rows, as tasks read small chunks; None where Spark reads them.

        Of a range of parts, chunks that are there, or all. A single part and few chunks are left to Spark: their files are few.
        """
        if part is not None or (chunks is not None and len(chunks) * (ends + len(groups)) <= chunk_reads.FEW_FILES):
            return None
        for g, own in groups:
            if g not in self.info.groups:
                raise MissingKeyError("the type has no such property group")
            check_members(set(own), g.names)
        files = [(self.info.adj_path(self.layout), self.adj.file_type, self._ends())] if ends else []
        files += [(self.info.group_path(g, self.layout), g.file_type, [p.field for p in g.properties if p.name in own]) for g, own in groups]
        mounted = [self.files.mounted(self.prefix + path) for path, _, _ in files]
        if self.info.chunk_size > chunk_reads.MOST_ROWS or not files or not all(mounted) or not all(self._is_plain(kind, fields) for _, kind, fields in files):
            return None
        if chunks is not None:
            places = chunk_reads.places_of(self.spark, list(chunks))
        else:
            asked = range(self.part_count()) if parts is None else parts
            held = sum(self.chunk_counts()) if parts is None else sum(self.chunk_count(p) for p in asked)
            places = chunk_reads.places_in(self.spark, asked, mounted[0], held)
        return chunk_reads.read(places, [(at, kind, fields) for at, (_, kind, fields) in zip(mounted, files, strict=True)], [names.SRC, names.DST] if ends else [], KEYS)

    def adj_chunk(self, part: int, chunk: int, add_index: bool = False) -> DataFrame:
        return self._finish(self.adj_rows(part, chunk), [names.SRC, names.DST], add_index)

    def adj_list(self, part: int | None = None, add_index: bool = True) -> DataFrame:
        rows = self._beside(True, [], part)
        return self._finish(self.adj_rows(part) if rows is None else rows, [names.SRC, names.DST], add_index)

    def group_chunk(self, group: PropertyGroup, part: int, chunk: int, add_index: bool = False) -> DataFrame:
        return self._finish(self.group_rows(group, part, chunk), group.names, add_index)

    def group(self, group: PropertyGroup, part: int | None = None, add_index: bool = True) -> DataFrame:
        rows = self._beside(False, [(group, group.names)], part)
        return self._finish(self.group_rows(group, part) if rows is None else rows, group.names, add_index)

    def groups(self, groups: list[PropertyGroup], part: int | None = None, add_index: bool = True) -> DataFrame:
        """Several groups side by side."""
        if not groups:
            raise InvalidError("no property group is asked for")
        rows = self._beside(False, [(g, g.names) for g in groups], part)
        if rows is None:
            rows = reduce(lambda a, b: a.join(b, KEYS), [self.group_rows(g, part) for g in groups])
        return self._finish(rows, [n for g in groups for n in g.names], add_index)

    def all_groups(self, part: int | None = None, add_index: bool = True) -> DataFrame:
        return self.groups(list(self.info.groups), part, add_index)

    def edges(self, part: int | None = None, add_index: bool = True, parts: range | None = None, columns: list[str] | None = None) -> DataFrame:
        """Both ids and properties of a part, a range of parts, or all; groups without a wanted column aren't read."""
        wanted = self.info.property_names if columns is None else columns
        for c in wanted:
            self.info.group_of(c)
        kept = [(g, own) for g in self.info.groups if (own := [c for c in g.names if c in wanted])]
        rows = self._beside(True, kept, part, parts)
        if rows is None:
            rows = self.adj_rows(part, parts=parts)
            for g, own in kept:
                rows = rows.join(self.group_rows(g, part, parts=parts, columns=own), KEYS)
        return self._finish(rows, [names.SRC, names.DST, *wanted], add_index)
