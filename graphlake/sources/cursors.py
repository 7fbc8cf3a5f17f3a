"""Cursors over chunks: seek an id, take the chunk's rest, go on to the next chunk. Tables stay lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names
from ..errors import IndexRangeError, InvalidError
from ..functions.expressions import Expression, check_members
from ..operators import layout as lay
from ..plans.info import PropertyGroup
from .reader import KEYS, EdgeReader, VertexReader


class VertexCursor:
    """Chunks of one property group, or of the labels where `group` is None."""

    def __init__(self, reader: VertexReader, group: PropertyGroup | None, columns: list[str] | None = None, where: Expression | None = None):
        self.reader, self.group, self.id = reader, group, 0
        known = list(reader.info.labels) if group is None else group.names
        check_members(set(columns or []), known, (names.VERTEX,))
        if where is not None:
            check_members(where.properties(), known, (names.VERTEX,))
        self.columns, self.where, self.size = columns, where, reader.info.chunk_size
        self.total = reader.count()

    @classmethod
    def for_properties(cls, reader: VertexReader, properties: list[str], where: Expression | None = None) -> VertexCursor:
        """Over the one group that holds all the properties."""
        group = reader.info.group_of(properties[0])
        check_members(set(properties), group.names)
        return cls(reader, group, properties, where)

    @property
    def chunk_number(self) -> int:
        return self.id // self.size

    def chunk_count(self) -> int:
        return lay.chunks(self.total, self.size)

    def seek(self, vertex: int) -> None:
        if not 0 <= vertex < self.total:
            raise IndexRangeError(f"no vertex {vertex}")
        self.id = vertex

    def next_chunk(self) -> bool:
        """To the next chunk's first id; False at the end."""
        if self.chunk_number + 1 >= self.chunk_count():
            return False
        self.id = (self.chunk_number + 1) * self.size
        return True

    def path(self) -> str:
        info = self.reader.info
        own = info.labels_path(self.chunk_number) if self.group is None else info.chunk_path(self.group, self.chunk_number)
        return self.reader.prefix + own

    def get(self) -> DataFrame:
        """Rows from the sought id to the end of its chunk."""
        df = self.reader.label_flags(self.chunk_number) if self.group is None else self.reader.chunk(self.group, self.chunk_number)
        df = df.filter(F.col(names.VERTEX) >= self.id)
        if self.where is not None:
            df = df.filter(self.where.column())
        return df if self.columns is None else df.select(names.VERTEX, *(f"`{c}`" for c in self.columns if c != names.VERTEX))


class EdgeCursor:
    """Chunks of the adjacency list, or of a property group, of one layout."""

    def __init__(self, reader: EdgeReader, group: PropertyGroup | None = None, columns: list[str] | None = None, where: Expression | None = None):
        known = [names.SRC, names.DST] if group is None else group.names
        check_members(set(columns or []), known)
        if where is not None:
            check_members(where.properties(), known)
        self.reader, self.group, self.columns, self.where = reader, group, columns, where
        self.part, self.place = 0, 0
        self._skip_empty()

    def _skip_empty(self) -> bool:
        while self.part < self.reader.part_count() and self.reader.count(self.part) == 0:
            self.part, self.place = self.part + 1, 0
        return self.part < self.reader.part_count()

    @property
    def chunk_number(self) -> int:
        return self.place // self.reader.info.chunk_size

    def seek(self, place: int) -> None:
        """To an edge's place in the current part."""
        if not 0 <= place < self.reader.count(self.part):
            raise IndexRangeError(f"part {self.part} has no edge {place}")
        self.place = place

    def seek_chunk(self, part: int, chunk: int = 0) -> None:
        if not 0 <= part < self.reader.part_count() or not 0 <= chunk < max(1, self.reader.chunk_count(part)):
            raise IndexRangeError(f"no chunk {chunk} in part {part}")
        self.part, self.place = part, chunk * self.reader.info.chunk_size

    def _seek_end(self, vertex: int, by_source: bool) -> None:
        r = self.reader
        if r.layout.by_source != by_source:
            raise InvalidError(f"{r.layout.value} isn't aligned with that end")
        if not 0 <= vertex < r.vertex_count():
            raise IndexRangeError(f"no vertex {vertex}")
        self.part, self.place = vertex // r.part_size, 0
        if r.layout.ordered:
            row = r.offsets(self.part).filter(F.col("place") == vertex % r.part_size).first()
            self.place = row[names.OFFSET]

    def seek_src(self, vertex: int) -> None:
        """To the first edge of a source: exactly in ordered layouts, else to its part."""
        self._seek_end(vertex, True)

    def seek_dst(self, vertex: int) -> None:
        self._seek_end(vertex, False)

    def next_chunk(self) -> bool:
        if self.chunk_number + 1 < self.reader.chunk_count(self.part):
            self.place = (self.chunk_number + 1) * self.reader.info.chunk_size
            return True
        self.part, self.place = self.part + 1, 0
        return self._skip_empty()

    def rows_in_chunk(self) -> int:
        size, n = self.reader.info.chunk_size, self.reader.count(self.part)
        return max(0, min(size, n - self.chunk_number * size))

    def path(self) -> str:
        r = self.reader
        own = r.info.adj_path(r.layout, self.part, self.chunk_number) if self.group is None else r.info.group_path(self.group, r.layout, self.part, self.chunk_number)
        return r.prefix + own

    def get(self) -> DataFrame:
        """Rows from the sought place to the end of its chunk."""
        r = self.reader
        rows = r.adj_rows(self.part, self.chunk_number) if self.group is None else r.group_rows(self.group, self.part, self.chunk_number)
        rows = rows.filter(F.col(KEYS[2]) >= self.place % r.info.chunk_size)
        if self.where is not None:
            rows = rows.filter(self.where.column())
        known = self.columns or ([names.SRC, names.DST] if self.group is None else self.group.names)
        return rows.select(*(f"`{c}`" for c in known))


class OffsetCursor:
    """Offset chunks of an ordered layout."""

    def __init__(self, reader: EdgeReader):
        if not reader.layout.ordered:
            raise InvalidError(f"{reader.layout.value} has no offsets")
        self.reader, self.id = reader, 0

    @property
    def chunk_number(self) -> int:
        return self.id // self.reader.part_size

    def seek(self, vertex: int) -> None:
        if not 0 <= vertex < self.reader.vertex_count():
            raise IndexRangeError(f"no vertex {vertex}")
        self.id = vertex

    def next_chunk(self) -> bool:
        if self.chunk_number + 1 >= self.reader.part_count():
            return False
        self.id = (self.chunk_number + 1) * self.reader.part_size
        return True

    def path(self) -> str:
        return self.reader.prefix + self.reader.info.offset_path(self.reader.layout, self.chunk_number)

    def get(self) -> DataFrame:
        """Offsets from the sought vertex on."""
        return self.reader.offsets(self.chunk_number).filter(F.col("place") >= self.id % self.reader.part_size)
