"""Appending edges to a stored layout: new edges are merged into the parts that they touch, other files stay.

Within a part, rows before the first place where an edge goes in keep their chunks; the chunks from there on are read,
merged with the new edges and written again. Offsets of a touched part are its old ones and the sums of new degrees.

All new files are written to a folder beside the layout first. A journal then names that folder, and its files are
moved to their places; whoever comes next finishes the moves that a journal finds undone. A marker, moved with them,
names the batch, so a batch that is repeated changes nothing. While a journal is there, readers may see parts of a
batch; a batch that failed before it leaves nothing to see.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import names
from ..errors import InvalidError, MissingKeyError
from ..functions import scalars
from ..operators import layout as lay
from ..operators.ranking import number_within
from ..plans.info import EdgeInfo, Layout
from ..session import cut
from .reader import KEYS, EdgeReader
from .writer import CHUNK, NUMBER, PART, POSITION, _Sink, validate_edges

_NEW, _PLACE, _DEGREE, _FIRST = map(names.hidden, ("new", "place", "degree", "first"))
#: Where a stored row stood: its chunk and its place there.
_WAS = [names.hidden("was_chunk"), names.hidden("was_row")]


class EdgeAppender(_Sink):
    """Appends to one edge type in one layout, which must be there, and may be empty."""

    def __init__(self, spark: SparkSession, prefix: str, info: EdgeInfo, layout: Layout, **settings):
        super().__init__(spark, prefix, **settings)
        info.validate()
        self.info, self.layout, self.adj = info, layout, info.adj_list(layout)
        self.part_size, self.root = info.part_size(layout), self.prefix + info.layout_path(layout)
        self.journal, self.marker = f"{self.root}append_journal", "last_append"
        self.main, self.other = lay.ends(layout)

    def recover(self) -> None:
        """Finishes the moves of a batch that was written in full."""
        if not self.files.exists(self.journal):
            return
        staged = self.files.read_text(self.journal).strip()
        left = self.files.below(staged)
        # what counts rows goes last: rows beyond the counts aren't asked for
        for path in sorted(left, key=lambda f: (f == self.marker, "/" not in f, f.startswith("offset/"), f)):
            self.files.move(f"{staged}/{path}", self.root + path)
        self.files.delete(self.journal)
        self.files.delete(staged)

    def last_batch(self) -> int | None:
        path = self.root + self.marker
        return int(self.files.read_text(path)) if self.files.exists(path) else None

    def append(self, edges: DataFrame, vertices: int | None = None, batch: int | None = None) -> int:
        """Merges edges (both ids, and all properties) in; returns how many the layout has then.

        vertices: how many the aligned end has now, if it grew. batch: a number that grows from batch to batch.
        Edges are kept as they come, repeated ones too. Null ends, and ends that are no vertex of the aligned type,
        are refused before anything is written.
        """
        self.recover()
        reader = EdgeReader(self.spark, self.prefix, self.info, self.layout)
        before = reader.vertex_count()
        reader.count()  # of all parts at once: most are touched
        now = max(before, vertices or 0)
        if batch is not None and (last := self.last_batch()) is not None and last >= batch:
            return reader.count()
        new = cut(self._typed(edges))
        touched = self._touched(new, now)
        if not touched and now == before and batch is None:
            return reader.count()
        firsts = self._firsts(reader, touched, before)
        staged = f"{self.prefix}append-{uuid.uuid4().hex}"
        try:
            self._stage_rows(reader, new, touched, firsts, before, staged)
            parts = sorted({*touched, *range(lay.chunks(before, self.part_size), lay.chunks(now, self.part_size))})
            if self.layout.ordered:
                self._stage_offsets(reader, new, parts, before, staged)
            held = lambda part: reader.count(part) if part < reader.part_count() else 0
            self.files.write_counts([(f"{staged}/edge_count{part}", held(part) + touched.get(part, (0, 0))[0]) for part in parts])
            self.files.write_count(f"{staged}/vertex_count", now)
            if batch is not None:
                self.files.write_text(f"{staged}/{self.marker}", str(batch))
        except BaseException:
            self.files.delete(staged)
            raise
        spare = f"{self.prefix}tmp-journal-{uuid.uuid4().hex}"
        self.files.write_text(spare, staged)
        self.files.move(spare, self.journal)
        self.recover()
        return EdgeReader(self.spark, self.prefix, self.info, self.layout).count()

    def _typed(self, edges: DataFrame) -> DataFrame:
        edges = names.to_own(edges, [names.SRC, names.DST])
        names.refuse_hidden(edges.columns)
        if missing := [c for c in (names.SRC, names.DST) if c not in edges.columns]:
            raise MissingKeyError(f"edges have no {missing}")
        validate_edges(edges, self.info, self.level)
        typed = [F.col(f"`{p.name}`").cast(p.field.dataType).alias(p.name) for g in self.info.groups for p in g.properties]
        return edges.select(F.col(names.SRC).cast("long"), F.col(names.DST).cast("long"), *typed).withColumn(PART, scalars.chunk_of(F.col(self.main), self.part_size))

    def _touched(self, new: DataFrame, vertices: int) -> dict[int, tuple[int, int]]:
        """Edges that go into each part and the smallest aligned end of them; a row per touched part comes to the driver."""
        bad = F.count_if(F.col(self.main).isNull() | F.col(self.other).isNull() | (F.col(self.main) < 0) | (F.col(self.other) < 0) | (F.col(self.main) >= vertices))
        rows = new.groupBy(PART).agg(F.count("*"), F.min(self.main), bad).collect()
        if any(r[3] for r in rows):
            raise InvalidError("edge ends must be ids of vertices")
        return {r[0]: (r[1], r[2]) for r in rows}

    def _firsts(self, reader: EdgeReader, touched: dict[int, tuple[int, int]], before: int) -> dict[int, int]:
        """The first chunk of each touched part that isn't what it was."""
        size, there = self.info.chunk_size, [p for p in touched if p < lay.chunks(before, self.part_size)]
        if not self.layout.ordered:
            return {p: (reader.count(p) if p in there else 0) // size for p in touched}
        places = self.spark.createDataFrame([(p, touched[p][1] - p * self.part_size) for p in there], f"{lay.PART} long, place long")
        found = reader.all_offsets(there).join(F.broadcast(places), [lay.PART, "place"]).collect() if there else []
        return dict.fromkeys(touched, 0) | {r[lay.PART]: r[names.OFFSET] // size for r in found}

    def _stage_rows(self, reader: EdgeReader, new: DataFrame, touched: dict, firsts: dict[int, int], before: int, staged: str) -> None:
        parts = [p for p in sorted(touched) if p < reader.part_count()]
        chunks = [(p, c) for p in parts for c in range(firsts[p], reader.chunk_count(p))]
        old = reader.chunk_edges(chunks, keyed=True).withColumnsRenamed(dict(zip(KEYS, (PART, *_WAS), strict=True))).withColumn(_NEW, F.lit(0))
        rows = old.unionByName(new.withColumns({**dict.fromkeys(_WAS, F.lit(None).cast("long")), _NEW: F.lit(1)}))
        ties = [n for g in self.info.groups for n in g.names]
        # loose layouts keep what they have and go on after it
        order = [self.main, self.other, *ties] if self.layout.ordered else [_NEW, *_WAS, *(ties or [self.main])]
        placed = number_within(rows, [F.col(PART)], [F.col(f"`{c}`") for c in order], POSITION)
        first = self.spark.createDataFrame(list(firsts.items()), f"{PART} long, {_FIRST} long")
        # one row per touched part
        placed = placed.join(F.broadcast(first), PART).withColumn(CHUNK, scalars.chunk_of(F.col(POSITION), self.info.chunk_size) + F.col(_FIRST)).drop(_FIRST, _NEW, *_WAS)
        placed = cut(placed)
        held = {p: reader.count(p) for p in parts}
        spans = [(p, firsts[p], lay.chunks(held.get(p, 0) + touched[p][0], self.info.chunk_size)) for p in sorted(touched)]
        keys = [PART, CHUNK, POSITION]
        tail = lambda path: path[len(self.info.layout_path(self.layout)) :]
        if touched:
            outputs = [([names.SRC, names.DST], self.adj.file_type, f"{staged}/{tail(self.info.adj_path(self.layout))}")]
            outputs += [(g.names, g.file_type, f"{staged}/{tail(self.info.group_path(g, self.layout))}") for g in self.info.groups]
            self._part_chunks(placed.select(names.SRC, names.DST, *(f"`{n}`" for n in ties), *keys), spans, outputs)

    def _stage_offsets(self, reader: EdgeReader, new: DataFrame, parts: list[int], before: int, staged: str) -> None:
        """Old offsets and the sums of new degrees before each place; a window holds a part's places."""
        there = [p for p in parts if p < lay.chunks(before, self.part_size)]
        fresh = self.spark.createDataFrame([(p,) for p in parts if p not in set(there)], f"{lay.PART} long")
        zero = fresh.select(lay.PART, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.part_size).cast("long"))).alias("place"), F.lit(0).cast("long").alias(names.OFFSET))
        old = reader.all_offsets(there).unionByName(zero) if there else zero
        place = scalars.place_in_chunk(F.col(self.main), self.part_size) + 1
        degrees = new.groupBy(F.col(PART).alias(lay.PART), place.alias("place")).agg(F.count("*").alias(_DEGREE))
        run = Window.partitionBy(lay.PART).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = old.join(degrees, [lay.PART, "place"], "left").withColumn(names.OFFSET, (F.col(names.OFFSET) + F.coalesce(F.sum(_DEGREE).over(run), F.lit(0))).cast("long"))
        number = self.spark.createDataFrame(list(enumerate(parts)), f"{NUMBER} long, {lay.PART} long")
        rows = rows.join(F.broadcast(number), lay.PART).select(NUMBER, F.col("place").alias(_PLACE), names.OFFSET)
        self._chunks(rows, len(parts), [_PLACE], [([names.OFFSET], self.adj.file_type, f"{staged}/offset")], lambda k: f"chunk{parts[k]}")
