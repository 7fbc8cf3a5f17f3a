"""Edges appended to stored layouts: against one write of all, files that stay, repeated and failed batches."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphlake import names
from graphlake.errors import InvalidError, StorageError
from graphlake.plans.graph import GraphWriter
from graphlake.plans.info import Layout, PropertyGroup
from graphlake.sources.appender import EdgeAppender
from graphlake.sources.fs import Files
from graphlake.sources.reader import EdgeReader

KEY = ("v", "e", "v")
SCHEMA = "src long, dst long, w int, t string"
N = 40
OLD = [(i, (i * 7 + 3) % N, i, "a") for i in range(30)] + [(3, j, j, "b") for j in range(12)]
NEW = [(3, 5, 5, "b"), (3, 20, 1, "n"), (38, 1, 2, None), (0, 39, 3, "n"), (0, 39, 3, "n")]


def make(spark, path, edges, layouts, kind="parquet", n=N):
    writer = GraphWriter(spark).put_vertices("v", spark.range(n), "id").put_edges(KEY, spark.createDataFrame(edges, SCHEMA).repartition(2))
    info = writer.infer("g", f"{path}/", 10, 4, kind, layouts)
    edge = info.edges[0]
    w, t = edge.groups[0].properties
    return writer.write(replace(info, edges=(replace(edge, groups=(PropertyGroup((w,), kind), PropertyGroup((t,), kind))),)))


def state(reader: EdgeReader):
    """All that a layout holds: rows in order, offsets and counts."""
    rows = [tuple(r) for r in reader.edges().orderBy(names.EDGE).collect()]
    offsets = sorted(map(tuple, reader.all_offsets().collect())) if reader.layout.ordered else []
    return rows, offsets, [reader.count(p) for p in range(reader.part_count())]


def stamps(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def test_as_one_write_of_all(spark, tmp_path):
    layouts = (Layout.BY_SOURCE, Layout.BY_DEST)
    g, whole = make(spark, tmp_path / "a", OLD, layouts), make(spark, tmp_path / "b", OLD + NEW, layouts)
    assert g.append_edges(KEY, spark.createDataFrame(NEW, SCHEMA).withColumnsRenamed({"src": names.SRC, "dst": names.DST})) == {x: len(OLD) + len(NEW) for x in layouts}
    for x in layouts:
        assert state(g.edge_reader(KEY, x)) == state(whole.edge_reader(KEY, x))
    assert not [f for f in Path(tmp_path / "a").iterdir() if f.name.startswith(("append-", "tmp-"))]


def test_loose_layouts_go_on_after_what_they_have(spark, tmp_path):
    g = make(spark, tmp_path, OLD, (Layout.LOOSE_BY_SOURCE,))
    before = state(g.edge_reader(KEY))[0]
    g.append_edges(KEY, spark.createDataFrame(NEW, SCHEMA))  # ends as keys
    rows, _, counts = state(g.edge_reader(KEY))
    key = lambda r: (r[0], r[1], r[2], r[3] or "")
    assert sorted((r[1:] for r in rows), key=key) == sorted([*OLD, *NEW], key=key)
    for part in range(4):
        own, was = ([r[1:] for r in x if r[1] // 10 == part] for x in (rows, before))
        assert own[: len(was)] == was and counts[part] == len(own)


def test_untouched_parts_and_chunks_keep_their_files(spark, tmp_path):
    g = make(spark, tmp_path, OLD, (Layout.BY_SOURCE,))
    before = stamps(tmp_path)
    g.append_edges(KEY, spark.createDataFrame([(9, 0, 0, "x"), (25, 1, 1, "y")], SCHEMA))
    changed = {f.split("ordered_by_source/")[1] for f, t in stamps(tmp_path).items() if before.get(f) != t}
    parts = {p for f in changed for p in [f.split("part")[1].split("/")[0] if "part" in f else None] if p}
    assert parts == {"0", "2"}
    # vertex 9 is the last of part 0: only the chunks from its edges on are written
    held = sum(s < 9 for s, *_ in OLD) // 4
    assert {f for f in changed if f.startswith("adj_list/part0/")} == {f"adj_list/part0/chunk{k}" for k in range(held, -(-(sum(s < 10 for s, *_ in OLD) + 1) // 4))}
    assert {f for f in changed if f.startswith("offset/")} == {"offset/chunk0", "offset/chunk2"}
    assert {f for f in changed if f.startswith("edge_count")} == {"edge_count0", "edge_count2"}


def test_a_batch_goes_in_once(spark, tmp_path):
    g = make(spark, tmp_path, OLD, (Layout.BY_SOURCE, Layout.BY_DEST))
    new = spark.createDataFrame(NEW, SCHEMA)
    first = g.append_edges(KEY, new, 4)
    assert g.append_edges(KEY, new, 4) == first == g.append_edges(KEY, new, 3)
    assert set(g.append_edges(KEY, new, 5).values()) == {len(OLD) + 2 * len(NEW)}


@pytest.mark.parametrize("fails_at", [0, 5])
def test_a_batch_that_failed_is_finished(spark, tmp_path, monkeypatch, fails_at):
    """Before the journal nothing has changed; after it, the next try moves what is left."""
    g, whole = make(spark, tmp_path / "a", OLD, (Layout.BY_SOURCE,)), make(spark, tmp_path / "b", OLD + NEW, (Layout.BY_SOURCE,))
    before, move, calls = state(g.edge_reader(KEY)), Files.move, []

    def failing(self, source, target):
        calls.append(target)
        if len(calls) == fails_at + 1:
            raise StorageError("lost")
        move(self, source, target)

    monkeypatch.setattr(Files, "move", failing)
    new = spark.createDataFrame(NEW, SCHEMA)
    with pytest.raises(StorageError):
        g.append_edges(KEY, new, 1)
    monkeypatch.undo()
    if fails_at == 0:
        assert state(g.edge_reader(KEY)) == before
    assert g.append_edges(KEY, new, 1) == {Layout.BY_SOURCE: len(OLD) + len(NEW)}
    assert state(g.edge_reader(KEY)) == state(whole.edge_reader(KEY))


def test_vertices_that_were_added(spark, tmp_path):
    layouts = (Layout.BY_SOURCE, Layout.LOOSE_BY_DEST)
    g, whole = make(spark, tmp_path / "a", OLD, layouts), make(spark, tmp_path / "b", [*OLD, (64, 2, 1, "z")], layouts, n=71)
    ids = spark.createDataFrame([(64, 2, 1, "z")], f"{names.SRC} long, {names.DST} long, w int, t string")
    with pytest.raises(InvalidError):
        EdgeAppender(spark, f"{tmp_path}/a/", g.info.edge(*KEY), Layout.BY_SOURCE).append(ids)
    for x in layouts:
        EdgeAppender(spark, f"{tmp_path}/a/", g.info.edge(*KEY), x).append(ids, 71)
        assert state(g.edge_reader(KEY, x))[1:] == state(whole.edge_reader(KEY, x))[1:]
        assert state(g.edge_reader(KEY, x))[0] == state(whole.edge_reader(KEY, x))[0] or not x.ordered
    assert EdgeAppender(spark, f"{tmp_path}/a/", g.info.edge(*KEY), Layout.BY_SOURCE).append(ids.limit(0), 71, 8) == len(OLD) + 1


def test_bad_ends_change_nothing(spark, tmp_path):
    g = make(spark, tmp_path, OLD, (Layout.BY_SOURCE,))
    before = stamps(tmp_path)
    for s, d in ((None, 1), (1, None), (-1, 1), (N, 1)):
        with pytest.raises(InvalidError):
            g.append_edges(KEY, spark.createDataFrame([(s, d, 1, "a")], f"{names.SRC} long, {names.DST} long, w int, t string"), 1)
    assert stamps(tmp_path) == before
    assert g.append_edges(KEY, spark.createDataFrame([(999, 1, 1, "a")], SCHEMA)) == {Layout.BY_SOURCE: len(OLD)}  # no such key


def test_append_to_an_empty_layout(spark, tmp_path):
    g = make(spark, tmp_path, OLD, (Layout.BY_SOURCE,))
    empty = GraphWriter(spark).put_vertices("v", spark.range(N), "id").put_edges(KEY, spark.createDataFrame([], SCHEMA))
    other = empty.write(replace(g.info, prefix=f"{tmp_path}/empty/"))
    other.append_edges(KEY, spark.createDataFrame(OLD, SCHEMA).withColumn("extra", F.lit(1)))
    assert state(other.edge_reader(KEY)) == state(g.edge_reader(KEY))


def test_files_of_mounted_folders_move_without_hadoop(spark, tmp_path, monkeypatch):
    """A file, and Hadoop's sum of it, take the place of another; counts are written and read in one go."""
    files, at = Files(spark), f"file://{tmp_path}"
    files.write_counts([(f"{at}/a/n{k}", 10 * k) for k in range(3)])
    assert files.read_counts([f"{at}/a/n{k}" for k in range(5)]) == [0, 10, 20, 0, 0] and files.read_count(f"{at}/a/n2") == 20
    for name in ("a/.n1.crc", "a/.n2.crc"):
        (tmp_path / name).write_text(name)
    monkeypatch.setattr(Files, "_at", lambda *_: pytest.fail("asks Hadoop"))
    assert files.below(f"{at}/a/") == ["n0", "n1", "n2"] and files.below(f"{at}/x") == []
    files.move(f"{at}/a/n2", f"{at}/b/c/n")
    files.move(f"{at}/a/n1", f"{tmp_path}/a/n0")
    assert sorted(f.relative_to(tmp_path).as_posix() for f in tmp_path.rglob("*") if f.is_file()) == ["a/.n0.crc", "a/n0", "b/c/.n.crc", "b/c/n"]
    assert files.read_counts([f"{at}/a/n0", f"{at}/b/c/n"]) == [10, 20]
    files.write_counts([(f"{at}/a/n0", 7)])
    assert not (tmp_path / "a/.n0.crc").exists() and files.read_count(f"{at}/a/n0") == 7
