"""Small chunks of edges: written in one pass for all column groups, and read side by side by tasks."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphlake import names
from graphlake.plans.graph import GraphWriter
from graphlake.plans.info import Layout, PropertyGroup
from graphlake.sources import chunk_files, chunk_reads

KEY = ("v", "e", "v")
AT = dt.datetime(2024, 3, 5, 6, 7, 8, 123000)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two column groups in Parquet and ORC, an end without edges, and a hub; `passes`: what each pass over rows wrote."""
    passes, write = [], chunk_files.write
    rows = [(s, d, s / (d + 1), None if d % 5 == 0 else f"t{d}", AT + dt.timedelta(days=s, hours=d)) for s in range(40) for d in range(40) if s == 3 or (s * d) % 7 == 1]
    writer = GraphWriter(spark).put_vertices("v", spark.range(40).withColumnRenamed("id", "k"), "k").put_edges(KEY, spark.createDataFrame(rows, "s long, d long, w double, t string, at timestamp"))
    info = writer.infer("g", f"{tmp_path_factory.mktemp('small')}/", 4, 5, layouts=(Layout.BY_SOURCE,))
    w, t, at = info.edges[0].groups[0].properties
    info = replace(info, edges=(replace(info.edges[0], groups=(PropertyGroup((w, t), "parquet"), PropertyGroup((at,), "orc"))),))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(chunk_files, "write", lambda rows, n, number, order, outputs, *more: (passes.append([o.folder for o in outputs]), write(rows, n, number, order, outputs, *more))[1])
        return writer.write(info), passes, sorted(map(repr, rows))


def test_groups_are_written_in_one_pass(stored):
    _, passes, _ = stored
    assert sorted(map(len, passes)) == [1, 1, 3]  # vertices, offsets, and edges with both groups


def test_groups_are_read_side_by_side(spark, stored, monkeypatch):
    g, _, rows = stored
    reader = g.edge_reader(KEY)

    def read():
        tables = [reader.edges(), reader.group(reader.info.groups[0]), reader.all_groups(), reader.adj_list(), reader.edges(parts=range(0, 3), columns=["at"]), reader.all_offsets(), reader.chunk_edges([(0, 1), (2, 0)], ["at"], keyed=True)]
        return tables, [sorted(map(repr, df.collect())) for df in tables]

    tables, found = read()
    plan = tables[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FileScan" not in plan and "SortMergeJoin" not in plan
    assert sorted(map(repr, map(tuple, tables[0].drop(names.EDGE).collect()))) == rows
    assert [r[0] for r in tables[0].orderBy(names.SRC, names.DST).select(names.EDGE).collect()] == list(range(len(rows)))
    monkeypatch.setattr(chunk_reads, "MOST_ROWS", 0)
    assert read()[1] == found  # as Spark reads them


def test_a_group_without_a_chunk_is_an_error(stored):
    g, _, _ = stored
    reader = g.edge_reader(KEY)
    path = f"{reader.prefix}{reader.info.group_path(reader.info.groups[0], Layout.BY_SOURCE, 0, 1)}"
    reader.files.move(path, f"{path}-away")
    try:
        with pytest.raises(Exception, match="no file"):
            reader.edges().agg(F.count("w")).collect()
    finally:
        reader.files.move(f"{path}-away", path)


def test_what_tasks_read_is_not_broadcast(stored, monkeypatch):
    """The planner doesn't take it for as small as the chunks' numbers: not at first, nor from an exchange of these once that has run."""
    monkeypatch.setattr(chunk_reads, "FEW_FILES", 0)
    reader = stored[0].edge_reader(KEY)
    for rows in (reader.edges(add_index=False), reader.edges(add_index=False, parts=range(0, 3)), reader.chunk_edges([(0, 0), (0, 1)]), reader.all_offsets(), reader.all_offsets([0, 2])):
        plan = rows._jdf.queryExecution()
        assert int(plan.optimizedPlan().stats().sizeInBytes()) > 1 << 40
        assert "MapInArrow" in plan.executedPlan().toString() and "Exchange" not in plan.executedPlan().toString()


def test_few_chunks_are_left_to_spark(stored):
    g, _, _ = stored
    few, many = (g.edge_reader(KEY).chunk_edges([(0, 1), (2, 0)] * n, ["w"]) for n in (1, chunk_reads.FEW_FILES))
    assert len(few.inputFiles()) == 4 and many.inputFiles() == []
