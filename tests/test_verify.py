"""Checks of stored graphs: sound ones have no fault, and each planted one is named."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphlake import names
from graphlake.cli import main as cli
from graphlake.operators import verify
from graphlake.plans.graph import Graph, GraphWriter
from graphlake.plans.info import Layout
from graphlake.sources.fs import Files

KEY = ("v", "e", "v")
N = 23


@pytest.fixture
def stored(spark, tmp_path):
    people = spark.range(N).withColumn(names.LABELS, F.when(F.col("id") % 2 == 0, F.array(F.lit("even"))))
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % N, i) for i in range(18)] + [(4, j, j) for j in range(9)], "src long, dst long, w int")
    writer = GraphWriter(spark).put_vertices("v", people, "id", ("even",)).put_edges(KEY, pairs)
    return writer.write(writer.infer("g", f"{tmp_path}/", 10, 4, layouts=(Layout.BY_SOURCE, Layout.LOOSE_BY_DEST)))


def found(g):
    return {(r["what"], r["part"], r["chunk"], r["found"], r["expected"]) for r in verify.faults(Graph.load(g.spark, f"{g.info.prefix}g.graph.yml")).collect()}


def rewrite(path, change):
    """A chunk file with its rows changed."""
    at = Path(path)
    rows = change(pq.read_table(at).to_pylist())
    schema = pq.read_schema(at)
    at.with_name(f".{at.name}.crc").unlink(missing_ok=True)
    pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([pa.field(f.name, f.type) for f in schema])), at)


def test_sound_and_swapped_rows(spark, stored, tmp_path, capsys):
    assert found(stored) == set()
    path = f"{tmp_path}/g.graph.yml"
    assert cli(["check", "-p", path, "--data"]) == 0 and "files sound" in capsys.readouterr().out
    rewrite(f"{tmp_path}/edge/v_e_v/ordered_by_source/adj_list/part0/chunk0", lambda rows: [rows[1], rows[0], *rows[2:]])
    got = found(stored)
    assert ("edges_begin", 0, 0, 1, 0) in got and ("edges_begin", 0, 1, 0, 1) in got and {w for w, *_ in got} <= {"edges_begin", "edges_end", "edges_apart"}
    assert cli(["check", "-p", path]) == 0 and cli(["check", "-p", path, "--data"]) == 1 and "edges_begin of v_e_v:ordered_by_source, part 0, chunk 0: 1, not 0" in capsys.readouterr().err


def test_faults_of_files(spark, stored, tmp_path):
    edge, files = f"{tmp_path}/edge/v_e_v/ordered_by_source", Files(spark)
    # an end beyond the last vertex, a group's chunk with a row too few, a chunk that isn't there
    rewrite(f"{edge}/adj_list/part1/chunk0", lambda rows: [rows[0] | {names.DST: N}, *rows[1:]])
    rewrite(f"{edge}/w/part0/chunk1", lambda rows: rows[:-1])
    held = stored.edge_reader(KEY).count(0)
    files.delete(f"{edge}/adj_list/part0/chunk2")
    files.write_count(f"{edge}/edge_count2", 9)
    # offsets that are too short, a vertex that isn't where it should be, one that is there twice
    rewrite(f"{edge}/offset/chunk2", lambda rows: rows[:-1])
    rewrite(f"{tmp_path}/vertex/v/id/chunk1", lambda rows: [*rows[:3], rows[4], *rows[4:]])
    rewrite(f"{tmp_path}/vertex/v/labels/chunk2", lambda rows: [rows[0] | {names.VERTEX: 5}, *rows[1:]])
    got = found(stored)
    assert {("edge_end", 1, 0, 1, 0), ("group_rows", 0, 1, 3, 4), ("group_rows", 0, 2, 4, 0), ("chunk_numbers", 0, None, -(-held // 4), -(-(held - 4) // 4)), ("edge_count", 0, None, held, held - 4), ("edge_count", 2, None, 9, 0)} <= got
    assert {("offset_rows", 2, None, 10, 11), ("vertex_repeats", 1, None, 9, 10), ("vertex_first", 2, None, 5, 20)} <= got
    assert not [x for x in got if x[0] == "edge_part"]
    rewrite(f"{edge}/adj_list/part1/chunk0", lambda rows: [rows[0] | {names.SRC: 2}, *rows[1:]])
    assert ("edge_part", 1, 0, 1, 0) in found(stored)
