"""Chunk files that tasks write under their names, and Spark's writers where folders aren't mounted."""

import datetime as dt
import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlake import names
from graphlake.functions.types import GType
from graphlake.plans.info import Property, PropertyGroup, VertexInfo
from graphlake.sources import chunk_files, fs
from graphlake.sources import writer as writing
from graphlake.sources.fs import Files
from graphlake.sources.reader import VertexReader
from graphlake.sources.writer import VertexWriter

KINDS = {"k": "int64", "t": "string", "x": "double", "b": "bool", "d": "date", "at": "timestamp"}
AT = dt.datetime(2024, 3, 5, 6, 7, 8, 123000)
ROWS = [(k, [None, "", 'say "a", b', "é\\"][k % 4], None if k % 5 == 0 else k / 3, k % 2 == 0, dt.date(1500 + k * 10, 1, 2), AT + dt.timedelta(days=k) if k % 3 else None) for k in range(50)]


def info_of(kind):
    return VertexInfo("v", 3, (PropertyGroup(tuple(Property(n, GType.parse(t), n == "k") for n, t in KINDS.items()), kind),), prefix="vertex/v/")


def stored(spark, at, kind):
    df = spark.createDataFrame(ROWS, "k long, t string, x double, b boolean, d date, at timestamp").repartition(5)
    VertexWriter(f"{at}/", info_of(kind), df).write()
    return VertexReader(spark, f"{at}/", info_of(kind))


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_tasks_write_chunks_as_spark_does(spark, tmp_path, monkeypatch, kind):
    reader = stored(spark, tmp_path / "own", kind)
    found = sorted(map(tuple, reader.all().drop(names.VERTEX).collect()))
    folder = tmp_path / "own" / "vertex" / "v"
    files = [f for f in folder.rglob("*") if f.is_file()]
    # a process for each file, and a file of sums beside it, is what Hadoop's classes make of small chunks
    assert kind == "orc" or sorted(f.name for f in files) == sorted(["vertex_count", *(f"chunk{c}" for c in range(17))])
    assert [r[0] for r in reader.chunk(info_of(kind).groups[0], 4).select(names.VERTEX).collect()] == [12, 13, 14]
    monkeypatch.setattr(Files, "mounted", lambda self, path: None)
    same = sorted(map(tuple, stored(spark, tmp_path / "spark", kind).all().drop(names.VERTEX).collect()))
    assert [r[0] for r in found] == list(range(50)) and found == same


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_small_files_take_one_name(spark, tmp_path, monkeypatch, kind):
    """No rename for each small file; what a lost attempt left there, in part, is replaced."""
    batch = pa.record_batch({"x": pa.array(["a", "b"])})
    renamed = []
    monkeypatch.setattr(chunk_files.os, "replace", lambda a, b, do=os.replace: (renamed.append(b), do(a, b)))
    for name, left in (("chunk0", None), ("chunk1", b"part of")):
        if left is not None:
            (tmp_path / name).write_bytes(left)
        f = chunk_files._File(f"{tmp_path}/{name}", 7, kind, batch.schema, {}, 1 << 20, set())
        f.add(batch)
        f.close()
    assert renamed == [f"{tmp_path}/chunk1"] and sorted(os.listdir(tmp_path)) == ["chunk0", "chunk1"]
    assert (tmp_path / "chunk0").read_bytes() == (tmp_path / "chunk1").read_bytes()


def test_groups_and_labels_in_one_pass(spark, tmp_path, monkeypatch):
    passes, write = [], chunk_files.write
    monkeypatch.setattr(chunk_files, "write", lambda rows, n, number, order, outputs, *more: (passes.append(len(outputs)), write(rows, n, number, order, outputs, *more))[1])
    groups = (PropertyGroup((Property("k", GType.parse("int64"), True),)), PropertyGroup((Property("t", GType.parse("string")),), "csv"))
    df = spark.createDataFrame([(k, f"t{k}", ["even"] if k % 2 == 0 else []) for k in range(10)], f"k long, t string, `{names.LABELS}` array<string>")
    for labels, expected in ((("even", "odd"), [3]), (("even", "t"), [2, 1])):  # the latter is a property's name too
        passes.clear()
        info = VertexInfo("v", 3, groups, labels=labels, prefix="vertex/v/")
        VertexWriter(f"{tmp_path}/{labels[1]}/", info, df).write()
        reader = VertexReader(spark, f"{tmp_path}/{labels[1]}/", info)
        assert passes == expected and sorted(map(tuple, reader.all().collect())) == [(k, k, f"t{k}") for k in range(10)]
        assert sorted(map(tuple, reader.label_flags().collect())) == [(k, k % 2 == 0, False) for k in range(10)]


def test_many_files_are_removed_by_tasks(spark, tmp_path, monkeypatch):
    """One folder of many files goes by several tasks, nested ones too; what a link leads to stays."""
    monkeypatch.setattr(fs, "MANY_FILES", 50)
    monkeypatch.setattr(fs, "FILES_A_TASK", 16)
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "x").write_text("x")
    for at, n in (("g/one", 40), ("g/many/part0", 3), ("g/many/part1", 30), ("few", 49)):
        (tmp_path / at).mkdir(parents=True)
        for k in range(n):
            (tmp_path / at / f"chunk{k}").write_text("x")
    (tmp_path / "g" / "link").symlink_to(tmp_path / "kept")
    shares = fs._shares(f"{tmp_path}/g")
    assert len(shares) >= 4 and fs._shares(f"{tmp_path}/few") == []
    for share in shares:
        fs._remove(share)
    assert not [f for f in (tmp_path / "g").rglob("chunk*")]
    for k in range(60):
        (tmp_path / "g" / f"chunk{k}").write_text("x")
    Files(spark).delete(f"file:{tmp_path}/g")
    assert not (tmp_path / "g").exists() and (tmp_path / "kept" / "x").exists()


def test_times_in_orc(spark, tmp_path):
    """Times by the wall clock, as Spark has them in this format."""
    df = spark.createDataFrame([r for r in ROWS if r[0] > 20], "k long, t string, x double, b boolean, d date, at timestamp").filter("d > '1700-01-01'").drop("t", "x", "b")
    info = VertexInfo("v", 3, (PropertyGroup(tuple(Property(n, GType.parse(KINDS[n]), n == "k") for n in ("k", "d", "at")), "orc"),), prefix="vertex/v/")
    VertexWriter(f"{tmp_path}/", info, df).write()
    assert not list(tmp_path.rglob("*chunk*.crc"))
    assert sorted(map(tuple, VertexReader(spark, f"{tmp_path}/", info).all().drop(names.VERTEX).collect())) == sorted(map(tuple, df.collect()))


def test_many_small_chunks_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Beyond MOST_TASKS chunks, Spark's writer is given that many tasks: adaptive execution would leave all to one."""
    monkeypatch.setattr(Files, "mounted", lambda self, path: None)
    monkeypatch.setattr(writing, "MOST_TASKS", 4)
    kept, save = [], writing.VertexWriter._save
    monkeypatch.setattr(writing.VertexWriter, "_save", lambda self, rows, kind, path, *by: (save(self, rows, kind, path, *by), kept.append({f.name.split("-")[1] for f in Path(path).rglob("part-*")})))
    reader = stored(spark, tmp_path, "parquet")
    assert len(kept[0]) == 4 and reader.all().agg(F.sum("k")).head()[0] == sum(range(50))
