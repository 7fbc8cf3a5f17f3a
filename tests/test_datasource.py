"""The data source: the tables that readers give, a partition for each chunk, no exchange, filters taken over, writes."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphlake import names
from graphlake.plans.graph import Graph, GraphWriter
from graphlake.plans.info import Layout, PropertyGroup
from graphlake.sources import datasource

KEY = ("v", "e", "v")
N = 45


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    datasource.register(spark)
    at = str(tmp_path_factory.mktemp("ds"))
    people = spark.range(N).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("n, \""), "id")).alias("name"), F.expr("timestamp'2020-01-01' + make_interval(0,0,0,cast(id as int))").alias("seen"), (F.col("id") / 4).alias("x"), F.array("id").alias("ids"))
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % N, i, f"t{i % 4}") for i in range(40)] + [(4, j, -j, None) for j in range(9)], "src long, dst long, w int, t string")
    writer = GraphWriter(spark).put_vertices("v", people, "id").put_edges(KEY, pairs)
    info = writer.infer("g", f"{at}/", 10, 6, layouts=(Layout.BY_SOURCE, Layout.LOOSE_BY_DEST))
    v, e = info.vertices[0], info.edges[0]
    own = {p.name: p for p in v.groups[0].properties}
    w, t = e.groups[0].properties
    groups = (PropertyGroup((own["id"], own["name"])), PropertyGroup((own["seen"], own["x"]), "orc"), PropertyGroup((own["ids"],)))
    return writer.write(replace(info, vertices=(replace(v, groups=groups),), edges=(replace(e, groups=(PropertyGroup((w,), "csv"), PropertyGroup((t,)))),)))


def load(g, **options):
    reader = g.spark.read.format(datasource.NAME)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(f"{g.info.prefix}g.graph.yml")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tables_as_readers_give_them(stored):
    got = load(stored, vertex="v")
    assert rows(got) == rows(stored.vertices("v").table()) and got.rdd.getNumPartitions() == 5
    for layout in (Layout.BY_SOURCE, Layout.LOOSE_BY_DEST):
        reader = stored.edge_reader(KEY, layout)
        got = load(stored, edge="v,e,v", layout=layout.value)
        assert rows(got) == rows(reader.edges(add_index=False)) and got.rdd.getNumPartitions() == sum(reader.chunk_counts())
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # three column groups side by side
    assert rows(load(stored, vertex="v", columns="x")) == rows(stored.vertices("v").table(["x"])) and load(stored, vertex="v", columns="").count() == N
    assert load(stored, edge="v,e,v", columns="t").columns == [names.SRC, names.DST, "t"]


def test_filters_leave_out_chunks(stored):
    some = load(stored, vertex="v").filter(F.col(names.VERTEX).between(12, 25))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 14
    assert load(stored, vertex="v").filter(F.col(names.VERTEX) == 31).rdd.getNumPartitions() == 1
    assert load(stored, vertex="v").filter(F.col(names.VERTEX) > 1_000).count() == 0
    at = load(stored, edge="v,e,v").filter((F.col(names.SRC) >= 20) & (F.col(names.SRC) < 30) & (F.col("w") > 22))
    assert at.rdd.getNumPartitions() == stored.edge_reader(KEY).chunk_count(2) and {r["w"] for r in at.collect()} == set(range(23, 30))
    table = stored.edge_reader(KEY).edges(add_index=False)
    for where in ("t = 't1' AND w <> 5", "t IS NULL", "w IN (1, 2, -3)", "t > 't1' OR w < 0", "t IS NOT NULL AND w <= 3"):
        assert rows(load(stored, edge="v,e,v").filter(where)) == rows(table.filter(where)), where
    people = stored.vertices("v").table()
    for where in ("x > 3.3", "name LIKE 'n%7'", "seen >= timestamp'2020-01-20'", "name = 'n, \"4'"):
        assert rows(load(stored, vertex="v").filter(where)) == rows(people.filter(where)), where


def test_writes_give_files_their_names(spark, stored, tmp_path):
    g = Graph(spark, replace(stored.info, prefix=f"{tmp_path}/"))
    from graphlake.plans.graph import save_info
    from graphlake.sources.fs import Files

    save_info(spark, g.info)
    Files(spark).write_count(f"{tmp_path}/{g.info.vertex('v').count_path()}", N)
    info, people = g.info.vertex("v"), stored.vertices("v").table().cache()
    for k in range(2):  # the second write takes the first one's place
        write = datasource.by_chunk(people.select(names.VERTEX, "id", F.concat("name", F.lit(str(k))).alias("name")), info, 5).write.format(datasource.NAME).mode("overwrite")
        write.option("vertex", "v").option("group", "id,name").save(f"{tmp_path}/g.graph.yml")
        folder = Path(f"{tmp_path}/{info.group_path(info.groups[0])}")
        assert sorted(f.name for f in folder.iterdir()) == [f"chunk{c}" for c in range(5)] and [f.name for f in folder.parent.iterdir() if "-new-" in f.name or "-old-" in f.name] == []
        assert rows(g.vertex_reader("v").group(info.groups[0])) == rows(people.select(names.VERTEX, "id", F.concat("name", F.lit(str(k)))))
    with pytest.raises(Exception, match="several tasks"):
        people.select(names.VERTEX, "id", "name").repartition(4).write.format(datasource.NAME).mode("overwrite").option("vertex", "v").option("group", "id,name").save(f"{tmp_path}/g.graph.yml")
    assert g.vertex_reader("v").group(info.groups[0]).count() == N


def test_many_small_chunks_share_partitions(stored, monkeypatch):
    """Each chunk a task would cost more than its rows."""
    reader = datasource.GraphReader(datasource._Table({"path": f"{stored.info.prefix}g.graph.yml", "edge": "v,e,v"}))
    n = sum(stored.edge_reader(KEY).chunk_counts())
    single = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert len(reader.partitions()) == n > 6
    monkeypatch.setattr(datasource, "MOST_PARTITIONS", 3)
    assert len(reader.partitions()) <= 3 and [b.to_pylist() for p in reader.partitions() for b in reader.read(p)] == single
    monkeypatch.setattr(datasource, "ROWS_SHARED", 1)  # large chunks stay alone
    assert len(reader.partitions()) == n
