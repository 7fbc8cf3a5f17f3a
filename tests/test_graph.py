"""Stored graphs: round trips of every format and layout, pruning, cursors, builders, transforms and imports."""

import pytest
from pyspark.sql import functions as F

from graphlake import names
from graphlake.cli import main as cli
from graphlake.errors import IndexRangeError, InvalidError, MissingKeyError, StorageError, TypeMismatchError
from graphlake.functions.expressions import Property as P
from graphlake.functions.expressions import lift
from graphlake.functions.types import Cardinality, GType
from graphlake.plans.graph import Graph, GraphWriter, relayout, transform
from graphlake.plans.info import AdjList, EdgeInfo, Layout, Property, PropertyGroup, ValidateLevel, VertexInfo
from graphlake.sources.builders import EdgeBuilder, VertexBuilder
from graphlake.sources.connectors import NEBULA_FORMAT, Connector, cypher_edges
from graphlake.sources.cursors import EdgeCursor, OffsetCursor, VertexCursor
from graphlake.sources.importer import import_edge_list, import_graph
from graphlake.sources.reader import VertexReader
from graphlake.sources.writer import VertexWriter
from graphlake.streaming.append import append_batch

KEY = ("person", "knows", "person")
PEOPLE = [(10 * i, f"n{i}", ["even"] if i % 2 == 0 else ["odd", "big"] if i > 20 else ["odd"]) for i in range(25)]
PAIRS = sorted({(10 * ((i * 7) % 25), 10 * ((i * 11 + 3) % 25), i) for i in range(60)} - {(0, 0, 0)}) + [(9999, 0, 1)]


def make(spark, path, file_type="parquet", layouts=tuple(Layout)):
    people = spark.createDataFrame(PEOPLE, f"id long, name string, `{names.LABELS}` array<string>")
    pairs = spark.createDataFrame(PAIRS, "src long, dst long, w int")
    writer = GraphWriter(spark).put_vertices("person", people, "id", ("even", "odd", "big")).put_edges(KEY, pairs, "src", "dst")
    return writer.write(writer.infer("g", str(path) + "/", 4, 5, file_type, layouts))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("g"))


def expected():
    return sorted((s // 10, d // 10, w) for s, d, w in PAIRS if s != 9999)


@pytest.mark.parametrize("kind", ["orc", "csv", "json"])
def test_formats(spark, tmp_path, kind):
    g = make(spark, tmp_path, kind, (Layout.BY_SOURCE,))
    back = Graph.load(spark, f"{tmp_path}/g.graph.yml")
    assert [(r["id"], r["name"]) for r in back.vertices("person").table().orderBy(names.VERTEX).collect()] == [(i, n) for i, n, _ in PEOPLE]
    rows = back.edge_reader(KEY).edges().orderBy(names.EDGE).collect()
    assert [tuple(r)[1:] for r in rows] == expected() and [r[0] for r in rows] == list(range(len(rows)))
    assert g.edge_reader(KEY).offsets(0).count() == 5


def test_layouts(stored):
    for layout in Layout:
        reader = stored.edge_reader(KEY, layout)
        rows = reader.edges().orderBy(names.EDGE).collect()
        assert sorted(tuple(r)[1:] for r in rows) == expected() and reader.count() == len(expected())
        side = 1 if layout.by_source else 2
        assert [r[side] // 4 for r in rows] == sorted(r[side] // 4 for r in rows)
        if layout.ordered:
            assert [(r[side], r[3 - side]) for r in rows] == sorted((r[side], r[3 - side]) for r in rows)
        sizes = [reader.adj_chunk(p, c).count() for p in range(reader.part_count()) for c in range(reader.chunk_count(p))]
        assert max(sizes) <= 5 and sum(sizes) == len(rows)
    with pytest.raises(InvalidError):
        stored.edge_reader(KEY, Layout.LOOSE_BY_DEST).offsets(0)


def test_neighbours_and_ranges(stored):
    for v in (0, 7, 24):
        want = sorted(d for s, d, _ in expected() if s == v)
        for layout in Layout:
            assert sorted(r[1] for r in stored.edges(KEY, layout).out_edges(v).collect()) == want
        begin, end = stored.edges(KEY, Layout.BY_SOURCE).adjacency_range(v)
        assert end - begin == len(want)
        assert sorted(r[0] for r in stored.edges(KEY, Layout.BY_DEST).in_edges(v).collect()) == sorted(s for s, d, _ in expected() if d == v)
    some = stored.edges(KEY, Layout.BY_SOURCE).between(1, 3)
    assert sorted(tuple(r) for r in some.table().collect()) == [e for e in expected() if 1 <= e[0] // 4 < 3] and some.count() == some.table().count()
    first = next(iter(stored.edges(KEY, Layout.BY_SOURCE)))
    assert (first.source, first.destination, first.property("w")) == expected()[0]


def test_pruning(stored):
    plan = stored.vertices("person").with_property(P("name") == "n3").table(["name"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(name), EqualTo(name,n3)]" in plan
    assert stored.edge_reader(KEY, Layout.BY_SOURCE).edges(2, columns=[], add_index=False).inputFiles()[0].rsplit("/", 2)[1] == "part2"


def test_labels(stored):
    people = stored.vertices("person")
    ids = lambda v: sorted(r[0] for r in v.ids().collect())
    assert ids(people.with_label("even")) == [i for i in range(25) if i % 2 == 0]
    assert ids(people.with_label("odd", "big")) == [21, 23] == ids(people.with_label("odd").with_label("big"))
    assert ids(people.with_label("even", "odd")) == []
    assert ids(people.with_label("odd").with_property(P("id") > 200)) == [21, 23]
    with pytest.raises(MissingKeyError):
        people.with_label("none")
    v = people.find(23)
    assert v.id == 23 and v.labels() == ["odd", "big"] and v.has_label("big") and v.property("name") == "n23" and v.is_valid("name")
    with pytest.raises(MissingKeyError):
        v.property("none")
    assert [r[names.LABELS] for r in stored.vertex_reader("person").with_labels().orderBy(names.VERTEX).collect()] == [x for _, _, x in PEOPLE]
    assert [x.id for x in people][:3] == [0, 1, 2]


def test_cursors(stored):
    reader = stored.vertex_reader("person")
    cursor = VertexCursor.for_properties(reader, ["name"], P("name") != "n6")
    cursor.seek(5)
    assert [r["name"] for r in cursor.get().orderBy(names.VERTEX).collect()] == ["n5", "n7"] and cursor.path().endswith("id_name/chunk1")
    steps = 1
    while cursor.next_chunk():
        steps += 1
    assert steps == 6 and cursor.chunk_count() == 7
    with pytest.raises(IndexRangeError):
        cursor.seek(25)
    with pytest.raises(InvalidError):
        VertexCursor(reader, reader.info.groups[0], ["age"])
    flags = VertexCursor(reader, None, ["big"])
    assert flags.get().columns == [names.VERTEX, "big"]
    edges = EdgeCursor(stored.edge_reader(KEY, Layout.BY_SOURCE))
    edges.seek_src(9)
    first = edges.get().first()
    assert first[0] == next(s for s, _, _ in expected() if s >= 9)
    edges.seek_chunk(0, 0)
    total = edges.rows_in_chunk()
    while edges.next_chunk():
        total += edges.rows_in_chunk()
    assert total == len(expected())
    with pytest.raises(InvalidError):
        edges.seek_dst(3)
    group = stored.info.edge(*KEY).groups[0]
    weights = EdgeCursor(stored.edge_reader(KEY, Layout.BY_SOURCE), group, where=P("w") > 1000)
    assert weights.get().count() == 0 and weights.path().endswith("w/part0/chunk0")
    offsets = OffsetCursor(stored.edge_reader(KEY, Layout.BY_SOURCE))
    offsets.seek(6)
    assert offsets.get().count() == 3 and offsets.path().endswith("offset/chunk1")


def test_transform_and_groups(spark, stored, tmp_path):
    target = relayout(stored.info, f"{tmp_path}/t/", "orc", 10, 7, (Layout.LOOSE_BY_DEST,))
    other = transform(stored, target)
    assert sorted(tuple(r) for r in other.edge_reader(KEY).edges(add_index=False).collect()) == expected()
    assert other.vertex_reader("person").chunk_count() == 3 and other.vertices("person").with_label("big").ids().count() == 2
    more = other.add_vertex_group("person", PropertyGroup((Property("twice", GType.parse("int64")),)), other.vertices("person").table([]).withColumn("twice", F.col(names.VERTEX) * 2))
    assert Graph.load(spark, f"{tmp_path}/t/g.graph.yml").vertices("person").table(["twice"]).agg(F.sum("twice")).first()[0] == 600
    more.register_views()
    assert spark.sql("SELECT count(*) FROM person JOIN person_knows_person e ON e._glSrcIndex = _glVertexIndex").first()[0] == len(expected())
    with pytest.raises(MissingKeyError):
        transform(stored, relayout(stored.info, f"{tmp_path}/u/").add_vertex(VertexInfo("cat", 1, (PropertyGroup((Property("id", GType.parse("int64"), True),)),))))


def test_other_column_prefix(spark, tmp_path):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for kind in ("parquet", "csv", "json"):
        writer = GraphWriter(spark).put_vertices("p", people, "id")
        g = writer.write(writer.infer("g", f"{tmp_path}/{kind}/", 1, 1, kind), column_prefix="_other")
        assert [tuple(r) for r in g.vertices("p").table().orderBy("id").collect()] == [(0, 1, "a"), (1, 2, "b")]


def test_builders(spark, tmp_path):
    group = PropertyGroup((Property("id", GType.parse("int64"), True), Property("tags", GType.parse("string"), cardinality=Cardinality.SET)))
    info = VertexInfo("v", 2, (group,), ("x",), "vertex/v/")
    build = VertexBuilder(spark, f"{tmp_path}/", info, level=ValidateLevel.STRONG)
    build.add({"id": 5, "tags": ["a", "b"]}, labels=["x"])
    build.add({"id": 6})
    for bad, error in (({"id": "s"}, TypeMismatchError), ({"no": 1}, MissingKeyError), ({"id": None}, InvalidError), ({"id": 1, "tags": ["a", "a"]}, InvalidError)):
        with pytest.raises(error):
            build.add(bad)
    assert build.dump() == 2
    later = VertexBuilder(spark, f"{tmp_path}/", info, 2)
    later.add({"id": 7})
    assert later.dump() == 3
    with pytest.raises(IndexRangeError):
        VertexBuilder(spark, f"{tmp_path}/", info, 1)
    edge = EdgeInfo("v", "e", "v", 2, 2, 2, adj_lists=(AdjList(Layout.BY_SOURCE),), prefix="edge/v_e_v/")
    edges = EdgeBuilder(spark, f"{tmp_path}/", edge, Layout.BY_SOURCE, 3)
    edges.add(2, 0), edges.add(0, 1)
    with pytest.raises(IndexRangeError):
        edges.add(3, 0)
    assert edges.dump() == 2
    from graphlake.sources.reader import EdgeReader

    assert [tuple(r) for r in EdgeReader(spark, f"{tmp_path}/", edge, Layout.BY_SOURCE).edges().orderBy(names.EDGE).collect()] == [(0, 0, 1), (1, 2, 0)]


def test_strong_checks_and_dangling(spark, tmp_path):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string")
    writer = GraphWriter(spark).put_vertices("p", twice, "id")
    with pytest.raises(InvalidError):
        writer.write(writer.infer("g", f"{tmp_path}/a/"), ValidateLevel.STRONG)
    with pytest.raises(InvalidError):
        writer.put_vertices("p", twice)
    people = spark.createDataFrame([(1,)], "id long")
    pairs = spark.createDataFrame([(1, 2)], "src long, dst long")
    writer = GraphWriter(spark).put_vertices("p", people, "id").put_edges(("p", "e", "p"), pairs)
    with pytest.raises(MissingKeyError):
        writer.write(writer.infer("g", f"{tmp_path}/b/"), on_dangling="error")
    g = writer.write(writer.infer("g", f"{tmp_path}/c/"))
    assert g.edge_reader(("p", "e", "p")).edges().count() == 0
    with pytest.raises(InvalidError):
        lift(None)


def test_import_and_cli(spark, tmp_path, capsys):
    (tmp_path / "p.csv").write_text("id;name\n1;a\n2;b\n")
    (tmp_path / "k.csv").write_text("from;to;w\n1;2;0.5\n2;1;1.5\n")
    prop = lambda n, t, key=False: {"name": n, "data_type": t, "is_primary": key}
    config = {
        "graph": {"path": f"{tmp_path}/g/", "name": "imp"},
        "import_schema": {
            "vertices": [{"type": "p", "property_groups": [{"properties": [prop("id", "int64", True), prop("name", "string")]}], "sources": [{"path": f"{tmp_path}/p.csv", "delimiter": ";", "columns": {"id": "id", "name": "name"}}]}],
            "edges": [{"src_type": "p", "edge_type": "k", "dst_type": "p", "src_prop": "id", "dst_prop": "id", "property_groups": [{"properties": [prop("w", "double")]}], "sources": [{"path": f"{tmp_path}/k.csv", "delimiter": ";", "columns": {"from": "src", "to": "dst", "w": "w"}}]}],
        },
    }
    g = import_graph(spark, config)
    assert [tuple(r) for r in g.edge_reader(("p", "k", "p")).edges(add_index=False).orderBy("w").collect()] == [(0, 1, 0.5), (1, 0, 1.5)]
    path = f"{tmp_path}/g/imp.graph.yml"
    assert cli(["check", "-p", path]) == 0 and cli(["show", "-p", path]) == 0 and cli(["show", "-p", path, "-v", "p"]) == 0
    assert "Vertex count: 2" in capsys.readouterr().out
    assert cli(["show", "-p", path, "-es", "p", "-e", "k", "-ed", "p"]) == 0 and "Edge count: 2" in capsys.readouterr().out
    assert cli(["show", "-p", path, "-v", "none"]) == 1 and cli(["show", "-p", path, "-e", "k"]) == 1 and cli(["check", "-p", "/none"]) == 1
    (tmp_path / "k.csv").write_text("from;to;w\n1;3;0.5\n")
    with pytest.raises(MissingKeyError):
        import_graph(spark, config)


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# pairs\n3 9\n9\t3\n3 3\n")
    g = import_edge_list(spark, f"{tmp_path}/e.txt", f"{tmp_path}/g/", vertex_chunk=2, edge_chunk=2)
    assert sorted(tuple(r) for r in g.edge_reader(("node", "links", "node")).edges(add_index=False).collect()) == [(0, 0), (0, 1), (1, 0)]


def test_connectors(spark):
    assert cypher_edges("A", "R", "B", "k", "k2", ["w"]) == "MATCH (a:`A`)-[r:`R`]->(b:`B`) RETURN a.`k` AS src, b.`k2` AS dst, r.`w` AS `w`"
    assert "query" in Connector(spark).vertex_options("A", ["x"]) and Connector(spark, NEBULA_FORMAT).vertex_options("A", ["x"])["returnCols"] == "x"


def test_append(spark, tmp_path):
    info = VertexInfo("e", 4, (PropertyGroup((Property("id", GType.parse("int64"), True), Property("t", GType.parse("string")))),), prefix="vertex/e/")
    rows = lambda a, b: spark.createDataFrame([(i, f"t{i}") for i in range(a, b)], "id long, t string")
    assert append_batch(spark, f"{tmp_path}/", info, rows(0, 6), "id", 0) == 6
    assert append_batch(spark, f"{tmp_path}/", info, rows(6, 7), "id", 1) == 7
    assert append_batch(spark, f"{tmp_path}/", info, rows(6, 7), "id", 1) == 7
    from graphlake.sources.reader import VertexReader

    assert [tuple(r) for r in VertexReader(spark, f"{tmp_path}/", info).all().orderBy(names.VERTEX).collect()] == [(i, i, f"t{i}") for i in range(7)]


def test_reserved_names_need_their_index_columns(spark, tmp_path):
    from graphlake import names

    assert names.renames(["_xVertexIndex", "_xPrimary", "_isPrimary", "a"], [names.VERTEX]) == {"_xVertexIndex": names.VERTEX, "_xPrimary": names.PRIMARY}
    assert names.renames(["_isPrimary", "_anOffset"], [names.VERTEX]) == {} and names.renames(["_xSrcIndex"], [names.SRC, names.DST]) == {}
    df = spark.createDataFrame([(1, 7), (2, 8)], "id long, _isPrimary long")
    g = GraphWriter(spark).put_vertices("v", df, "id")
    out = g.write(g.infer("g", f"{tmp_path}/", 10, 10))
    assert sorted((r["id"], r["_isPrimary"]) for r in out.vertices("v").table().collect()) == [(1, 7), (2, 8)]
    with pytest.raises(InvalidError):
        VertexWriter(f"{tmp_path}/x/", VertexInfo("v", 5, (PropertyGroup((Property("id", GType.parse("int64"), True),)),), prefix="v/"), df.withColumn(names.hidden("at"), df["id"]))


def test_dangling_edges_with_any_column(spark):
    from graphlake.operators import index

    keys = spark.createDataFrame([(1, 0), (2, 1)], "k long, i long").toDF("_glPrimary", "_glVertexIndex")
    edges = spark.createDataFrame([(1, 2, "a"), (1, 9, "b"), (None, 2, "c")], "s long, d long, _s string")
    assert sorted(r["_s"] for r in index.dangling_edges(edges, keys, keys, "s", "d").collect()) == ["b", "c"]
    assert [tuple(r) for r in index.both_indexes(edges, keys, keys, "s", "d").collect()] == [(0, 1, "a")]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    info = VertexInfo("v", 2, (PropertyGroup((Property("id", GType.parse("int64"), True),)),), prefix="v/")
    at = f"{tmp_path}/"
    VertexWriter(at, info, spark.range(5)).write()
    from graphlake.sources.fs import Files

    monkeypatch.setattr(Files, "replace", lambda *a: (_ for _ in ()).throw(StorageError("no")))
    with pytest.raises(StorageError):
        VertexWriter(at, info, spark.range(9)).write_group(info.groups[0])
    monkeypatch.undo()
    assert VertexReader(spark, at, info).all().count() == 5
    VertexWriter(at, info, spark.range(3)).write()
    assert VertexReader(spark, at, info).all().count() == 3
