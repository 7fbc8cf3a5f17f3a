import pytest

from graphlake.errors import InvalidError, MissingKeyError, YamlError
from graphlake.functions.types import Cardinality, GType
from graphlake.plans import yaml_io
from graphlake.plans.info import AdjList, EdgeInfo, GraphInfo, Layout, Property, PropertyGroup, Version, VertexInfo

ID, NAME = Property("id", GType.parse("int64"), True), Property("name", GType.parse("string"))
PERSON = VertexInfo("person", 100, (PropertyGroup((ID,)), PropertyGroup((NAME, Property("age", GType.parse("int32"))))), prefix="vertex/person/")
KNOWS = EdgeInfo("person", "knows", "person", 1024, 100, 100, False, (AdjList(Layout.BY_SOURCE), AdjList(Layout.BY_DEST)), (PropertyGroup((Property("since", GType.parse("date")),)),), "edge/person_knows_person/")


def test_types():
    assert str(GType.parse("list<float>")) == "list<float>" and GType.parse("int").name == "int32" and GType.parse("list").element == "string"
    for bad in ("list<bool>", "decimal", "map"):
        with pytest.raises(InvalidError):
            GType.parse(bad)
    for name in ("bool", "int32", "int64", "float", "double", "string", "date", "timestamp", "list<double>"):
        assert str(GType.from_spark(GType.parse(name).spark())) == name
    assert GType.parse("string").spark(Cardinality.SET).simpleString() == "array<string>"


def test_paths():
    group = PERSON.groups[1]
    assert PERSON.chunk_path(group, 3) == "vertex/person/name_age/chunk3"
    assert PERSON.count_path() == "vertex/person/vertex_count" and PERSON.labels_path(0) == "vertex/person/labels/chunk0"
    assert KNOWS.adj_path(Layout.BY_SOURCE, 1, 2) == "edge/person_knows_person/ordered_by_source/adj_list/part1/chunk2"
    assert KNOWS.group_path(KNOWS.groups[0], Layout.BY_DEST, 0, 0) == "edge/person_knows_person/ordered_by_dest/since/part0/chunk0"
    assert KNOWS.offset_path(Layout.BY_SOURCE, 4).endswith("ordered_by_source/offset/chunk4")
    assert KNOWS.edge_count_path(Layout.BY_SOURCE, 4).endswith("ordered_by_source/edge_count4")
    with pytest.raises(InvalidError):
        KNOWS.add_adj_list(AdjList(Layout.LOOSE_BY_SOURCE)).offset_path(Layout.LOOSE_BY_SOURCE)


def test_lookups_and_changes():
    assert PERSON.primary_key == "id" and not PERSON.is_nullable("id") and PERSON.is_nullable("name")
    assert PERSON.group_of("age").has("name")
    more = PERSON.add_group(PropertyGroup((Property("email", GType.parse("string")),)))
    assert more.has_property("email") and not PERSON.has_property("email") and more.remove_group(more.groups[-1]) == PERSON
    with pytest.raises(InvalidError):
        PERSON.add_group(PropertyGroup((NAME,)))
    with pytest.raises(MissingKeyError):
        PERSON.property_type("nothing")
    with pytest.raises(MissingKeyError):
        KNOWS.adj_list(Layout.LOOSE_BY_DEST)
    g = GraphInfo("g", "/tmp/g").add_vertex(PERSON).add_edge(KNOWS)
    assert g.prefix == "/tmp/g/" and g.edge("person", "knows", "person") == KNOWS
    assert g.remove_vertex("person").vertices == ()
    with pytest.raises(InvalidError):
        g.add_vertex(PERSON)


@pytest.mark.parametrize(
    "bad",
    [
        VertexInfo("", 1), VertexInfo("v", 0), VertexInfo("v", 1, (PropertyGroup(()),)), VertexInfo("v", 1, (PropertyGroup((NAME, NAME)),)),
        VertexInfo("v", 1, (PropertyGroup((NAME,)), PropertyGroup((NAME,)))), VertexInfo("v", 1, (PropertyGroup((NAME,), "avro"),)),
        VertexInfo("v", 1, (PropertyGroup((Property("l", GType.parse("list<int32>")),), "csv"),)), VertexInfo("v", 1, (PropertyGroup((Property("k", GType.parse("int64"), True, True),)),)),
        EdgeInfo("a", "b", "c"), EdgeInfo("a", "b", "c", 0, adj_lists=(AdjList(Layout.BY_SOURCE),)), EdgeInfo("a", "b", "c", adj_lists=(AdjList(Layout.BY_SOURCE), AdjList(Layout.BY_SOURCE))),
        EdgeInfo("a", "b", "c", adj_lists=(AdjList(Layout.BY_SOURCE),), groups=(PropertyGroup((Property("p", GType.parse("string"), cardinality=Cardinality.LIST),)),)),
        GraphInfo("", "/x"), GraphInfo("g", "/x", (PERSON, PERSON)),
    ],
)
def test_invalid(bad):
    with pytest.raises(InvalidError):
        bad.validate()


def test_yaml_round_trip():
    vertex = VertexInfo("person", 10, (PropertyGroup((ID, Property("emails", GType.parse("string"), cardinality=Cardinality.SET)), "orc"),), ("a", "b"), "v/")
    assert yaml_io.load_vertex(yaml_io.dump_vertex(vertex)) == vertex
    assert yaml_io.load_edge(yaml_io.dump_edge(KNOWS)) == KNOWS
    g = GraphInfo("g", "/data/g/", (PERSON,), (KNOWS,), ("x",), (("k", "v"),))
    texts = {"/m/person.vertex.yml": yaml_io.dump_vertex(PERSON), "/m/person_knows_person.edge.yml": yaml_io.dump_edge(KNOWS)}
    assert yaml_io.load_graph(yaml_io.dump_graph(g), "/m", texts.__getitem__) == g


def test_yaml_defaults_and_errors():
    g = yaml_io.load_graph("name: g\nprefix: ./\nversion: xy/v1\n", "/root/at", None)
    assert g.prefix == "/root/at/" and str(g.version) == "xy/v1"
    v = yaml_io.load_vertex("type: p\nchunk_size: 5\nprefix: v/p/\nproperty_groups:\n  - properties:\n      - {name: id, data_type: int64, is_primary: true}\n    file_type: parquet\n")
    assert v.primary_key == "id" and v.groups[0].prefix == "id/"
    edge = yaml_io.dump_edge(KNOWS).replace("is_nullable: true", "is_nullable: true\n    cardinality: list")
    for text, load in ((edge, yaml_io.load_edge), ("type: p", yaml_io.load_vertex), ("- 1", yaml_io.load_vertex), ("a: [", yaml_io.load_edge)):
        with pytest.raises(YamlError):
            load(text)


def test_version():
    v = Version.parse("xy/v1 (t1,t2)")
    assert v.number == 1 and v.user_types == ("t1", "t2") and v.supports("t1") and v.supports("list<int32>") and not v.supports("t3") and str(v) == "xy/v1 (t1,t2)"
    with pytest.raises(InvalidError):
        Version.parse("v1")
