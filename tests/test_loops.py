"""Loops over graphs with hubs and long chains: the same results with and without a vertex cut, and even tasks."""

from collections import deque

import pytest

from graphlake import names
from graphlake.operators import algorithms as algo

S, D = names.SRC, names.DST
N = 3_000
#: Vertex 0 leads to all of the first 2,000 and from some back, the others are a chain with a few that nobody reaches.
STAR = [(0, i) for i in range(1, 2_000)] + [(i, 0) for i in range(1, 2_000, 3)] + [(i, i + 1) for i in range(2_000, 2_040)] + [(5, 2_000), (5, 5), (5, 2_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(STAR, f"{S} long, {D} long")


def distances(root):
    out, waiting, near = {root: 0}, deque([root]), {}
    for s, d in STAR:
        near.setdefault(s, []).append(d)
    while waiting:
        v = waiting.popleft()
        for w in near.get(v, []):
            if w not in out:
                out[w] = out[v] + 1
                waiting.append(w)
    return [out.get(v, -1) for v in range(N)]


@pytest.mark.parametrize("hub", [100, 100_000])
def test_hubs_change_no_result(edges, monkeypatch, hub):
    monkeypatch.setattr(algo, "HUB", hub)
    want = distances(0)
    deep = max(want)
    assert deep > 40
    short = [d if d <= 3 else -1 for d in want]
    few = edges.filter(f"{S} < 2002")
    for pull in (False, True):
        got = dict(map(tuple, algo.bfs(few, N, pull=pull).collect()))
        assert [got[v] if got[v] <= 3 else -1 for v in range(N)] == short
    component = dict(map(tuple, algo.weak_components(edges, N).collect()))
    assert all(component[v] == (0 if v <= 2_040 else v) for v in range(N))
    rank, out = [1 / N] * N, [0] * N
    for s, _ in STAR:
        out[s] += 1
    for _ in range(4):
        got = [0.0] * N
        for s, d in STAR:
            got[d] += rank[s] / out[s]
        rank = [0.85 * (g + (0 if o else r)) + 0.15 / N for g, o, r in zip(got, out, rank, strict=True)]
    found = dict(map(tuple, algo.pagerank(edges, N, 4).collect()))
    assert max(abs(found[v] - rank[v]) for v in range(N)) < 1e-12


def test_edges_of_a_hub_are_dealt_evenly(edges, monkeypatch):
    links = algo._Links(edges.distinct(), S)
    assert links.heavy is None and max(links.light.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) > 1_900
    monkeypatch.setattr(algo, "HUB", 100)
    links = algo._Links(edges.distinct(), S)
    heavy, light = (sorted(df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) for df in (links.heavy, links.light))
    assert sum(heavy) == 1_999 and heavy[-1] < 3 * max(1, heavy[len(heavy) // 2]) and sum(heavy) + sum(light) == len(set(STAR))
    assert links.hubs.count() == 1


def test_rounds_leave_no_broadcasts_of_values_to_the_driver(spark, edges):
    """Adaptive execution would turn each round's join into a broadcast through the driver, which keeps them for a while."""
    values = spark.range(N).withColumnRenamed("id", S).repartition(3)
    met = algo._Links(edges.distinct(), S).meet(values)
    assert met.count() == edges.distinct().count()
    counted = met.groupBy().count()
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan
