"""Walks over many hops: how often edges are read, and the same nodes and paths however lists are dealt."""

import random
from collections import deque

import pytest
from quillgraph import schema
from quillgraph.operators import graph


@pytest.fixture(scope="module")
def steps():
    rng = random.Random(11)
    hub = [(0, b) for b in range(1, 40)]
    return sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | set(hub))


@pytest.fixture
def counted(spark, steps):
    """Edges, each twice, and how many of their rows were read."""
    read = spark.sparkContext.accumulator(0)
    rows = [("calls", "symbol", a, "symbol", b, "resolved", 1) for a, b in steps] * 2

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(rows, schema.EDGES)
    return edges.mapInArrow(through, edges.schema), read, len(rows)


def distances(steps, start, most):
    far, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in [b for a, b in steps if a == x] if far[x] < most else []:
            if y not in far:
                far[y] = far[x] + 1
                queue.append(y)
    return far


@pytest.mark.parametrize(("by_seed", "array", "length"), [(True, 500_000, 2), (True, 30, 1024), (False, 500_000, 3)])
def test_a_walk_reads_its_edges_once(spark, monkeypatch, counted, steps, by_seed, array, length):
    edges, read, n = counted
    for name, value in (("many", lambda spark, owners: by_seed), ("ARRAY", array), ("LIST", length)):
        monkeypatch.setattr(graph, name, value, raising=False)
    seeds = spark.createDataFrame([(k, "symbol", k) for k in range(0, 60, 3)], "seed bigint, node_kind string, node_id bigint")
    got = sorted((r.seed, r.node_id, r.depth) for r in graph.frontier(edges, seeds, 3).collect())
    assert got == sorted((k, x, d) for k in range(0, 60, 3) for x, d in distances(steps, k, 3).items())
    assert read.value == n


@pytest.mark.parametrize("by_pair", [True, False])
def test_paths_read_their_edges_once_a_direction(spark, monkeypatch, counted, steps, by_pair):
    edges, read, n = counted
    monkeypatch.setattr(graph, "many", lambda spark, owners: by_pair, raising=False)
    after = {}
    for a, b in steps:
        after.setdefault(a, []).append(b)

    def first(start, end, most):
        """The first by name of the shortest paths."""
        paths = [[start]]
        for _ in range(most + 1):
            if found := [p for p in paths if p[-1] == end]:
                return min([f"symbol:{x}" for x in p] for p in found)
            paths = [[*p, b] for p in paths for b in after.get(p[-1], [])]
        return None

    for most in (3, 4):
        asked = [(k, "symbol", k, "symbol", (k * 7 + 3) % 60) for k in range(60)]
        read.value = 0
        out = graph.shortest_paths(edges, spark.createDataFrame(asked, "pair bigint, from_kind string, from_id bigint, to_kind string, to_id bigint"), most).collect()
        assert {r.pair: list(r.path) for r in out} == {k: p for k, *_, to in asked if (p := first(k, to, most))}
        assert all(r.hops == len(r.path) - 1 for r in out) and read.value == 2 * n


def test_null_ids_are_reached_once(spark):
    edges = spark.createDataFrame([("calls", "symbol", 1, "symbol", 2, "resolved", 1), ("calls", "symbol", 1, "symbol", None, "resolved", 1), ("calls", "symbol", 2, "symbol", None, "resolved", 1)], schema.EDGES)
    seeds = spark.createDataFrame([(1, "symbol", 1)], "seed bigint, node_kind string, node_id bigint")
    assert sorted(((r.node_id or 0), r.depth) for r in graph.frontier(edges, seeds, 2).collect()) == [(0, 1), (1, 0), (2, 1)]
