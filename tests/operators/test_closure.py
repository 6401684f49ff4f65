"""Searches against a plain queue, with cycles, ties and several anchors."""

import random
from collections import deque

import pytest

from tidemark.operators import closure


def plain(edges, anchors, marks):
    out, queue, came, order = {}, deque(), {}, []
    for a in anchors:
        if a not in came:
            came[a] = None
            queue.append(a)
            order.append(a)
    to = {}
    for s, d, o in sorted(edges, key=lambda e: e[2]):
        to.setdefault(s, []).append(d)
    while queue:
        x = queue.popleft()
        if x in marks:
            path = [x]
            while came[path[0]] is not None:
                path.insert(0, came[path[0]])
            return order, path
        for y in to.get(x, []):
            if y not in came:
                came[y] = x
                queue.append(y)
                order.append(y)
    return order, None


@pytest.mark.parametrize("seed", range(4))
def test_search(spark, seed):
    r = random.Random(seed)
    n = 25
    edges = [(r.randrange(n), r.randrange(n), i) for i in range(45)]
    marks = set(r.sample(range(n), 4 * (seed != 2)))
    groups = {g: [r.randrange(n) for _ in range(r.randint(1, 3))] for g in range(5)}
    rows = [(g, a, i) for g, xs in groups.items() for i, a in enumerate(xs)]
    visited, hits = closure.search(spark.createDataFrame(edges, "src long, dst long, ord long"), spark.createDataFrame(rows, "anchor long, node long, pos long"), spark.createDataFrame([(m,) for m in marks], "node long"))
    paths = {x["anchor"]: x["path"] for x in closure.witness(visited, hits).collect()}
    got = {}
    for x in visited.orderBy("at").collect():
        got.setdefault(x["anchor"], []).append(x["node"])
    for g, anchors in groups.items():
        order, path = plain(edges, anchors, marks)
        assert got[g] == order and paths.get(g) == path


def test_reach_and_fixpoint_on_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,), (2,)], "node long")
    assert sorted((x["node"], x["hops"]) for x in closure.reach(none, seeds).collect()) == [(1, 0), (2, 0)]
    assert closure.reach(none, seeds.limit(0)).count() == 0
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    assert sorted(x["node"] for x in closure.least_fixpoint(nodes, loop).collect()) == [4, 5]
