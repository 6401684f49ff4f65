import random

import pytest

from tidemark.operators.components import connected_components


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["component"] for r in connected_components(df, lambda d: d.checkpoint()).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    assert run(spark, edges) == plain([e for e in edges if e[0] != e[1]])


def test_shapes(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1400)]
    want = plain(path + star + [(5000, -3)])
    assert run(spark, path + star + path + [(5000, -3), (7, 7), (None, 3), (8, None)]) == want
    assert run(spark, []) == {}
