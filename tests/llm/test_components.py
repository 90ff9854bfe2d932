import random

import pytest

from taleframe.llm.components import components


def brute(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((top(u), top(v)))
            root[b] = a
    return {x: top(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["chain", "random", "star"])
def test_equals_union_find(spark, kind):
    rng = random.Random(9)
    edges = {
        "chain": [(i, i + 1) for i in range(120)] + [(-5, -6)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (None, 3), (3, None), (10**15, -(10**15))],
        "star": [(500, i) for i in range(200)] + [(500, i) for i in range(200)],
    }[kind]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    assert {r["node"]: r["component"] for r in components(df).collect()} == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
