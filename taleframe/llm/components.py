"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges never leave the executors.  Each step joins an edge table with a per-node minimum, so no node's
neighbours are gathered in one place; a partition first shrinks its own edges to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleframe.llm.common import noted, remove, stage

EDGE = "u long, v long"
#: Nodes that a task keeps while it shrinks its edges, about.
HELD = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, smallest node of its tree) for the edges of one partition, some HELD nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x], x = top, p
        return top

    def trees() -> Iterator[pd.DataFrame]:
        nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
        for i in range(0, len(nodes), 65536):
            part = nodes[i : i + 65536]
            yield pd.DataFrame({"u": part, "v": np.array([root(int(x)) for x in part], dtype=np.int64)})
        parent.clear()

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > HELD:
            yield from trees()
    yield from trees()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node that has an edge; component is its smallest reachable node.

    ``edges`` has long columns u and v in any direction; loops, repeats and rows with a null are allowed
    and change nothing.  An empty table gives an empty result.
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    with noted() as held:
        now = stage(start.mapInPandas(_forest, EDGE).where("u <> v"), "cc")
    before = None
    for _ in range(most_rounds):
        if (state := _state(now)) == before:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
        before = state
        with noted() as last:
            now = stage(_small_star(_large_star(now)), "cc")
        remove(edges.sparkSession, held)
        held = last
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
