"""Consolidating pairwise matches into groups.

Edges are cut into bounded partitions; each runs union-find and keeps only a spanning forest (every vertex with the least vertex
that it is joined to). Forests merge level by level: a vertex takes the least root it was given anywhere, these parents are followed to
the top by pointer doubling, and the forests' edges are rewritten to the tops, of which there are at most half as many as vertices. That goes
on until what is left fits one bounded partition; labels are then handed back down the levels by joins. No task holds more than the
bound, whatever the size of a component, and nothing reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.session import keep


def spanning_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition, by batches: (v, root) of each vertex that is not the least of its tree."""
    ids: dict[str, int] = {}
    parent: list[int] = []
    names: list[str] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            x = ids.setdefault(a, len(parent))
            if x == len(parent):
                parent.append(x)
                names.append(a)
            y = ids.setdefault(b, len(parent))
            if y == len(parent):
                parent.append(y)
                names.append(b)
            x, y = find(x), find(y)
            if x != y:
                if names[y] < names[x]:
                    x, y = y, x
                parent[y] = x
    roots = np.fromiter((find(i) for i in range(len(parent))), dtype=np.int64, count=len(parent))
    leaves = np.nonzero(roots != np.arange(len(parent)))[0]
    for part in np.array_split(leaves, max(1, len(leaves) // 100_000)):
        if len(part):
            yield pd.DataFrame({"v": [names[i] for i in part], "root": [names[i] for i in roots[part]]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", edges_per_task: int = 250_000) -> DataFrame:
    """(id, group_id): every vertex of an edge with the least vertex, as a string, that it is linked to directly or indirectly.

    Edges with a null end are left out; repeats and both directions change nothing; a vertex that is linked to itself only is its own
    group; no edges give no rows. Further columns are ignored. ``edges_per_task`` bounds what one task holds.
    """
    links = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    alone = links.where("a = b").select(F.col("a").alias("id")).distinct()
    links = keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    settled: list[DataFrame] = []
    while True:
        level, tasks = len(settled), max(1, -(-links.count() // edges_per_task))
        forest = keep(links.repartition(tasks).mapInPandas(spanning_forest, "v string, root string"), f"forest{level}")
        if tasks == 1:
            break
        tops = _follow(keep(forest.groupBy("v").agg(F.min("root").alias("root")), f"parents{level}"), level)
        settled.append(tops)
        above = forest.join(tops.select("v", F.col("root").alias("x")), "v")
        above = above.join(tops.select(F.col("v").alias("root"), F.col("root").alias("y")), "root", "left").select("x", F.coalesce("y", "root").alias("y"))
        links = keep(above.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links{level}")
    labels = forest
    for tops in reversed(settled):
        # A top with a third of all vertices is a hot key here; adaptive execution splits it, as each top has one label.
        named = labels.select(F.col("v").alias("top"), F.col("root").alias("label"))
        down = tops.join(named, tops["root"] == named["top"], "left").select("v", F.coalesce("label", "root").alias("root"))
        labels = keep(down.unionByName(labels), "labels")
    members = labels.unionByName(labels.select(F.col("root").alias("v"), "root").distinct()).select(F.col("v").alias("id"), F.col("root").alias("group_id"))
    lone = alone.join(members.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id"))
    return members.unionByName(lone)


def _follow(parents: DataFrame, level: int) -> DataFrame:
    """Parents, which are smaller than their children, followed to the top of each tree by pointer doubling."""
    while True:
        step = parents.select(F.col("v").alias("root"), F.col("root").alias("next"))
        jumped = keep(parents.join(step, "root", "left").select("v", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"tops{level}")
        parents = jumped.select("v", "root")
        if jumped.where("moved").isEmpty():
            return parents
