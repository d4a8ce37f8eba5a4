"""Connected components of a distributed edge list.

Rounds of contraction: each node hooks onto the neighbour (or itself) of least
random rank, edges are rewritten to the hooks, and loops and repeats go.  A
constant share of the nodes disappears in each round, whatever the shape of the
graph, and a node of very high degree is only ever an aggregation key with a
partial minimum.  Once no more than ``FINISH`` edges are left they are joined by
one task (a fixed bound, not a share of the input).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

FINISH = 300_000


def _finish(batches):
    parent: dict[int, int] = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (longs): the least node reachable."""
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    hooks, turn = [], 0
    while left.count() > finish:
        turn += 1
        both = left.union(left.select("b", "a"))
        rank = F.struct(F.xxhash64("b", F.lit(turn)).alias("r"), F.col("b").alias("n"))
        best = both.groupBy("a").agg(F.min(rank).alias("best"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("r"), F.col("a").alias("n"))
        hook = cut(best.select(F.col("a").alias("node"), F.least("best", own)["n"].alias("root")))
        hooks.append(hook)
        one = left.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        two = one.join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = cut(two.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct())
    roots = left.coalesce(1).mapInArrow(_finish, "node long, root long")
    for hook in reversed(hooks):
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = hook.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    if not hooks:
        return roots.select("node", F.col("root").alias("component"))
    # ranks were random: name each component by its least node
    names = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(names, "root").select("node", "component")


def merged(groups: DataFrame, edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """``groups`` (``node, component``, as ``components`` gives them) with the edges ``a, b`` added: only components that the edges join are named anew."""
    known = lambda n: groups.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    found = edges.join(known("a"), "a", "left").join(known("b"), "b", "left")
    found = cut(found.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    tops = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), finish).select(F.col("node").alias("component"), F.col("component").alias("top"))
    found = found.filter("a <> b")
    ends = found.select("a", "ca").union(found.select("b", "cb")).toDF("node", "component")
    every = groups.select("node", "component").union(ends).distinct()
    return every.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
