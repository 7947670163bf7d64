"""Connected components of an edge table by alternating large and small stars, with each round's edges written to the shared folder.

Nothing is collected but a row count and a checksum per round. A node with very many edges costs no task more than its share: the
minimum of its neighbours is aggregated before the shuffle and written, and the join that spreads the minimum is a plain two-sided
sort-merge join of two tables, which adaptive execution splits where one key is large.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has columns u, v of one orderable type, in any direction, self loops and repeats allowed, no nulls.

    Returns node, root: one row for each node that has an edge to another, with the least node of its component. Empty: empty."""
    a, b = F.least("u", "v"), F.greatest("u", "v")
    now = scratch.put(edges.where("u <> v").select(b.alias("u"), a.alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        first = scratch.n
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.put(large)
        least = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, mark = mark, _mark(now := scratch.put(small))
        for number in range(first, scratch.n):
            scratch.drop(number)
        if mark == old:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n indices over edges a-b, within one task."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
        if np.array_equal(root, before):
            return root
