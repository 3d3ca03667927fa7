"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable from each node of ``links`` (a, b), both of type long.

    Alternates two steps on a table of links until nothing changes: every node sends its larger neighbours, then its
    smaller ones, to the smallest node it knows of. The number of rounds grows with the logarithm of the longest path;
    each round's table is written out and its predecessor dropped, and no step holds the neighbours of a node together
    (minima are combined before they are shuffled).
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, before = _written(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # each larger neighbour b of a goes to a's smallest
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # each node b goes to its smallest, and its other smaller neighbours go there as well
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smallest, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges, after = _written(small.where("a <> b").distinct(), edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _written(edges: DataFrame, *spent: DataFrame) -> tuple[DataFrame, dict]:
    """The table, written, and its number of links and the sum of their hashes, which the write observes."""
    seen = Observation()
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return materialize(watched, "links", *spent), seen.get


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label
