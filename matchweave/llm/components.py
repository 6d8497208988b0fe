"""Connected components by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("hi", "lo").union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _is_star(e: DataFrame) -> bool:
    ends = e.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("lo", F.lit(0), F.lit(1)))
    per = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component``: for each id of an edge but the least of its component, the least id that it reaches.

    A component's least id has no row. Edges with a null end, loops and repeated edges change nothing.
    Each round is a few shuffles of the edges, pre-aggregated, and is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct()
    e = saved(e)
    while not _is_star(e):
        e = saved(_small_star(_large_star(e)))
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


class Forest:
    """Least-label components of nodes 0..n-1 under batches of edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            p, q = self.label[i], self.label[j]
            differ = p != q
            if not differ.any():
                return
            i, j, p, q = i[differ], j[differ], p[differ], q[differ]
            np.minimum.at(self.label, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
