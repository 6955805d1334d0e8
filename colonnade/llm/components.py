"""Connected components of an edge table.

Every task first contracts the edges it holds with a local union-find. While more than ``finish_at`` edges are left, alternating large and
small stars join every vertex's neighbours to the least vertex seen; minima are made with map-side combining, so a vertex
with very many edges is one partial row a task, and its edges stay spread by the neighbour. What is left, at most finish_at edges and so
a bounded amount, is finished by one executor task. Rounds are cut with checkpoint(); only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.session import shared_checkpoints


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) for the edges (a, b), least vertices themselves left out."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(names))], "i8") if len(names) else np.zeros(0, "i8")
    child = roots != np.arange(len(names))
    return names[child], names[roots[child]]


FINISH_AT = 500_000


def _contract(batches: Iterator[pa.RecordBatch], hold: int = FINISH_AT) -> Iterator[pa.RecordBatch]:
    u = v = np.zeros(0, "i8")
    for b in batches:
        u, v = forest(np.concatenate((u, b.column(0).to_numpy())), np.concatenate((v, b.column(1).to_numpy())))
        if len(u) > hold:  # a task holds a bounded part of the forest
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            u = v = np.zeros(0, "i8")
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def stars(edges: DataFrame) -> DataFrame:
    """One large and one small star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    small = large.join(least, F.col("u") == F.col("k"))
    return small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every vertex has one edge to a vertex that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("n")), F.struct(F.col("v").alias("x"), F.lit(0).alias("n")))).alias("e")).groupBy("e.x").agg(F.sum("e.n").alias("up"), F.min("e.n").alias("least"))
    return not ends.where("up > 1 OR (up = 1 AND least = 0)").limit(1).count()


def components(edges: DataFrame, rounds: int = 60, finish_at: int = FINISH_AT) -> DataFrame:
    """(u, component) of every vertex of edges (u long, v long) that is not its component's least vertex."""
    shared_checkpoints(edges.sparkSession)
    left = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_contract, "u long, v long").checkpoint()
    for _ in range(rounds):
        if left.count() <= finish_at:
            left = left.coalesce(1).mapInArrow(_contract, "u long, v long").checkpoint()
            break
        if settled(left):
            break
        left = stars(left).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return left.select("u", F.col("v").alias("component"))
