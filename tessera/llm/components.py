"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


#: Up to so many edges, one task joins them: a counted bound, not a cap.
ONE_TASK = 200_000
#: From so many edges on, a node's minimum is stored before it is joined back, so that a hub's rows
#: stand in a plain shuffle join, which adaptive execution can split. Results are the same either way.
STORE_FROM = 5_000_000


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is its component's smallest node.

    Each round hangs every node's larger neighbours on the smallest one, then its smaller ones;
    rounds grow with the logarithm of the longest path. Nothing but one checksum row a round
    reaches the driver. Edges with a null end or two equal ends connect nothing; repeated edges count once.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    if 0 < now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_join, "node long, root long")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen, store = mark, cut if mark[0] >= STORE_FROM else lambda df: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = store(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = store(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
