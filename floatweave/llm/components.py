"""Connected components of a graph by alternating star contractions.

Each round points every node at the smallest node it knows of (large star, then
small star); the edges end as stars around each component's smallest node. The
rounds needed grow with the logarithm of the longest path. Minima are combined
before they are shuffled, and each is stashed before it is joined back, so a
node with a large share of all edges is an ordinary skewed join, which Spark
splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash_at


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges, a star for each component of theirs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:  # bounded: what is known so far goes out, the rest starts anew
            yield flush()
            parent.clear()
    if parent:
        yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (its first two columns, longs), the
    component named by its smallest node. Nulls, loops and repeated edges are ignored."""
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    now, path = stash_at(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low, low_path = stash_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = stash_at(large, "large")
        least, least_path = stash_at(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after, after_path = stash_at(small, "edges")
        for old in (path, low_path, large_path, least_path):
            discard(spark, old)
        now, path = after, after_path
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = state["n"], state["h"]
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
