"""Connected components of a table of links.

Up to LOCAL_LINKS links, which are a few MB, one task joins them. Beyond that, alternating large-star and
small-star steps send neighbours to the smallest neighbour known, by aggregation and join, so that no
component is gathered anywhere. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.session import ship, stash

LOCAL_LINKS = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of the links of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "root"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of any link the smallest node that it reaches.

    Loops, repeated links and an empty table are fine; null ends are dropped.
    """
    pair = lambda df, x, y: df.select(F.col(x).alias("u"), F.col(y).alias("v"))
    now = stash(pair(edges, a, b).where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links, before = now.count(), None
    if links <= LOCAL_LINKS:
        ship(edges.sparkSession)
        return stash(now.coalesce(1).mapInArrow(_joined, "node long, root long"))
    while True:
        both = now.union(pair(now, "v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = stash(small.where("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
