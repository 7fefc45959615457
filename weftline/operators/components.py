"""Connected components of an edge table, by alternating large and small stars.

Edges stay distributed. Each round first contracts every partition's edges to stars with a union-find over that
partition (at most one edge a node and partition is left), then runs one large-star and one small-star step, and writes
the edges to the shared folder, so that lineage stays short and a lost executor costs one round only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.storage import Spill

#: Edges that a contraction holds at once; more are contracted in runs, so memory does not grow with a partition.
CONTRACT_EDGES = 500_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst) of a partition -> edges (src, dst), dst the smallest node that the partition's own edges reach from src."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def stars() -> pa.RecordBatch:
        src = [x for x in parent if find(x) != x]
        return pa.record_batch([pa.array(src, pa.int64()), pa.array([find(x) for x in src], pa.int64())], ["src", "dst"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent.setdefault(a, a)
                parent[b] = a
        if len(parent) > CONTRACT_EDGES:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Null endpoints are dropped, self loops and repeated edges change nothing, an empty table gives an empty table.
    Nodes are longs. Raises RuntimeError if ``max_rounds`` were not enough (the bound grows with log² of a component).
    """
    pair = "src long, dst long"
    cur = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src <> dst")
    held: Spill | None = None
    for _ in range(max_rounds):
        flat = cur.mapInArrow(contract, pair).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        new = Spill(flat.mapInArrow(contract, pair), "stars")
        if held:
            held.drop()
        held = new
        stars = held.df
        # Done when every node has one smaller neighbour and no centre has a centre of its own.
        loose = stars.select(F.col("src").alias("n"), F.lit(1).alias("c")).union(stars.select(F.col("dst"), F.lit(0)).distinct())
        if loose.groupBy("n").agg(F.count("*").alias("k"), F.sum("c").alias("c")).where("k > 1 and c > 0").limit(1).isEmpty():
            nodes = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return nodes.union(stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        both = stars.union(stars.select("dst", "src"))
        low = both.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("dst > src").join(low, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        low2 = large.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m"))
        small = large.join(low2, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        cur = small.union(low2.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    raise RuntimeError("components did not settle")
