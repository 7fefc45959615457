"""Graph reads over edge tables (src, dst, type): neighbours, shortest paths, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.storage import Spill


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def neighbours(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(start, node): distinct nodes within 1 … hops edges, direction ignored, start nodes given as column ``id``.

    A start node is its own neighbour if a walk of two hops or more that uses no edge twice comes back to it.
    """
    both = undirected(edges)
    front = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array().cast("array<string>").alias("used"))
    e = both.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst")).alias("edge"))
    # Only walks back to the start need their edges; they are kept for the first hops alone, when they are short.
    seen = None
    for k in range(hops):
        step = front.join(e, "node").where(~F.array_contains("used", F.col("edge")))
        front = step.select("start", F.col("next").alias("node"), F.concat("used", F.array("edge")).alias("used"))
        if k + 1 < hops and k > 0:
            front = front.groupBy("start", "node").agg(F.min("used").alias("used"))
        found = front.select("start", "node")
        seen = found if seen is None else seen.union(found)
    return seen.distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 10) -> DataFrame:
    """(src, dst, hops, path): a shortest undirected path of each pair (src, dst), the smallest by node order; none, no row.

    Breadth first: each round extends the frontier by one edge and keeps one path for each (src, node); nodes met before are
    left out. The frontier is written to the shared folder each round, so lineage stays short.
    """
    both = Spill(undirected(edges).select(F.col("src").alias("node"), F.col("dst").alias("next")), "edges")
    want = pairs.select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()
    front = Spill(want.select("s", F.col("s").alias("node")).distinct().select("s", "node", F.array("node").alias("path")), "front")
    seen, out = front.df.select("s", "node"), None
    for k in range(max_hops + 1):
        hit = front.df.join(want.select("s", F.col("t").alias("node")), ["s", "node"]).select(F.col("s").alias("src"), F.col("node").alias("dst"), F.lit(k).alias("hops"), "path")
        out = hit if out is None else out.union(hit)
        if k == max_hops:
            break
        step = front.df.join(both.df, "node").groupBy("s", F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        nxt = Spill(step.join(seen, ["s", "node"], "left_anti"), "front")
        if nxt.df.isEmpty():
            break
        front, seen = nxt, seen.union(nxt.df.select("s", "node"))
    return out


def relationships_of(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(id, direction, type, other) of the nodes ``id``: out, in, or both."""
    n = nodes.select("id")
    out = edges.join(n, edges.src == n.id).select("id", F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    into = edges.join(n, edges.dst == n.id).select("id", F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


def get_nodes(vertices: DataFrame, fallback: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Nodes by id from the graph's table, and from ``fallback`` where it has none."""
    first = vertices.join(ids.select(key), key, "left_semi")
    rest = ids.select(key).join(vertices, key, "left_anti")
    return first.unionByName(fallback.join(rest, key, "left_semi"), allowMissingColumns=True)


def merge_nodes(current: DataFrame, changes: DataFrame, key: str = "id", order: str = "ts") -> DataFrame:
    """Upsert of a node or edge table: the last row of each key by ``order``; rows with deleted = true go."""
    rows = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(key, "_x.*")
    return last.where("not coalesce(deleted, false)") if "deleted" in last.columns else last
