"""Centroid clustering of integer vectors by partial-distance search.

Vectors become integers floor(SCALE * x), so sums, centroids and distances are exact and no result depends on the order of rows.
Squared differences are summed over the dimensions of highest variance first, GROUP at a time. A vector's centroids are tried
in the order of their first partial sums; one is abandoned as soon as its sum is strictly above the vector's best distance so far,
and those that stay are summed over all dimensions. Abandoning can't change a result: a partial sum is a lower bound.

The quantised vectors are written once. A round reads them, keeps a table of sums in each task, and adds these
up by centroid and dimension; the driver gets K * DIM rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.storage import Spill

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256.0, 2
#: Dimensions that are summed before centroids are abandoned, and vectors that are compared at once.
GROUP, ROWS = 8, 1024
#: Largest size of an integer component: the squared distance of two vectors stays below 2 ** 63 up to 128 dimensions.
LIMIT = 1 << 27
VECTOR = "vec_id long, v binary"


def _quantised(dim: int, scale: float):
    """(vec_id, embedding) -> (vec_id, v): int32 components of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            keep, vecs = [], []
            for i, v in enumerate(column):
                if not v.is_valid or len(v.values) != dim or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                if (np.abs(q) > LIMIT).any():
                    raise ValueError(f"a component is beyond {LIMIT} / {scale}: squared distances would not fit into a long")
                keep.append(i)
                vecs.append(q.astype("<i4").tobytes())
            yield pa.record_batch([ids.take(pa.array(keep, pa.int64())), pa.array(vecs, pa.binary())], ["vec_id", "v"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``centroids`` of each row of ``x`` (ties: the smaller number) and the squared distance, exactly."""
    x, c = x[:, order], centroids[:, order]
    cuts = [slice(a, a + group) for a in range(0, x.shape[1], group)]
    head = ((x[:, None, cuts[0]] - c[None, :, cuts[0]]) ** 2).sum(axis=2)
    turn = np.argsort(head, axis=1, kind="stable")
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    open_rows = np.arange(len(x))
    for k in range(len(c)):
        own = turn[open_rows, k]
        part = head[open_rows, own]
        # The centroids after this one have first sums at least as large: where this one is above the best, the row is done.
        stay = part <= best[open_rows]
        open_rows, own, part = open_rows[stay], own[stay], part[stay]
        if not len(open_rows):
            break
        rows = open_rows
        for cut in cuts[1:]:
            part = part + ((x[rows, cut] - c[own, cut]) ** 2).sum(axis=1)
            stay = part <= best[rows]
            rows, own, part = rows[stay], own[stay], part[stay]
            if not len(rows):
                break
        better = (part < best[rows]) | (own < at[rows])
        best[rows[better]], at[rows[better]] = part[better], own[better]
    return at, best


def _sums(centroids: np.ndarray, order: np.ndarray, group: int):
    """Vectors -> (cluster, d, n, s) of a task: the sum of component d over the n vectors of a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS))
                own, _ = nearest(x, centroids, order, group)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(centroids))
        there = np.flatnonzero(count)
        cluster, d = np.repeat(there, total.shape[1]), np.tile(np.arange(total.shape[1]), len(there))
        yield pa.record_batch([pa.array(cluster, pa.int32()), pa.array(d, pa.int32()), pa.array(count[cluster], pa.int64()), pa.array(total[cluster, d], pa.int64())], ["cluster", "d", "n", "s"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                own, distance = nearest(_matrix(part.column(1)), centroids, order, group)
                yield pa.record_batch([part.column(0), pa.array(own, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors -> (d, n, s, q) of a task: count, sum and sum of squares of each dimension, as doubles. They only choose the order of dimensions."""
    n, s, q = 0, 0.0, 0.0
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            x = _matrix(batch.column(0).slice(at, ROWS)).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    if n:
        yield pa.record_batch([pa.array(range(len(s)), pa.int32()), pa.array([float(n)] * len(s)), pa.array(s), pa.array(q)], ["d", "n", "s", "q"])


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", group: int = GROUP) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid), one row for each vector that is kept.

    Kept are vectors of exactly ``dim`` components, none of them null or non-finite. The first centroids are the ``k`` vectors
    with the smallest SHA-256 of "seed:vec_id" (equal ids: by their components; rows without an id come last), all of them if
    there are fewer. Each of ``rounds`` rounds assigns every vector and moves every centroid that has vectors to the floor of
    their mean; empty ones stay. distance is the squared distance of the integer vectors, inertia its sum over all vectors,
    ``centroid`` the final one's components. Ids may be null or repeat. An empty table gives an empty table; other columns are
    ignored. A component beyond LIMIT / scale is an error, as its distances would not fit into a long.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("embedding"))
    held = Spill(rows.mapInArrow(_quantised(dim, scale), VECTOR), "vectors").df
    # k rows of dim integers: bounded by the parameters.
    first = held.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([np.frombuffer(r.v, "<i4") for r in first], np.int64)
    spread = held.select("v").mapInArrow(_spread, "d int, n double, s double, q double").groupBy("d").agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2.0))).alias("x")).collect()
    variance = np.zeros(dim)
    for r in spread:
        variance[r.d] = r.x
    order = np.argsort(-variance, kind="stable")
    for _ in range(rounds):
        parts = held.select("v").mapInArrow(_sums(centroids, order, group), "cluster int, d int, n long, s long")
        moved = centroids.copy()
        for r in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            moved[r.cluster, r.d] = r.s // r.n
        centroids = moved
    done = Spill(held.mapInArrow(_assigned(centroids, order, group), "vec_id long, cluster int, distance long"), "assigned").df
    inertia = {r.cluster: r.x for r in done.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    about = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), [int(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of a centroid's components, in decimal, joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
