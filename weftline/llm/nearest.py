"""Approximate nearest neighbours by inner product: a robust-pruned directed graph over each shard of the vectors.

Equal vectors fold into one class, which keeps its k + 1 smallest ids: more of them can't be among k neighbours. Classes are dealt to
shards of about SHARD_ROWS by the hash of their vector, so a shard fits into a task however many rows there are or repeat.

Inside a shard the largest inner product becomes the smallest distance: vectors are divided by the longest one's length and get one
more component that makes all lengths 1 (queries get a zero there). The graph grows by batches. A greedy beam search over
what is there proposes each new vector's neighbours; pruning goes through them from near to far and drops what is closer, RELAX
times, to a kept neighbour than to the vector itself, so the edges that stay are short and point in different directions. Kept
neighbours link back and are pruned again when their lists are full. At last every node is made reachable from the start node.

Every query is searched in every shard: blocks of queries meet shards, and a beam search gives the candidates, whose inner products are
then taken in double precision on the original vectors. The best of all shards win.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.plans.storage import Spill, shuffle_partitions

K, SHARD_ROWS, QUERY_ROWS = 20, 16_384, 16_384
#: Neighbours that pruning leaves, room of a list between prunings, width of a beam, and relaxation of distances.
DEGREE, ROOM, BEAM, RELAX = 32, 64, 64, 1.2
#: Vectors that enter the graph at once, and nodes of a search's way that are proposed beside its beam.
BATCH, WAY = 1024, 16
INDEX = "dim int, shard long, node int, ids array<long>, vec binary, near binary"
FOUND = "query_id long, query_key binary, vec_id long, score double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, dim, key, vec) of the rows that take part."""
    for batch in batches:
        ids, dims, keys, vecs = [], [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0 and 0 are equal
            if len(x) and np.isfinite(x).all() and x.any():
                ids.append(i)
                dims.append(len(x))
                vecs.append(x.tobytes())
                keys.append(hashlib.blake2b(vecs[-1], digest_size=16).digest())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "key", "vec"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, with one more component, whose distances to a lifted query rank as the inner products do."""
    x = vectors / np.abs(vectors).max()
    longest = (x * x).sum(axis=1).max()
    x = x / math.sqrt(longest)
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]]).astype(np.float32)


def lifted_queries(queries: np.ndarray) -> np.ndarray:
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
    return np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)


def _distances(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x[nodes] and q, row by row."""
    diff = x[nodes] - q
    return np.einsum("ij,ij->i", diff, diff)


def beam_search(x: np.ndarray, near: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, way): the ``beam`` nearest nodes that a greedy search from ``start`` finds for each row of ``q``, near to far (-1:
    none), and the first nodes it went through. All rows of ``q`` step together; a row is done when its beam has no open node."""
    m = len(q)
    seen = np.zeros((m, len(x)), bool)
    ids, dist, done = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf, np.float32), np.ones((m, beam), bool)
    ids[:, 0], done[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = _distances(x, np.full(m, start), q)
    way = np.full((m, WAY), -1, np.int32)
    rows, step = np.arange(m), 0
    while True:
        todo = ~done[rows]
        more = todo.any(axis=1)
        rows, todo = rows[more], todo[more]
        if not len(rows):
            return ids, way
        at = todo.argmax(axis=1)
        node = ids[rows, at]
        done[rows, at] = True
        if step < WAY:
            way[rows, step] = node
        step += 1
        to = near[node]
        fresh = (to >= 0) & ~seen[rows[:, None], to]
        r, c = np.nonzero(fresh)
        seen[rows[r], to[r, c]] = True
        d = np.full(to.shape, np.inf, np.float32)
        d[r, c] = _distances(x, to[r, c], q[rows[r]])
        all_d = np.hstack([dist[rows], d])
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[rows] = np.take_along_axis(all_d, order, 1)
        ids[rows] = np.take_along_axis(np.hstack([ids[rows], np.where(fresh, to, -1)]), order, 1)
        done[rows] = np.take_along_axis(np.hstack([done[rows], ~fresh]), order, 1)


def robust_prune(x: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """(rows, degree) neighbours of the nodes ``own``, -1 where there are fewer, out of ``proposed`` (-1: none).

    The nearest one left is kept, and every c with relax * d(kept, c) <= d(own, c) goes, until none is left.
    """
    out = np.full((len(own), degree), -1, np.int32)
    for a in range(0, len(own), 256):
        p, c = own[a : a + 256], proposed[a : a + 256]
        v = x[c].astype(np.float64)
        d = ((v - x[p].astype(np.float64)[:, None, :]) ** 2).sum(axis=2)
        alive = (c >= 0) & (c != p[:, None])
        d[~alive] = np.inf
        square = (v * v).sum(axis=2)
        between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        rows = np.arange(len(p))
        for k in range(degree):
            pick = np.where(alive, d, np.inf).argmin(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[a + rows[some], k] = c[some, pick[some]]
            alive &= relax * relax * np.maximum(between[rows, pick], 0) > d
            alive[rows, pick] = False
            alive &= c != c[rows, pick][:, None]
    return out


class Graph:
    """The directed graph over the lifted vectors ``x``: lists of at most ROOM neighbours, and the node that searches start from."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, room: int = ROOM, beam: int = BEAM, relax: float = RELAX, seed: int = 7):
        self.x, self.degree, self.room, self.relax = x, degree, room, relax
        self.near, self.count = np.full((len(x), room), -1, np.int32), np.zeros(len(x), np.int64)
        middle = x.mean(axis=0, dtype=np.float64).astype(np.float32)
        self.start = int(((x - middle) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(seed).permutation(len(x))
        order = np.concatenate([[self.start], order[order != self.start]])
        there = min(len(x), 2 * room)
        first = order[:there]
        self._link(first, np.tile(first, (there, 1)))
        while there < len(x):
            batch = order[there : there + min(there, BATCH)]
            ids, way = beam_search(x, self.near, self.start, x[batch], beam)
            self._link(batch, np.hstack([ids, way, self._of_batch(batch)]))
            there += len(batch)
        self._reach_all(beam)

    def _of_batch(self, batch: np.ndarray) -> np.ndarray:
        """For each vector of a batch the nearest other ones of the batch, which no search can find yet."""
        v = self.x[batch]
        d = -(v @ v.T)  # lengths are 1
        np.fill_diagonal(d, np.inf)
        k = min(WAY, len(batch) - 1)
        return batch[np.argpartition(d, k, axis=1)[:, :k]] if k else np.full((len(batch), 1), -1)

    def _link(self, own: np.ndarray, proposed: np.ndarray) -> None:
        kept = robust_prune(self.x, own, proposed, self.degree, self.relax)
        self.near[own] = -1
        self.near[own, : self.degree], self.count[own] = kept, (kept >= 0).sum(axis=1)
        src, dst = np.repeat(own, self.degree), kept.ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        linked = (self.near[dst] == src[:, None]).any(axis=1)
        src, dst = src[~linked], dst[~linked]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        while len(dst):
            first = np.concatenate([[True], dst[1:] != dst[:-1]])
            slot = self.count[dst] + np.arange(len(dst)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            fits = slot < self.room
            self.near[dst[fits], slot[fits]] = src[fits]
            np.add.at(self.count, dst[fits], 1)
            src, dst = src[~fits], dst[~fits]
            full = np.unique(dst)
            if len(full):
                kept = robust_prune(self.x, full, self.near[full], self.degree, self.relax)
                self.near[full] = -1
                self.near[full, : self.degree], self.count[full] = kept, (kept >= 0).sum(axis=1)

    def _reached(self) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        seen[self.start] = True
        edge = np.array([self.start])
        while len(edge):
            to = np.unique(self.near[edge])
            edge = to[(to >= 0) & ~seen[to]]
            seen[edge] = True
        return seen

    def _reach_all(self, beam: int) -> None:
        """Nodes that no way leads to are linked from the nearest reached node that has room; its list is made longer if none has."""
        while not (seen := self._reached()).all():
            lost = np.flatnonzero(~seen)[:BATCH]
            ids, _ = beam_search(self.x, self.near, self.start, self.x[lost], beam)
            for node, found in zip(lost, ids, strict=True):
                found = found[found >= 0]
                free = found[self.count[found] < self.near.shape[1]]
                if not len(free):
                    self.near = np.hstack([self.near, np.full((len(self.x), 8), -1, np.int32)])
                    free = found
                self.near[free[0], self.count[free[0]]] = node
                self.count[free[0]] += 1


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a shard with their numbers and lists of neighbours; node 0 is the start."""
    table = table.combine_chunks()
    x = lifted(_matrix(table["vec"]))
    graph = Graph(x)
    order = np.concatenate([[graph.start], np.delete(np.arange(len(x)), graph.start)])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    near = [place[graph.near[i, : graph.count[i]]].astype("<i4").tobytes() for i in order]
    table = table.take(pa.array(order))
    return pa.table({"dim": table["dim"], "shard": table["shard"], "node": pa.array(np.arange(len(x)), pa.int32()), "ids": table["ids"], "vec": table["vec"], "near": pa.array(near, pa.binary())})


def build_index(vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(dim, shard, node, ids, vec, near): the graphs over all of ``vectors``, written to the shared folder.

    A row is a distinct vector with its k + 1 smallest ids (in any number of rows of an id it counts once), and ``near`` holds the
    numbers of its neighbours in the shard (int32). Node 0 is where searches start. Rows without an id, and vectors that are null,
    empty, zero or hold null or non-finite components, are left out.
    """
    n = shuffle_partitions(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`").cast("array<double>")).mapInArrow(_rows, "vec_id long, dim int, key binary, vec binary")
    # Spark limits a window of ranks before its shuffle too, so a vector that very many rows share leaves k + 1 rows of each task.
    smallest = rows.dropDuplicates(["key", "vec_id"]).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = Spill(smallest.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes").df
    shards = max(1, math.ceil(classes.count() / shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("long")).select("dim", "shard", "ids", "vec")
    # repartition: AQE would fold shards into few tasks by their size in bytes.
    graphs = dealt.repartition(max(n, shards), "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, INDEX)
    return Spill(graphs, "graph").df


def _search(k: int, beam: int, step: int = 512):
    """A block of queries against a shard: the k best rows of the shard for each query."""

    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(index) or not len(queries):
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("query_key", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        index = index.sort_by("node").combine_chunks()
        vecs, lists = _matrix(index["vec"]), [np.frombuffer(x, "<i4") for x in index["near"].to_pylist()]
        near = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int32)
        for i, x in enumerate(lists):
            near[i, : len(x)] = x
        x, own = lifted(vecs), index["ids"].to_pylist()
        size = np.array([len(i) for i in own])
        flat, offset = np.concatenate([np.array(i, np.int64) for i in own]), np.concatenate([[0], np.cumsum(size)])
        q_all, q_ids, q_keys = _matrix(queries["vec"]), np.array(queries["query_id"].to_pylist(), np.int64), queries["query_key"].to_pylist()
        parts = []
        for a in range(0, len(q_ids), step):
            q = q_all[a : a + step]
            # A shard of no more nodes than a beam holds is its own candidate set.
            ids = np.tile(np.arange(len(x)), (len(q), 1)) if len(x) <= beam else beam_search(x, near, 0, lifted_queries(q), beam)[0]
            r, c = np.nonzero(ids >= 0)
            node = ids[r, c]
            score = np.zeros(len(r))
            for d in range(q.shape[1]):  # in the order of the components, so that equal vectors score equally everywhere
                score += vecs[node, d] * q[r, d]
            times = size[node]
            row = np.repeat(r, times)
            which = np.repeat(offset[node] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(row))
            vid, score = flat[which], np.repeat(score, times)
            other = vid != q_ids[a + row]
            row, vid, score = row[other], vid[other], score[other]
            order = np.lexsort((vid, -score, row))
            row, vid, score = row[order], vid[order], score[order]
            first = np.searchsorted(row, row)
            best = np.arange(len(row)) - first < k
            parts.append((a + row[best], vid[best], score[best]))
        row, vid, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"query_id": pa.array(q_ids[row]), "query_key": pa.array([q_keys[i] for i in row], pa.binary()), "vec_id": pa.array(vid), "score": pa.array(score)})

    return run


def search_index(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``index`` but those of its own id."""
    n = shuffle_partitions(queries.sparkSession)
    asked = queries.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`").cast("array<double>")).mapInArrow(_rows, "vec_id long, dim int, key binary, vec binary")
    asked = asked.withColumnsRenamed({"vec_id": "query_id", "key": "query_key"}).dropDuplicates(["query_id", "query_key"])
    asked = Spill(asked, "queries").df
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, math.ceil(asked.count() / query_rows))
    # Queries meet all shards: that is the search. Blocks of them bound the task, and a shard travels once a block.
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    key = ["dim", "shard", "block"]
    groups = max(n, shards * blocks)
    found = left.repartition(groups, *key).groupBy(*key).cogroup(right.repartition(groups, *key).groupBy(*key)).applyInArrow(_search(k, beam), FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = BEAM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the ``k`` rows of ``vectors`` found with the largest inner product,
    from rank 1, ties to the smaller vec_id; all rows if there are fewer.

    Scores are exact, in double precision. Both tables have (vec_id, embedding); vectors are compared with those of their own
    length. Rows without a vec_id, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    Rows of a query's own id are no candidates of it. Rows that repeat an id and its vector count once; an id with several
    vectors is a query (and a candidate) for each of them. Empty tables give an empty table; other columns are ignored.
    """
    return search_index(build_index(vectors, k, shard_rows, id_col, vec_col), queries, k, beam, id_col=id_col, vec_col=vec_col)
