"""Embedding near-duplicates by Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c). Each table hashes a number of Gaussian
projections, shifted and quantised to WIDTH, to one bucket; buckets also hold the label, as only equal labels are compared.
For a pair at distance d one projection agrees with p(d) = 1 - 2 N(-w/d) - 2d / (sqrt(2 pi) w) (1 - exp(-w²/2d²)). A pair at the
threshold meets in at least one table with probability RECALL, a closer one more often. Larger labels take more projections, so
that as few unrelated vectors meet a vector as in a small one, and more tables, so that the recall stays (``table_plan``).

Equal vectors of a label fold into one class first. A bucket's rows are compared with matrix products, and what leaves it is a
count of links for each row and a spanning forest, never all pairs. A pair is counted in the first table in which it meets.
A bucket of more than BLOCK rows is dealt out in pairs of blocks, each a group of its own, so no task holds a large bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.plans.storage import Spill, shuffle_partitions

THRESHOLD, PROJECTIONS, WIDTH, SEED = 0.93, 8, 1.6, 7
#: Probability that a pair at the threshold meets, and rows of a label for which PROJECTIONS are enough.
RECALL, LABEL_ROWS = 0.997, 50_000
BLOCK = 1500
ROW = "bucket long, rep long, label string, mult long, vec binary, keys binary"


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two vectors at a distance into one cell."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(rows: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(tables, projections) for labels of at most ``rows`` vectors: the candidates of a vector don't grow with the label."""
    near, far = agreement(math.sqrt(max(2 - 2 * threshold, 1e-12)), width), agreement(math.sqrt(2), width)
    k = PROJECTIONS + max(0, math.ceil(math.log(max(rows, 1) / LABEL_ROWS) / -math.log(far)))
    return math.ceil(math.log(1 - recall) / math.log(1 - near**k)), k


class Hasher:
    def __init__(self, dim: int, tables: int, projections: int, width: float, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((dim, tables * projections))
        self.b = rng.uniform(0, width, tables * projections)
        self.mix = rng.integers(1, 2**63, tables * projections, dtype=np.uint64) | np.uint64(1)
        self.tables, self.width = tables, width

    def __call__(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(rows, tables) of 32-bit bucket keys; ``salt`` is a 64-bit hash of each row's label."""
        q = np.floor((unit @ self.a + self.b) / self.width).astype(np.int64).view(np.uint64)
        h = (q * self.mix).reshape(len(unit), self.tables, -1)
        h = (h ^ h >> np.uint64(29)).sum(axis=2, dtype=np.uint64) + salt[:, None]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(32)).astype(np.uint32)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding, label) -> (vec_id, label, key, vec): key is null for vectors that link with nothing."""
    for batch in batches:
        keys, vecs = [], []
        for vid, v, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            key = vec = None
            if v.is_valid and label is not None and vid is not None and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    vec = (x + 0.0).tobytes()  # -0 and 0 are equal
                    key = hashlib.blake2b(vec, digest_size=16).digest()
            keys.append(key)
            vecs.append(vec)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "vec"])


def _buckets(tables: int, projections: int, width: float):
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                out: list[tuple] = []
                for dim in sorted({len(r[3]) // 8 for r in part}):
                    own = [r for r in part if len(r[3]) // 8 == dim]
                    x = np.frombuffer(b"".join(r[3] for r in own), np.float64).reshape(-1, dim)
                    salt = np.array([int.from_bytes(hashlib.blake2b(f"{r[1]}/{dim}".encode(), digest_size=8).digest(), "little") for r in own], np.uint64)
                    scale = np.abs(x).max(axis=1, keepdims=True)
                    unit = x / scale
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    keys = hashers.setdefault(dim, Hasher(dim, tables, projections, width))(unit, salt)
                    out += [(t << 32 | int(k[t]), *r, k.tobytes()) for r, k in zip(own, keys, strict=True) for t in range(tables)]
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in ROW.split(", ")])

    return buckets


def _links(threshold: float, hot: int, sided: bool):
    """Rows sorted by bucket -> (kind, a, b, row...): 0 a spanning link, 1 a row of a hot bucket, 2 a class and its links.

    ``sided``: rows carry a side; only pairs of side 0 and 1 count, or all pairs if every row has side 2.
    """
    types = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    names = ["kind", "a", "b", "bucket", "label", "mult", "vec", "keys"]

    def rows_out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)

    def compare(group: list[tuple], found: dict[int, int], out: list[tuple]) -> None:
        table = group[0][0] >> 32
        by: dict[tuple, list[tuple]] = {}
        for r in group:
            by.setdefault((r[2], len(r[4])), []).append(r)  # equal hashes don't prove equal labels
        for own in by.values():
            if len(own) < 2:
                continue
            x = np.frombuffer(b"".join(r[4] for r in own), np.float64).reshape(len(own), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys = np.frombuffer(b"".join(r[5] for r in own), np.uint32).reshape(len(own), -1)
            ids, mult = np.array([r[1] for r in own]), np.array([r[3] for r in own])
            near = np.triu(x @ x.T >= threshold, 1)
            if sided:
                side = np.array([r[6] for r in own])
                near &= (side[:, None] != side[None, :]) | (side == 2)[:, None]
            i, j = np.nonzero(near)
            for t in range(table):  # met before
                new = keys[i, t] != keys[j, t]
                i, j = i[new], j[new]
            same = keys[i, table] == keys[j, table]  # cells of two buckets could share a number
            i, j = i[same], j[same]
            if not len(i):
                continue
            sums = np.bincount(i, mult[j], len(own)) + np.bincount(j, mult[i], len(own))
            for k in np.flatnonzero(sums):
                found[int(ids[k])] = found.get(int(ids[k]), 0) + int(sums[k])
            label = np.arange(len(own))
            for a in np.unique(i):
                to = j[i == a]
                groups, first = np.unique(label[to], return_index=True)
                new = groups != label[a]
                out += [(0, int(ids[a]), int(ids[to[f]]), None, None, None, None, None) for f in first[new]]
                if new.any():
                    label[np.isin(label, groups)] = label[a]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        over, found, out = None, {}, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and r[0] != group[0][0]:
                    compare(group, found, out)
                    group = []
                if r[0] == over or len(group) >= hot:
                    over = r[0]
                    out += [(1, x[1], None, x[0], *x[2:6]) for x in [*group, r]]
                    group = []
                    if len(out) > 2000:
                        yield rows_out(out)
                        out = []
                else:
                    group.append(r)
            out += [(2, k, v, None, None, None, None, None) for k, v in found.items()]
            found = {}
            yield rows_out(out)
            out = []
        if group:
            compare(group, found, out)
        yield rows_out(out + [(2, k, v, None, None, None, None, None) for k, v in found.items()])

    return links


LINK = "kind byte, a long, b long, bucket long, label string, mult long, vec binary, keys binary"


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, projections: int | None = None, width: float = WIDTH, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that are null, zero, or hold null or non-finite components, and rows without a label or a vec_id, link with
    nothing; their component is themselves. Vectors of different lengths are not compared. A repeated row counts as another
    vector. Cosines are taken in double precision. An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    table = rows.mapInArrow(_classes, "vec_id long, label string, key binary, vec binary")
    classes = table.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.min("vec").alias("vec"))
    classes = Spill(classes, "classes")
    n = shuffle_partitions(spark)
    if tables is None or projections is None:
        most = classes.df.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        chosen = table_plan(most, threshold, width)
        tables, projections = tables or chosen[0], projections or chosen[1]
    dealt = classes.df.select("rep", "label", "mult", "vec").repartition(n, "rep").mapInArrow(_buckets(tables, projections, width), ROW)
    first = Spill(dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_links(threshold, block, False), LINK), "near")
    hot = first.df.where("kind = 1")
    blocks = hot.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block // 2)).cast("int").alias("nb"))
    mine = hot.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("a"), F.col("nb")).cast("int"))
    other = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("own", "o"), F.greatest("own", "o")
    cell = F.pmod(F.xxhash64("bucket", lo, hi), F.lit(1 << 32))
    # the table stays in the upper half; the cell takes the lower, and (label, keys) are compared again in each cell
    sided = other.select(
        (F.call_function("shiftleft", F.call_function("shiftright", "bucket", F.lit(32)), F.lit(32)) + cell).alias("bucket"), F.col("a").alias("rep"), "label", "mult", "vec", "keys",
        F.when(F.col("own") == F.col("o"), F.lit(2)).when(F.col("own") < F.col("o"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
    )
    second = sided.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_links(threshold, 1 << 40, True), LINK)
    found = first.df.where("kind <> 1").select("kind", "a", "b").unionByName(second.select("kind", "a", "b"))
    found = Spill(found, "links").df
    parts = connected_components(found.where("kind = 0"), "a", "b").select(F.col("node").alias("rep"), "component")
    counts = found.where("kind = 2").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    named = classes.df.select("label", "key", "rep", "mult").join(counts, "rep", "left").join(parts, "rep", "left")
    named = named.select("label", "key", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = table.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
