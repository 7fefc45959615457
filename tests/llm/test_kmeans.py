import hashlib
import math

import numpy as np
import pytest

from weftline.llm import kmeans as C

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    cents = [list(v) for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    part = [sum(d for d, c in own if c == n) for n in range(len(cents))]
    return sorted((str(i), c, d, part[c], sum(part), cents[c]) for (i, _), (d, c) in zip(kept, own, strict=True))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in C.cluster_vectors(df, **kw).collect())


def cases(n=150, dim=12):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, dim)) * np.linspace(0.1, 2, dim)
    rows = [(i, [float(np.float32(x)) for x in base[rng.integers(6)] + rng.standard_normal(dim) * 0.3]) for i in range(n)]
    rows += [(900 + i, rows[i][1]) for i in range(20)] + [(5, rows[9][1]), (5, rows[9][1]), (None, rows[3][1]), (None, [0.0] * dim)]
    return rows + [(1001, None), (1002, [float("nan")] * dim), (1003, [1.0] * (dim - 1)), (1004, []), (1005, [None] + [1.0] * (dim - 1)), (1006, [float("inf")] * dim)]


def test_equals_plain_rounds(spark):
    assert run(spark, cases(), k=7, rounds=4, dim=12) == brute(cases(), 7, 4, 12)


def test_fewer_vectors_than_centroids_and_equal_ones(spark):
    few = [(i, [1.0, float(i % 2)]) for i in range(5)] + [(None, [3.0, 3.0])]
    assert run(spark, few, k=40, rounds=5, dim=2) == brute(few, 40, 5, 2)
    same = [(i, [0.5, -0.5]) for i in range(200)]
    assert run(spark, same, k=4, rounds=5, dim=2) == brute(same, 4, 5, 2)


def test_empty_and_too_large(spark):
    assert run(spark, [(1, None), (2, [1.0])]) == []
    with pytest.raises(Exception, match="would not fit"):
        run(spark, [(1, [1e30, 0.0])], dim=2)


def test_abandoning_is_exact():
    rng = np.random.default_rng(1)
    for dim in (3, 8, 20, 64):
        x, c = rng.integers(-40, 40, (300, dim)), rng.integers(-40, 40, (17, dim))
        c[5] = c[2]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at, best = C.nearest(x, c, rng.permutation(dim))
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
