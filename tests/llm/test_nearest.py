import math

import numpy as np

from weftline.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, dim string, rank int"


def dot(v, w):
    out = 0.0
    for a, b in zip(v, w, strict=True):  # sum() compensates
        out += a * b
    return out


def brute(rows, k, asked=lambda i: i % 20 == 0):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in ok:
        if asked(i):
            out[i, v] = sorted((-dot(v, w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    out = {}
    for r in sorted(N.nearest_neighbours(df, df.where("vec_id % 20 = 0"), **kw).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    return out


def vectors(n, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((15, dim))
    scale = rng.choice([0.5, 1, 2], n)
    return [(i, [float(np.float32(x)) for x in (base[rng.integers(15)] + rng.standard_normal(dim) * 0.6) * s]) for i, s in enumerate(scale)]


def recall(got, want, k):
    hits = sum(len({j for _, _, j in got[i]} & {j for _, j in w}) for (i, _), w in want.items())
    return hits / sum(len(w) for w in want.values())


def test_recall_and_exact_scores_over_shards(spark):
    rows = vectors(3000)
    want = brute(rows, 20)
    for size in (700, 16_384):
        got = run(spark, rows, shard_rows=size)
        assert recall(got, want, 20) >= 0.95
        exact = dict(rows)
        for i, found in got.items():
            assert [r for r, _, _ in found] == list(range(1, 21)) and [(s, j) for _, s, j in found] == sorted((s, j) for _, s, j in found)
            assert all(-s == dot(exact[i], exact[j]) for _, s, j in found)


def test_small_tables_are_exact_with_ties_and_odd_rows(spark):
    rows = vectors(45, 5) + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(41)] + [(120, [1.0, 0.0, 0.0, 0.0, 0.0])] * 3
    rows += [(None, [1.0] * 5), (200, None), (220, [0.0] * 5), (240, [float("nan")] * 5), (260, []), (280, [None, 1.0, 1.0, 1.0, 1.0]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, [1.0, 1.0, 1.0])]
    got = run(spark, rows)
    for (i, _), w in brute(rows, 20).items():
        assert [(s, j) for _, s, j in got.get(i, [])] == w
    assert set(got) == {0, 20, 40, 100, 120, 140, 300}


def test_copies_beyond_k(spark):
    rows = [(i, [1.0, 1.0]) for i in range(500)] + [(1000, [2.0, 2.0])]
    got = run(spark, rows)
    assert [j for _, _, j in got[0]] == [1000, *range(1, 20)] and [j for _, _, j in got[480]] == [1000, *range(19)]


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(3, [1.0])]) == {} and run(spark, [(20, [1.0])]) == {}


def test_graph_prunes_and_reaches_all():
    rng = np.random.default_rng(0)
    x = N.lifted(np.concatenate([rng.standard_normal((900, 16)), 1 + 1e-4 * rng.standard_normal((600, 16))]))
    g = N.Graph(x)
    assert g._reached().all() and (g.count <= g.near.shape[1]).all()
    for i in range(0, 1500, 50):
        own = g.near[i, : g.count[i]]
        assert len(set(own.tolist())) == len(own) and i not in own and (own >= 0).all()
    kept = N.robust_prune(x, np.array([3]), np.arange(900)[None])[0]
    kept = kept[kept >= 0]
    d = ((x[3] - x[kept]) ** 2).sum(axis=1)
    assert kept[0] == np.argsort(((x[:900] - x[3]) ** 2).sum(axis=1))[1] and (np.diff(d) >= 0).all()
    for a in range(len(kept)):
        for b in range(a):  # no kept neighbour hides another
            assert 1.2 * np.linalg.norm(x[kept[a]] - x[kept[b]]) > np.linalg.norm(x[kept[a]] - x[3]) * (1 - 1e-5)
