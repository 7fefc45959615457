import random

import numpy as np
import xxhash

from weftline.llm import simhash as S


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in [None, "", " \n", "One", "One two", "a b c", "A B c\x0bd É e f g", "x " * 500, "\x1c \x85 a b"]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_golay_code_is_perfect_and_anchors_cover():
    table, count = S.golay_errors(2)[0]
    assert (count == 1).all() and table.shape == (2048, 1)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for a, b in [(0, 1), (5, 40), (22, 23), (45, 63), (3, 3)]:
        y = x ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))
        anchor, index, home = S.anchors_of(x)
        homes = dict(zip(index[home].tolist(), anchor[home].tolist(), strict=True))
        near = set(zip(*[v.tolist() for v in S.anchors_of(y)[1::-1]], strict=True))
        assert all((i, homes[i]) in near for i in range(300))


def near_set(rnd, n=400):
    base = [rnd.getrandbits(64) for _ in range(60)]
    out = set(base)
    while len(out) < n:
        x = rnd.choice(list(out))
        for _ in range(rnd.randrange(1, 5)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


def check_links(spark, fps, hot, bits=2):
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [(r.src, r.dst) for r in S.fingerprint_links(df, bits, hot).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= bits for a, b in got)
    want = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits]
    assert groups(signed, got) == groups(signed, want)


def test_links_span_the_same_groups_as_brute_force(spark):
    check_links(spark, near_set(random.Random(1)), S.HOT_ANCHOR)


def test_hot_anchors_go_the_exact_way(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    fps = sorted({centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)})
    check_links(spark, fps, 5)
    check_links(spark, fps, S.HOT_ANCHOR)
    near = near_set(rnd, 200)
    for bits in (0, 1, 2):
        check_links(spark, near, 1, bits)


def test_groups(spark):
    rnd = random.Random(4)
    words = ["w%d" % i for i in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 200))) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + texts[:20] + [None, "", " \t", "One", "one "]
    rows = [(1000 - i, t, i) for i, t in enumerate(texts)] + [(1000, texts[0], 0), (None, texts[0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = S.simhash_groups(df).collect()
    assert len(got) == len(rows)
    fps = {}
    for d, t, _ in rows:
        if d is not None:
            fps[d] = slow_fingerprint(t)
    want = groups(fps, [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
        else:
            assert r.component_id == want[1000]


def test_empty_and_unnamed(spark):
    schema = "doc_id long, text string"
    assert S.simhash_groups(spark.createDataFrame([], schema)).collect() == []
    only = S.simhash_groups(spark.createDataFrame([(None, "a"), (None, "a")], schema)).collect()
    assert [r.component_id for r in only] == [None, None]
