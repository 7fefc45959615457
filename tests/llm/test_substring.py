import difflib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import substring as S


def slow_chain_score(pos, rpos):
    score = []
    for i in range(len(pos)):
        best = 0.0
        for j in range(i):
            if pos[j] < pos[i] and rpos[j] < rpos[i]:
                best = max(best, score[j] - S.GAP_COST * (pos[i] - pos[j] + rpos[i] - rpos[j]))
        score.append(S.SHINGLE + best)
    return max(score)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
def test_best_chain_equals_quadratic_programme(matches):
    matches = sorted(matches)
    pos, rpos = np.array([p for p, _ in matches]), np.array([q for _, q in matches])
    found = S.chains(pos, rpos)
    assert sorted(i for c in found for i in c) == list(range(len(matches)))
    for c in found:
        assert all(pos[a] < pos[b] and rpos[a] < rpos[b] for a, b in zip(c, c[1:], strict=False))
    c = found[0]
    total = S.SHINGLE * len(c) - S.GAP_COST * (pos[c[-1]] - pos[c[0]] + rpos[c[-1]] - rpos[c[0]])
    assert abs(total - slow_chain_score(pos.tolist(), rpos.tolist())) < 1e-9


def arrays(texts):
    parts = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def keys_of(text):
    return set(S.seeds_of(*arrays([text]))[0].tolist())


def test_hashes_of_words_do_not_depend_on_the_cut(monkeypatch):
    rnd = random.Random(2)
    texts = ["", " \t", "A b C\td\u00e9\x0bxx  y", "one", " lead trail ", "x" * 90, *[" ".join(rnd.choices(["Abc", "d\u00e9", "f", "\u00a0g"], k=rnd.randrange(200))) for _ in range(40)]]
    words = [S.split_words(t) for t in texts]
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(S, "HASH_BYTES", size)
        h, bounds = S.word_hashes(*arrays(texts))
        assert np.diff(bounds).tolist() == [len(w) for w in words]
        pairs = set(zip([w for x in words for w in x], h.tolist(), strict=True))
        assert len(pairs) == len({w for w, _ in pairs}) == len({x for _, x in pairs})


def test_shared_runs_share_seeds():
    rnd = random.Random(1)
    w = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    for k, window in ((S.SHINGLE, 1), *S.LONG):
        run = w(k + window - 1)
        for _ in range(20):
            a, b = w(rnd.randrange(0, 40)) + run + w(rnd.randrange(0, 40)), w(rnd.randrange(0, 40)) + run
            assert keys_of(" ".join(a)) & keys_of(" ".join(b))
    assert not keys_of("too few words") and not keys_of(None)
    texts = [" ".join(w(rnd.randrange(0, 60))) for _ in range(30)]  # a text's seeds don't depend on its neighbours
    keys, own, places = S.seeds_of(*arrays(texts))
    for i, t in enumerate(texts):
        one = S.seeds_of(*arrays([t]))
        assert sorted(zip(keys[own == i].tolist(), places[own == i].tolist(), strict=True)) == sorted(zip(one[0].tolist(), one[2].tolist(), strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 9), st.integers(0, 30)), max_size=40))
def test_links_are_the_document_before_and_the_first(rows):
    key, doc, place = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint32, np.int64, np.int64)))
    got = sorted(zip(*(x.tolist() for x in S.links(key, doc, place)), strict=True))
    want = set()
    for k, d, p in rows:
        earlier = sorted({x for y, x, _ in rows if y == k and x < d})
        for rep in earlier[-1:] + earlier[:1]:
            want.add((d, rep, p, min(z for y, x, z in rows if (y, x) == (k, rep)), k))
    assert got == sorted(w[:4] for w in want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 300), st.integers(0, 300)), min_size=1, max_size=40, unique=True), st.booleans())
def test_ascending_matches_need_no_tree(rows, ascend):
    if ascend:
        rows = [(k, p, p + 7 * k + p // 50) for k, p, _ in rows]
    rows = sorted(set(rows))
    pair, pos, rpos = (np.array([r[i] for r in rows]) for i in range(3))
    order, chain = S._steps(pair, pos, rpos)
    got = sorted(sorted(order[chain == c].tolist()) for c in np.unique(chain))
    want = []
    for k in np.unique(pair):
        at = np.flatnonzero(pair == k)
        want += [sorted(at[c].tolist()) for c in S.chains(pos[at], rpos[at])]
    assert got == sorted(want)


def corpus():
    rnd = random.Random(4)
    w = lambda n: [f"v{rnd.randrange(3000)}" for _ in range(n)]
    passage, fuzzy, big = w(60), w(120), w(5000)
    changed = [x if i % 11 else "new" for i, x in enumerate(fuzzy)]
    docs = {i: w(rnd.randrange(0, 200)) for i in range(20)}
    docs |= {100: w(40) + passage + w(30), 101: w(5) + [x.upper() for x in passage], 102: passage + w(70), 103: w(30) + passage[:40] + w(30)}
    docs |= {110: w(50) + fuzzy + w(20), 111: w(10) + changed + w(25)}
    docs |= {120: big, 121: w(30) + big + w(10), 122: list(docs[110])}
    docs |= {130: ["the", "same", "six", "words", "come", "again"] * 40, 131: ["the", "same", "six", "words", "come", "again"] * 40}
    return docs, passage, fuzzy, big


def covered(rows, doc):
    return {i for r in rows if r.doc_id == doc for i in range(r.start_word, r.end_word)}


def test_passages(spark):
    docs, passage, fuzzy, big = corpus()
    rows = [(i, "\n".join([" ".join(x[:7]), "  ".join(x[7:])]), 0) for i, x in docs.items()] + [(None, " ".join(passage), 0), (900, None, 0), (901, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int").repartition(5)
    got = S.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {101, 102, 111, 121, 122, 131}
    assert all(r.rep_doc_id < r.doc_id and r.identity >= 0.8 and r.end_word - r.start_word >= 50 for r in got)
    assert set(range(5, 65)) <= covered(got, 101) and len(covered(got, 101) - set(range(5, 65))) <= 2
    assert set(range(60)) <= covered(got, 102)
    assert len(set(range(11, 129)) & covered(got, 111)) >= 115
    assert len(covered(got, 121)) >= 4995 and covered(got, 122) == set(range(len(docs[122]))) and len(covered(got, 131)) == 240


def test_removal(spark):
    docs, passage, *_ = corpus()
    rows = [(i, " ".join(x), "s") for i, x in docs.items()] + [(None, "null id stays", "s"), (900, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans string")
    got = {r.doc_id: r.text for r in S.remove_repeated_passages(df).collect()}
    assert 131 not in got and 122 not in got
    assert got[None] == "null id stays" and got[900] is None and got[102].split() == docs[102][60:]
    untouched = [i for i in docs if i not in (101, 102, 111, 121, 122, 131)]
    assert all(got[i] == " ".join(docs[i]) for i in untouched)


def test_empty(spark):
    assert S.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows(spark):
    docs, passage, *_ = corpus()
    one, two = " ".join(docs[100]), " ".join(docs[101])
    df = spark.createDataFrame([(1, one), (1, one), (2, two), (2, two)], "doc_id long, text string")
    got = S.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {2}
    assert len({r.text for r in S.remove_repeated_passages(df).where("doc_id = 2").collect()}) == 1


def test_all_passages_of_a_weak_part():
    rnd = random.Random(7)
    w = lambda n, x: [f"{x}{rnd.randrange(10**6)}".encode() for _ in range(n)]
    one, two, three, four = w(60, "s"), w(10, "s"), w(10, "s"), w(60, "s")
    a, b = (one + w(12, x) + two + w(12, x) + three + w(12, x) + four for x in "ab")
    got = S.align(a, b, [0, 116], [0, 116], [4, 4])
    cover = {i for r in got for i in range(r[0], r[1])}
    assert cover >= set(range(60)) | set(range(116, 176)) and all(r[4] >= 0.8 and r[1] - r[0] >= 50 for r in got)


def test_recall_of_short_changed_passages(spark):
    rnd = random.Random(5)
    w = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(120):
        n = rnd.randrange(50, 71)
        passage, changed = w(n), (set(rnd.sample(range(n), n * (10, 15, 20)[i % 3] // 100)) if i % 2 else set(range(2, n, 5 + i % 4)))
        same = [x for x in range(n) if x not in changed]
        best = max(((y - x + 1, x, y + 1) for x in same for y in same if y - x >= 49 and sum(x <= z <= y for z in same) >= 0.8 * (y - x + 1)), default=None)
        if best:  # by brute force
            want[1000 + i] = set(range(20 + best[1], 20 + best[2]))
        rows += [(i, " ".join(w(30) + passage + w(30))), (1000 + i, " ".join(w(20) + [f"n{rnd.randrange(10**6)}" if k in changed else x for k, x in enumerate(passage)] + w(30)))]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(want) > 100
    assert sum(len(covered(got, i) & x) >= 0.9 * len(x) for i, x in want.items()) >= 0.99 * len(want)


def test_lines_in_an_earlier_document(spark):
    rnd = random.Random(8)
    w = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    passage = w(72)
    lines = [passage[max(0, i) : i + 9] for i in (*range(0, 72, 9), *range(-4, 72, 9))]  # every run of four words is in one
    mixed = lambda: [x for i in rnd.sample(range(len(lines)), len(lines)) for x in lines[i] + w(20)]
    docs = {1: mixed(), 5: w(30) + passage + w(20), 6: w(10) + passage + w(30)}
    later = {1: w(30) + passage + w(20), 5: w(10) + passage + w(30), 9: mixed()}
    both = {**docs, 9: mixed()}
    for case, doc, rep in ((docs, 6, 5), (later, 5, 1), (both, 6, 5)):
        got = S.repeated_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in case.items()], "doc_id long, text string")).collect()
        assert {(r.doc_id, r.rep_doc_id) for r in got} == {(doc, rep)} and set(range(10, 82)) <= covered(got, doc)


def test_passage_twice_in_a_later_document(spark):
    rnd = random.Random(9)
    w = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    passage = w(60)
    docs = {1: w(20) + passage + w(20), 2: w(10) + passage + w(30) + passage + w(25) + passage}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id long, text string")
    got = S.repeated_passages(df).collect()
    assert {*range(10, 70), *range(100, 160), *range(185, 245)} <= covered(got, 2) and {r.doc_id for r in got} == {2}
    assert {r.doc_id: r.text.split() for r in S.remove_repeated_passages(df).collect()}[2] == docs[2][:10] + docs[2][70:100] + docs[2][160:185]


def test_fragments_in_other_documents(spark):
    rnd = random.Random(10)
    w = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    passage = w(160)
    quarters = lambda at: {at + i: w(20) + passage[40 * i : 40 * i + 40] + w(20) for i in range(4)}
    for case in ({**quarters(1), 10: w(30) + passage, 11: passage + w(9)}, {5: w(30) + passage, **quarters(6), 11: passage + w(9)}):
        df = spark.createDataFrame([(i, " ".join(x)) for i, x in case.items()], "doc_id long, text string")
        got = [r for r in S.repeated_passages(df).collect() if r.doc_id == 11]
        assert set(range(160)) <= covered(got, 11)


def test_all_pairs_by_brute_force(spark):
    """Exact runs of 50 words or more that an earlier document has, by comparing all pairs, are covered but for less than a shingle
    at an end (where another document's passage ends first); all that is found is similar."""
    rnd = random.Random(11)
    pool = [[f"p{i}w{rnd.randrange(40)}" for _ in range(rnd.randrange(20, 120))] for i in range(12)]
    docs = {}
    for i in range(60):
        words = []
        for _ in range(rnd.randrange(1, 6)):
            p = rnd.choice(pool)
            at = rnd.randrange(len(p) // 2)
            words += p[at : at + rnd.randrange(10, 110)] + [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 30))]
        docs[i] = words
    want = {}
    for d, a in docs.items():
        for e, b in docs.items():
            if e < d:
                length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for i in range(len(a)):
                    for j in range(len(b)):
                        if a[i] == b[j]:
                            length[i + 1][j + 1] = length[i][j] + 1
                            if length[i + 1][j + 1] >= S.MIN_WORDS:
                                want.setdefault(d, set()).update(range(i + 1 - S.MIN_WORDS, i + 1))
    got = S.repeated_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id long, text string")).collect()
    assert len(want) > 20
    missed = {d: sorted(places - covered(got, d)) for d, places in want.items()}
    assert sum(map(len, missed.values())) <= 0.001 * sum(map(len, want.values())) and max(map(len, missed.values())) < S.SHINGLE, missed
    for r in got:
        a, b = docs[r.doc_id][r.start_word : r.end_word], docs[r.rep_doc_id][r.rep_start : r.rep_end]
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert r.rep_doc_id < r.doc_id and max(len(a), len(b)) >= S.MIN_WORDS and sum(x.size for x in m.get_matching_blocks()) >= S.IDENTITY * max(len(a), len(b)) - 1e-9


def test_frequent_keys_dealt_by_ranges_find_the_same(spark):
    docs, passage, *_ = corpus()
    docs |= {200 + i: [f"z{i}", *passage, f"y{i}"] for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id long, text string").repartition(5)
    assert S._hot(df.select(df.doc_id.alias("doc"), "text"), len(docs), 20) is not None
    plain, split = (S.repeated_passages(df, range_docs=n).collect() for n in (S.RANGE_DOCS, 20))
    assert {r.doc_id for r in plain} == {r.doc_id for r in split} >= set(range(200, 260))
    for d in {r.doc_id for r in plain}:
        assert covered(plain, d) == covered(split, d)


def test_very_long_text(spark):
    rnd = random.Random(12)
    long = [f"v{rnd.randrange(10**7)}" for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["a", *long[300_000:300_100], "b"])), (3, "x" * 3_000_000 + " tail")]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.rep_start) for r in got] == [(2, 1, 101, 300_000)]


def test_frequent_keys_keep_the_document_before_their_range(spark):
    rnd = random.Random(13)
    w = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    passage = w(96)
    lines = [passage[i : i + 5] for i in range(1, 96, 6)]  # what all documents share, scattered in the first one
    copy = lambda: [x if i % 6 else w(1)[0] for i, x in enumerate(passage)]
    docs = {1: [x for i in rnd.sample(range(len(lines)), len(lines)) for x in lines[i] + w(20)]}
    docs |= {10 + i: w(20) + copy() + w(20) for i in range(12)}
    pool = [[f"p{i}w{rnd.randrange(40)}" for _ in range(rnd.randrange(60, 120))] for i in range(4)]
    docs |= {40 + i: [x for p in rnd.sample(pool, 2) for x in p[rnd.randrange(9) :]] + w(9) for i in range(20)}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id long, text string").repartition(5)
    plain = sorted(map(tuple, S.repeated_passages(df).collect()))
    assert {r[0] for r in plain} >= set(range(11, 22))
    for n in (3, 11):
        assert sorted(map(tuple, S.repeated_passages(df, range_docs=n).collect())) == plain


def test_words_are_hashed_once_for_both_sides(spark, monkeypatch):
    docs, *_ = corpus()
    seen, codes = spark.sparkContext.accumulator(0), S._codes

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield from codes(iter([batch]))

    monkeypatch.setattr(S, "_codes", counted)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"  # large tables are shuffled
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert {r.doc_id for r in S.repeated_passages(df).collect()} == {101, 102, 111, 121, 122, 131}
    finally:
        spark.conf.set(key, before)
    assert seen.value == len(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(-5, 5), st.integers(0, 9)), min_size=1, max_size=40), st.sampled_from([1, 2**40, 2**60]))
def test_order_of_seeds(rows, scale):
    rows += [(r[0], r[1], 3) for r in rows[::2]]
    key, doc, place = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint32, np.int64, np.int64)))
    order = S._by_pair(key, doc * scale, place)
    assert list(zip(*(x[order].tolist() for x in (key, doc, place)), strict=True)) == sorted(rows)


def test_words_of_many_chains_are_aligned_as_one_by_one():
    rnd = random.Random(14)
    rows, want = [], []
    code = lambda x: b"".join(v.to_bytes(S.CODE, "little") for v in x)
    for i in range(400):
        n = rnd.randrange(0, 120)
        a = [rnd.randrange(1 << 24) for _ in range(n)]
        b = [x if rnd.random() < rnd.choice([0.6, 0.95]) else 7 for x in a]
        a, b = [1] * rnd.randrange(9) + a, [2] * rnd.randrange(9) + b
        p = sorted(rnd.sample(range(130), rnd.choice([1, 1, 3])))
        runs = [[x + 5 for x in p], [x + len(b) - len(a) + 8 for x in p], [4] * len(p)]
        rows.append((i, -i, (i - 9).to_bytes(8, "little", signed=True), 5, code(a), 8, code(b), *runs))
        ok = [(x, y + len(b) - len(a), 4) for x, y in zip(p, p, strict=True) if x < len(a) and 0 <= y + len(b) - len(a) < len(b)]
        found = S.align(a, b, *map(list, zip(*ok, strict=True))) if ok else []
        want += [(i, i - 9, s + 5, e + 5, -i, t + 8, u + 8, same) for s, e, t, u, same in found]
    kinds = [S.pa.int64()] * 2 + [S.pa.binary()] + [S.pa.int32(), S.pa.binary()] * 2 + [S.pa.list_(S.pa.int32())] * 3
    batch = S.pa.record_batch([S.pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f"c{i}" for i in range(10)])
    got = [tuple(r.values()) for b in S._align(iter([batch.slice(0, 300), batch.slice(300)])) for r in b.to_pylist()]
    assert len(want) > 50 and got == want
