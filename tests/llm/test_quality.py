import math
import random
from collections import Counter, defaultdict

from weftline.llm import quality as Q


def slow_model(texts, order=4):
    """Textbook interpolated modified Kneser-Ney over symbol tuples."""
    grams = Counter()
    for t in texts:
        grams.update(symbols(t))
    counts = {order: grams}
    for level in range(order - 1, 0, -1):
        counts[level] = Counter(g[1:] for g in counts[level + 1])
    model = {}
    for level, c in counts.items():
        n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
        s, left = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            s[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        model[level] = (c, d, s, left)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        c, d, s, left = model[len(g)]
        h = g[:-1]
        if not s.get(h):
            return p(g[1:])
        return max(c.get(g, 0) - d[min(c.get(g, 0), 3) - 1] if c.get(g, 0) else 0, 0) / s[h] + left[h] / s[h] * p(g[1:])

    return p


def symbols(text, order=4):
    clean = []
    for ch in text:
        ch = " " if ch <= " " or ch == "\xa0" else "0" if ch in "0123456789" else ch
        if not (ch == " " and clean and clean[-1] == " "):
            clean.append(ch)
    line = ["^"] * (order - 1) + clean
    return [tuple(line[i : i + order]) for i in range(len(clean))]


def say(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "an", "on", "es"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_probabilities_equal_the_textbook(spark):
    rnd = random.Random(1)
    train = [say(rnd, rnd.randrange(5, 40)) + rnd.choice(["", ". 12", "!"]) for _ in range(30)]
    docs = [*train[:5], "Never SEEN 99 ###", "th  er\n\tan", "日本語 x😀", "a"]
    model = Q.KneserNey(spark.createDataFrame([(t,) for t in [*train, None]], "text string").repartition(3))
    p = slow_model(train)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*docs, None, ""])], "doc_id long, text string")
    for shard in (Q.SHARD_GRAMS, 40):
        got = {r.doc_id: r for r in Q.score_documents(df, model, shard_grams=shard).collect()}
        for i, t in enumerate(docs):
            want = sum(math.log(p(g)) for g in symbols(t))
            assert abs(got[i].log_prob - want) < 1e-4 * max(1, abs(want)) and got[i].n_scored == len(symbols(t)) and got[i].text == len(t)
        assert got[len(docs)].text is None and got[len(docs) + 1].n_scored == 0


def test_good_is_kept_and_junk_goes(spark):
    rnd = random.Random(3)
    rows = [(i, "aa", say(rnd, rnd.randrange(2, 120))) for i in range(300)]
    junk = [(1000 + i, "aa", "".join(rnd.choice("#$%&ZQXJ 0") for _ in range(200))) for i in range(30)]
    odd = [(2000, None, "ther an on"), (2001, "aa", None), (2002, "zz", ""), (None, "aa", say(rnd, 30)), (5, "aa", "er")]
    df = spark.createDataFrame([(*r, True) for r in rows + junk + odd], "doc_id long, lang string, text string, kept boolean").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in [*range(0, 200), 3, None]], "doc_id long")
    got = Q.quality_by_perplexity(df, trusted).collect()
    assert len(got) == len(rows + junk + odd)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert sum(by[i].kept for i, *_ in rows if i != 5) >= 0.97 * 299 and not any(by[i].kept for i, *_ in junk)
    assert by[2000].kept and by[None].kept and not by[2001].kept and not by[2002].kept and by[2002].perplexity is None


def test_nothing_trusted_and_empty(spark):
    schema = "doc_id long, lang string, text string"
    none = spark.createDataFrame([], "doc_id long")
    got = Q.quality_by_perplexity(spark.createDataFrame([(1, "a", "x y"), (2, "a", None)], schema), none).collect()
    assert {r.doc_id: r.kept for r in got} == {1: True, 2: False}
    assert Q.quality_by_perplexity(spark.createDataFrame([], schema), none).collect() == []


def test_each_of_many_languages_has_its_threshold(spark):
    docs = spark.createDataFrame([(i, f"l{i % 40}", f"some words of text number {i} " * (1 + i % 40)) for i in range(1200)], "doc_id long, lang string, text string")
    got = Q.quality_by_perplexity(docs, docs.select("doc_id")).collect()
    assert len(got) == 1200 and len({(r.lang, r.threshold) for r in got}) == 40 and len({r.threshold for r in got}) > 30
