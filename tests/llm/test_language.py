import random
from collections import Counter

import numpy as np

from weftline.llm import language as L


def slow_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    line = " " + " ".join(words) + " " if words else "  "
    out = Counter(c for c in line if c != " ")
    out.update(line[i : i + 2] for i in range(len(line) - 1) if line[i : i + 2].strip())
    out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return sorted(out.values())


def test_grams_count_like_a_plain_counter():
    for t in ["", "a", "Ab, cd!", "Éa  ñ", "x9y z", "!!! ..", "one two one", "日本 語"]:
        assert sorted(L.grams(t)[1].tolist()) == slow_grams(t)


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    parts = {"aa": ["th", "er", "on", "ing"], "bb": ["sch", "eit", "ung", "ö"], "cc": ["ción", "ñ", "os", "la"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(parts))
        rows.append((i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 80))), lang))
    return rows


def test_profiles_and_prediction(spark):
    rows = corpus()
    df = spark.createDataFrame([*rows, (90, None, "aa"), (91, "x", None)], "doc_id long, text string, lang string").repartition(3)
    profiles = L.fit_profiles(df, size=50)
    for lang in ("aa", "bb", "cc"):
        every = [L.grams(t) for _, t, g in rows if g == lang]
        codes, at = np.unique(np.concatenate([c for c, _ in every]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([n for _, n in every]))
        assert profiles[lang].tolist() == L.top(codes, counts, 50).tolist()
    new = corpus(9, 40)
    odd = [(100, None, ""), (101, "", ""), (102, "12 !?", ""), (103, "sch " * 50_000, "")]
    d = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in new + odd], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in L.predict_language(d, profiles).collect()}
    assert all(got[i].lang_pred == g for i, _, g in new)
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())


def test_out_of_place_distance_equals_brute_force():
    rows = corpus(3, 12)
    profiles = {g: L.top(*L.grams(" ".join(t for _, t, x in rows if x == g)), 40) for g in ("aa", "bb", "cc")}
    model = L.Classifier(profiles, 30)
    for _, t, _ in rows:
        own = L.top(*L.grams(t), 30).tolist()
        size = max(len(p) for p in profiles.values())
        total = {g: sum(min(abs(p.tolist().index(x) - r), size) if x in p.tolist() else size for r, x in enumerate(own)) for g, p in profiles.items()}
        best = min(sorted(total), key=total.get)
        assert model.predict(t) == (best, 1 - total[best] / (size * len(own)))


def test_empty_table_and_no_model(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit_profiles(d) == {}
    assert L.predict_language(d, {}).collect() == []
    assert L.Classifier({}).predict("abc") == ("und", 0.0)


def test_held_out(spark):
    import zlib

    d = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    for r in d.select("doc_id", L.is_held_out().alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_marks_alone_are_no_letters(spark):
    rows = spark.createDataFrame([(1, "a quick text", "en"), (2, "ein kurzer text", "de")], "doc_id long, text string, lang string")
    model = L.Classifier(L.fit_profiles(rows))
    for text in ("\u0301", "\u0903", "\u20dd 12", " \u0301!", "", None):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("\u0301a")[0] in ("en", "de")
