import corpus_pipeline as C
from weftline.llm import queries as Q

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, path, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_on_planted_cases(spark, tmp_path):
    import random

    rnd = random.Random(1)
    say = lambda n: " ".join("".join(rnd.choice(["th", "er", "an", "on", "ing", "ed"]) for _ in range(rnd.randrange(1, 6))) for _ in range(n))
    row = lambda i, t: (i, t, "en", "s", None if t is None else len(t))
    item, passage = say(12), say(60)
    clean = [row(i, say(rnd.randrange(20, 150))) for i in range(30)]
    docs = [*clean, row(50, clean[3][1]), row(51, clean[4][1]), row(60, "12 !! ??"), row(61, None), row(62, ""), row(70, say(20) + " " + passage), row(71, passage + " " + say(25)), row(80, say(30) + " " + item + " " + say(5)), row(5, clean[5][1]), row(None, say(40))]
    path = f"file://{tmp_path}"
    write(spark, path, docs, [(1, item)])
    d = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(C.STAGES)
    a = stages["language"](spark, d, path)
    assert a.columns == COLUMNS and {60, 61, 62}.isdisjoint(x := {r.doc_id for r in a.collect()}) and x >= {r[0] for r in clean}
    b = stages["simhash"](spark, a, path)
    ids = sorted(r.doc_id for r in b.collect() if r.doc_id is not None)
    assert b.where("doc_id is null").count() == 1
    assert b.columns == COLUMNS and {50, 51}.isdisjoint(ids) and len(ids) == len(set(ids)) and set(ids) >= {r[0] for r in clean}
    c = stages["substring"](spark, b, path)
    text = {r.doc_id: r for r in c.collect()}
    assert c.columns == COLUMNS and passage in text[70].text and passage not in text[71].text and text[71].n_chars == len(text[71].text)
    e = stages["decontamination"](spark, c, path)
    left = {r.doc_id for r in e.collect()}
    assert e.columns == COLUMNS and left == set(text) - {80}
    packed = C.run(spark, path).collect()
    assert {r.doc_id for r in packed} == left
    assert set(Q.queries()) == {q for q in Q.queries() if q[:2] == "op"} and len(Q.queries()) == 10


def test_texts_that_share_an_id(spark):
    one, two, three = ("".join(f" {c}{i} word{i * k}" for i in range(60)) for k, c in ((3, "a"), (5, "b"), (7, "c")))
    rows = [(1, one), (1, two), (1, two), (2, one), (3, three), (4, three), (4, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(C.STAGES)["simhash"](spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, one), (1, two), (3, three)])


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    for name, docs in (("empty", []), ("odd", [(1, "long " * 300_000, "en", "s", 1), (None, None, None, None, None), (2, "", None, None, None), (2, "", None, None, None)])):
        path = f"file://{tmp_path}/{name}"
        write(spark, path, docs, [])
        rows = C.run(spark, path).collect()
        assert {r.doc_id for r in rows} <= {1}
