"""Hash and split of stored criteria as columns equal those of dicts; Metaphone's SQL equals its Column on odd words."""

import json

import duckdb
from pyspark.sql import functions as F

from weftline import catalog
from weftline.functions import criteria as C
from weftline.functions import similarity as S


def test_hash_and_split_equal_those_of_dicts(spark):
    wanted = [{"b": 1, "a": {"$in": [3, "x"], "$gt": 2}}, {"n": None, "c.d": 5, "t": True, "s": 'é"q\\'}, {}, {"x": [1, {"z": 1, "y": 2}]}, {"text": "5", "number": 5}]
    texts = [json.dumps(dict(reversed(w.items())), indent=n) for n, w in enumerate(wanted)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", C.hash_of(F.col("c")).alias("h"), C.split_texts(F.col("c")).alias("p"))
    got = {r.i: r for r in rows.collect()}
    for i, w in enumerate(wanted):
        asked, rest = C.split(w)
        assert got[i].h == C.criteria_hash(w)
        assert (got[i].p.asked, got[i].p.rest) == (C.canonical(asked), C.canonical(rest))


def test_odd_criteria(spark):
    texts = [None, "", "no json", "[1]", "5", '{"a":1,"a":2}', ' {"a": 5.00}', '{"a":5}', '{"a":"5"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", C.hash_of(F.col("c")).alias("h"), C.split_texts(F.col("c")).alias("p")).orderBy("i").collect()
    assert all(r.h is None and r.p is None for r in rows[:6])
    assert rows[6].h == rows[7].h != rows[8].h
    assert rows[7].p == ('{"a":5}', "{}")


def test_metaphone_sql_on_odd_words(spark):
    words = "knight gnome pneumonia wrong aerial xylophone whale thumb school nation partial special vision match this church phone laugh edge cell cycle queue back giant gym go vase zoo ahh ahha aha hww wwa wwwa ywy yyy yya mississippi buzz ccell dodge bbb x h a w wh 123 a-b über McCoy tsch".split()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (w VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w in words])
    want = dict(con.execute(f"SELECT w, {catalog._metaphone_sql('w')} FROM t").fetchall())
    got = {r.w: r.m for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", S.metaphone(F.col("w")).alias("m")).collect()}
    assert got == want
