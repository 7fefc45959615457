import random

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions.jaro_batches import jaro_scores, scores
from weftline.operators import matching as M
from weftline.operators import pairs as P


def slow_jaro(a, b, whole):
    if a == b or not a or not b:
        return float(a == b)
    reach, taken, first = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            first.append(x)
    m, moved = len(first), sum(x != b[j] for x, j in zip(first, sorted(taken), strict=True))
    return (m / len(a) + m / len(b) + (m - (moved // 2 if whole else moved / 2)) / m) / 3 if m else 0.0


def test_jaro_of_batches_equals_a_plain_loop():
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcé") for _ in range(n))
    both = [(text(rnd.randrange(20)), text(rnd.randrange(20))) for _ in range(400)] + [(text(a), text(b)) for a, b in ((64, 3), (30, 64), (40, 40), (65, 2), (90, 150), (200, 70)) for _ in range(5)]
    both += [("xabcyqq", "xbcayqq"), ("", "a"), (None, "a"), ("a", None), ("a", "a")]
    for whole in (False, True):
        j, w = scores(*[pa.array(x).slice(3) for x in zip(*both, strict=True)], whole)
        for (a, b), s, t in zip(both[3:], j.to_pylist(), w.to_pylist(), strict=True):
            if a is None or b is None:
                assert s is t is None
                continue
            a, b = a.encode(), b.encode()
            same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 4)
            assert abs(s - slow_jaro(a, b, whole)) < 1e-12 and abs(t - (s + same * 0.1 * (1 - s))) < 1e-12


def test_folded_pairs_are_all_pairs_of_a_key(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["k", "k", "k", "l", None]), rnd.choice(["abcd", "bcad", "xy", None])) for i in range(200)]
    own = P.fold(spark.createDataFrame(rows, "id long, k string, v string"), ["k", "v"], chunk=7)
    assert own.agg(F.max(F.size("ids"))).first()[0] < 30
    met = P.meet(own, own, ["k"], "v", F.size("ids"), block=9)
    some = met.select(F.col("x.v").alias("p"), F.col("y.v").alias("q"), F.col("x.ids").alias("i"), F.col("y.ids").alias("j"))
    got = sorted((r.a, r.b, r.jaro) for r in P.ordered(jaro_scores(some, "p", "q"), "i", "j").select("a", "b", "jaro").collect())
    want = sorted((i, j, None if p is None or q is None else slow_jaro(p.encode(), q.encode(), False)) for i, k, p in rows for j, m, q in rows if i < j and k == m and k)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(x[2] == y[2] or abs(x[2] - y[2]) < 1e-12 for x, y in zip(got, want, strict=True))
    once = met.where(F.array_min("x.ids") <= F.array_min("y.ids")).select(F.col("x.ids").alias("i"), F.col("y.ids").alias("j"), (F.array_min("x.ids") == F.array_min("y.ids")).alias("s"))
    assert sorted(tuple(r) for r in P.expand(once, "i", "j", F.col("s")).select("a", "b").collect()) == [x[:2] for x in want]


def test_pairs_of_few_bytes_are_dealt_over_tasks(spark, tmp_path):
    from weftline import catalog

    spark.range(3000).selectExpr("id p_partkey", "concat('part ', id % 9) p_name", "'b' p_brand", "1 p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spread = catalog.QUERIES["lev_similarity"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("similarity").alias("s")).collect()
    whole = 3000 * 2999 // 2
    equal = sum(n * (n - 1) // 2 for n in [334] * 3 + [333] * 6)
    assert sum(r.n for r in spread) == whole and max(r.n for r in spread) < whole * 0.8
    assert abs(sum(r.s for r in spread) - (equal + (whole - equal) * round(1 - 1 / 6, 6))) < 1


def people(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, "anna", "Anna", "otto", "ottilie"]), rnd.choice(["a@x.y", "b@x.y", None]), rnd.randrange(6)) for i in range(180)]
    return spark.createDataFrame(rows, "id long, name string, mail string, size int").repartition(3)


def test_matched_pairs_equal_scored_candidates(spark):
    C = M.Condition
    rules = [
        M.Rule("mail", (C("mail", weight=2.0, required=True), C("size", "numeric", threshold=6.0), C("name", "fuzzy", threshold=0.4))),
        M.Rule("sound", (C("name", "phonetic", required=True), C("mail", weight=0.5)), priority=1),
        M.Rule("veto", (C("size"), C("name", no_merge=True, invert=True))),
    ]
    index = M.build_index(people(spark), rules)
    plain = lambda df: sorted(map(str, df.select("a", "b", "score", "rule", "blocked", "auto_merge").collect()))
    for own in (None, rules[1:], []):
        assert plain(M.matched_pairs(index, rules, own)) == plain(M.score_pairs(M.candidates(index, rules if own is None else own), index, rules))


def test_candidate_table_of_matched_pairs_groups_nothing(spark):
    C = M.Condition
    rules = [M.Rule("mail", (C("mail", required=True), C("size", "numeric", 2.0, threshold=4.0))), M.Rule("name", (C("name", required=True), C("mail")))]
    pairs = M.matched_pairs(M.build_index(people(spark), rules), rules)
    once = M.candidate_table(pairs, once=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, M.candidate_table(pairs).collect())) and once.count() > 1000
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Generate")] and "RepartitionByExpression" not in plan[: plan.index("Generate")]
