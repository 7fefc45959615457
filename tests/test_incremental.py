import random

from pyspark.sql import functions as F

from weftline.operators import incremental as I
from weftline.operators import matching as M
from weftline.operators import merging as G

EDGE = "a long, b long"


def plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in parent}


def test_ten_increments_equal_one_run(spark, tmp_path):
    rnd, path = random.Random(5), f"file://{tmp_path}"
    steps = [[(rnd.randrange(400), rnd.randrange(400)) for _ in range(25)] for _ in range(9)]
    steps.append([(7, 7), (900, 900), (None, 3), *steps[0][:5], (1000, 399)])
    done = []
    for n, step in enumerate(steps, 1):
        assert I.extend_clusters(spark, path, spark.createDataFrame(step, EDGE)) == n
        done += step
        if n == 5:
            I.compact(spark, path, I.CLUSTER_TABLES)
        if n in (6, 10):
            assert {r.node: r.component for r in I.clusters(spark, path).collect()} == plain(done)


def test_a_large_cluster_is_not_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}"
    big = [(1000, 1000 + i) for i in range(1, 2000)]
    I.extend_clusters(spark, path, spark.createDataFrame(big, EDGE))
    for n, step in enumerate([[(1, 1500)], [(2, 3), (3, 2500)], [(2500, 1)]], 2):
        I.extend_clusters(spark, path, spark.createDataFrame(step, EDGE))
        assert spark.read.parquet(f"{path}/members/part={n}").count() <= 2 * len(step)  # though smaller ids came in
        assert I.touched_members(spark, path, n - 1).count() in (0, 2001, 2003)
    found = {r.component: r.n for r in I.clusters(spark, path).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert found == {1: 2003}


def test_a_replayed_and_a_broken_increment(spark, tmp_path):
    path = f"file://{tmp_path}"
    I.extend_clusters(spark, path, spark.createDataFrame([(1, 2)], EDGE))
    before = sorted(I.clusters(spark, path).collect())
    spark.createDataFrame([(9, 1, 2)], I.MEMBERS).write.parquet(f"{path}/members/part=2")  # never done
    assert sorted(I.clusters(spark, path).collect()) == before
    for _ in range(2):
        I.extend_clusters(spark, path, spark.createDataFrame([(2, 3)], EDGE), 2)
        assert {r.node: r.component for r in I.clusters(spark, path).collect()} == {1: 1, 2: 1, 3: 1}


def people(n, seed):
    rnd = random.Random(seed)
    names = ["".join(rnd.choice(["an", "be", "ro", "li", "ka", "st"]) for _ in range(rnd.randrange(2, 5))) for _ in range(30)]
    return [(i, rnd.choice(names) + rnd.choice(["", "", "x"]), rnd.choice(["a@x.y", "b@x.y", "c@x.y", None]), rnd.randrange(20)) for i in rnd.sample(range(200), n)]


def test_increments_of_matches_equal_all_at_once(spark, tmp_path):
    C = M.Condition
    rules = [
        M.Rule("mail", (C("mail", weight=2.0, required=True), C("size", "numeric", threshold=6.0))),
        M.Rule("name", (C("name", "fuzzy", threshold=0.6, required=True), C("mail", no_merge=True, invert=True)), priority=2),
        M.Rule("sound", (C("name", "phonetic", required=True), C("mail", weight=0.5))),
        M.Rule("off", (C("size", "numeric"),), is_active=False),
    ]
    schema, path, live = "id long, name string, mail string, size int", f"file://{tmp_path}", {}
    for n in range(1, 5):
        step = people(60 if n < 4 else 1, n)
        gone = [i for i in list(live)[:4] if i not in {r[0] for r in step}] if n in (2, 3) else []
        deleted = spark.createDataFrame([(i,) for i in gone], "id long") if gone else None
        I.extend_matches(spark, path, spark.createDataFrame(step, schema), rules, deleted=deleted, buckets=8)
        live = {i: r for i, r in live.items() if i not in gone} | {r[0]: r for r in step}
        if n == 2:
            I.compact(spark, path, I.MATCH_TABLES)
        if n == 1:
            continue
        got = sorted(map(str, I.current_matches(spark, path, None).collect()))
        want = sorted(map(str, M.find_matches(spark.createDataFrame(list(live.values()), schema), rules, top=None).select("source", "candidate", "score", "rule", "blocked", "auto_merge").collect()))
        assert got == want and len(got) > 50 and len(live) > 55
    assert I.current_matches(spark, path, 3).count() == M.find_matches(spark.createDataFrame(list(live.values()), schema), rules, top=3).count()


def test_only_touched_buckets_are_scanned(spark, tmp_path, capsys):
    path, rule = f"file://{tmp_path}", M.Rule("r", (M.Condition("k", required=True),))
    rows = spark.range(400).select("id", (F.col("id") % 200).cast("string").alias("k"))
    I.extend_matches(spark, path, rows, [rule], buckets=16)
    one = spark.createDataFrame([(1000, "7")], "id long, k string")
    new = spark.createDataFrame([('["7"]',)], "key string")
    scan = I._read(spark, path, "postings", I.POSTINGS, 1, I._touched(new, "key", 16), True)
    scan.explain("formatted")
    assert "PartitionFilters: [isnotnull(bucket" in capsys.readouterr().out and scan.count() < 100
    I.extend_matches(spark, path, one, [rule], buckets=16)
    assert {r.candidate for r in I.current_matches(spark, path).where("source = 1000").collect()} == {7, 207}


def test_golden_records_of_touched_clusters(spark, tmp_path):
    path, rules = f"file://{tmp_path}", [G.FieldRule("x", "sum")]
    rec = spark.range(300).select("id", F.col("id").cast("double").alias("x"), F.lit("s").alias("integration"), F.col("id").alias("updated_at"))
    build = lambda members: {r.component: (r.x, r.source_count) for r in G.golden_records(rec.join(members, F.col("id") == F.col("node")), rules, "component").collect()}
    golden = {}
    for n, step in enumerate([[(i, i + 100) for i in range(50)], [(3, 4), (200, 7)], [(250, 251)]]):
        I.extend_clusters(spark, path, spark.createDataFrame(step, EDGE))
        touched = build(I.touched_members(spark, path, n))
        golden |= touched
        assert n == 0 or len(touched) <= 2
        there = {r.component for r in I.clusters(spark, path).select("component").distinct().collect()}
        golden = {c: g for c, g in golden.items() if c in there}
        assert golden == build(I.clusters(spark, path))


def test_records_of_equal_facts_are_matched_once(spark, tmp_path):
    path, rule = f"file://{tmp_path}", M.Rule("r", (M.Condition("k", required=True), M.Condition("s", "numeric", threshold=2.0)))
    rows = spark.range(600).select("id", F.lit("k").alias("k"), (F.col("id") % 2).cast("string").alias("s"))
    I.extend_matches(spark, path, rows, [rule], buckets=2)
    assert spark.read.parquet(f"{path}/pairs").count() == 3  # two classes, each with itself and with the other
    I.extend_matches(spark, path, rows.where("id < 10").withColumn("k", F.lit("gone")), [rule], deleted=rows.where("id >= 595").select("id"), buckets=2)
    I.extend_matches(spark, path, rows.where("id < 4"), [rule], buckets=2)
    live = [i for i in range(595) if not 4 <= i < 10]
    want = sorted((a, b) for n in (live, range(4, 10)) for a in n for b in n if a < b)
    assert sorted((r.a, r.b) for r in I.current_pairs(spark, path, chunk=50).select("a", "b").collect()) == want
