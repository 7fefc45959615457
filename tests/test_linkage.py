import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import similarity as S
from weftline.functions.normalize import address, normalize
from weftline.operators import matching as M
from weftline.operators import merging as G
from weftline.operators import relations
from weftline.streaming.pipeline import completion_batches

WORDS = [("Steven", "S315"), ("Stephen", "S315"), ("Ashcraft", "A226"), ("Pfister", "P236"), ("Tymczak", "T522"), ("Lee", "L000"), ("Robert", "R163"), ("Jackson", "J250"), ("Honeyman", "H555")]


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def slow_trigrams(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        else:
            words += [word] if word else []
            word = ""
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def slow_similarity(a, b):
    x, y = slow_trigrams(a), slow_trigrams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_soundex_and_normalizers(spark):
    assert column(spark, [w for w, _ in WORDS], S.soundex) == [t for _, t in WORDS]
    assert column(spark, ["", None], S.soundex) == ["", None]
    assert column(spark, ["John  Smith Jr.", "Ann O'Neil PhD", "Max"], lambda c: normalize(c, "nname")) == ["john smith", "ann oneil", "max"]
    assert column(spark, ["+1 (555) 01-02"], lambda c: normalize(c, "nphone")) == ["15550102"]
    assert column(spark, [" A@B.c "], lambda c: normalize(c, "nemail")) == ["a@b.c"] and column(spark, [" x "], lambda c: normalize(c, "nope")) == [" x "]
    assert column(spark, ["12 North Main Street."], address) == ["12 n main st"]


def test_trigram_similarity(spark):
    pairs = [("word", "two words"), ("same", "same"), ("", ""), ("Ab c", "ab-C"), ("é1", "e1")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(S.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([slow_similarity(a, b) for a, b in pairs]) and round(got[0], 6) == 0.363636


def test_jaro_levenshtein_and_metaphone(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", "a"), ("a", "a"), (None, "a")], "a string, b string")
    r = df.select(S.jaro(F.col("a"), F.col("b")).alias("j"), S.jaro_winkler(F.col("a"), F.col("b")).alias("w"), S.levenshtein_similarity(F.col("a"), F.col("b")).alias("l")).collect()
    assert [round(x.j, 4) for x in r[:4]] == [0.9444, 0.7667, 0.0, 1.0] and round(r[0].w, 4) == 0.9611 and round(r[1].w, 4) == 0.8133 and r[4].j is None
    assert round(r[0].l, 4) == round(1 - 2 / 6, 4)
    assert column(spark, ["Knight", "Philip", "Filip"], S.metaphone)[1:] == ["FLP", "FLP"]


def slow_jaro(a, b):
    if a == b or not a or not b:
        return float(a == b)
    reach, taken, first = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == x:
                taken.add(j)
                first.append(x)
                break
    if not first:
        return 0.0
    m, half = len(first), sum(x != b[j] for x, j in zip(first, sorted(taken), strict=True))
    return (m / len(a) + m / len(b) + (m - half / 2) / m) / 3


def test_jaro_equals_a_plain_loop_without_python(spark, capsys):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcé") for _ in range(n))
    pairs = [(text(rnd.randrange(12)), text(rnd.randrange(12))) for _ in range(150)] + [(text(90), text(150)) for _ in range(10)]
    pairs += [(p[0], p[0][1:] + p[0][:1]) for p in pairs[-10:]]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.jaro(F.col("a"), F.col("b")).alias("j"), S.jaro_winkler(F.col("a"), F.col("b")).alias("w"))
    df.explain()
    assert "Python" not in capsys.readouterr().out
    for r in df.collect():
        a, b = r.a.encode(), r.b.encode()
        same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 4)
        assert abs(r.j - slow_jaro(a, b)) < 1e-12 and abs(r.w - (r.j + same * 0.1 * (1 - r.j))) < 1e-12


def people(n=120, seed=2):
    rnd = random.Random(seed)
    names = ["".join(rnd.choice(["an", "be", "ro", "li", "ka", "st"]) for _ in range(rnd.randrange(2, 5))) for _ in range(25)]
    return [(i, rnd.choice(names) + rnd.choice(["", "", "x"]), rnd.choice(["a@x.y", "b@x.y", "c@x.y", None]), rnd.choice(["1", "2", "3"])) for i in range(n)]


def test_trigram_join_equals_brute_force(spark):
    values = sorted({p[1] for p in people(300)} | {"", "??"})
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for t in (0.4, 0.7, 1.0):
        got = {(r.a, r.b) for r in M.trigram_pairs(df, t).collect()}
        assert got == {(a, b) for a in values for b in values if a < b and slow_similarity(a, b) >= t and slow_trigrams(a)}


def test_rules_equal_brute_force(spark):
    rows = people()
    C = M.Condition
    rules = [
        M.Rule("mail", (C("email", required=True), C("name", "fuzzy", 2.0, threshold=0.5)), priority=2),
        M.Rule("name", (C("name", "fuzzy", 1.0, True, 0.6),), priority=1, score_weight=0.9),
        M.Rule("veto", (C("code", no_merge=True, invert=True), C("email")), is_active=True),
    ]
    df = spark.createDataFrame(rows, "id long, name string, email string, code string")
    index = M.build_index(df, rules)
    got = {(r.a, r.b): (round(r.score, 9), r.rule, r.blocked) for r in M.score_pairs(M.candidates(index, rules), index, rules).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] >= b[0]:
                continue
            mail, sim = a[2] is not None and a[2] == b[2], slow_similarity(a[1], b[1])
            if not (mail or sim >= 0.6):
                continue
            scores = [((1 + 2 * sim * (sim >= 0.5)) / 3 if mail else -1, 2, "mail"), (sim * 0.9 if sim >= 0.6 else -1, 1, "name"), (1.0 if mail else 0.0, 0, "veto")]
            s, _, rule = max(scores)
            blocked = a[3] != b[3]
            if s >= 0.5 or blocked:
                want[a[0], b[0]] = (round(max(s, 0), 9), rule, blocked)
    assert got == want


def test_find_matches_caps_by_score(spark):
    df = spark.createDataFrame(people(60), "id long, name string, email string, code string")
    got = M.find_matches(df, [M.Rule("mail", (M.Condition("email"),))], top=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r.candidate)
    assert max(map(len, by.values())) == 3 and all(sorted(v) == v for v in by.values())
    assert M.find_matches(df, []).collect() == []


def test_candidate_states(spark):
    pairs = spark.createDataFrame([(2, 1, 0.96, False, True), (1, 2, 0.6, False, False), (3, 4, 0.7, False, False), (5, 6, 0.9, True, False)], "a long, b long, score double, blocked boolean, auto_merge boolean")
    table = M.candidate_table(pairs)
    assert sorted((r.entity_a, r.entity_b, r.score, r.status) for r in table.collect()) == [(1, 2, 0.96, "auto_merged"), (3, 4, 0.7, "pending")]
    d = spark.createDataFrame([(4, 3, "deferred", 1), (3, 4, "approved", 2), (1, 2, "rejected", 1)], "entity_a long, entity_b long, decision string, ts int")
    after = M.decide(table, d)
    assert sorted(r.status for r in after.collect()) == ["approved", "auto_merged"] and M.review_queue(after).collect() == []


def test_merge_strategies(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, 9, t0, "a", "x", 1.0, ["p"]), (2, 9, t0 + timedelta(1), "b", "", 3.0, ["q", "p"]), (3, 9, t0 + timedelta(2), "c", "long one", None, None), (4, 8, t0, "a", None, None, None)]
    df = spark.createDataFrame(rows, "id long, cluster_id long, updated_at timestamp, integration string, name string, n double, tags array<string>")
    want = {"most_recent": "long one", "last": "long one", "first": "x", "most_trusted": "", "source_priority": "", "longest": "long one", "shortest": "x", "prefer_non_empty": "x", "no such": "x", "max": None}
    for s, v in want.items():
        got = {r.cluster_id: r.name for r in G.golden_records(df, [G.FieldRule("name", s)], priorities={"b": 5, "a": 1}).collect()}
        assert got == {9: v, 8: None}, s
    for s, v in {"max": 3.0, "min": 1.0, "sum": 4.0, "average": 2.0}.items():
        got = {r.cluster_id: r.n for r in G.golden_records(df, [G.FieldRule("n", s)]).collect()}
        assert got == {9: v, 8: 0.0 if s == "sum" else None}
    tags = {r.cluster_id: r.tags for r in G.golden_records(df, [G.FieldRule("tags", "collect_all")]).collect()}
    assert tags == {9: ["p", "q"], 8: []}
    assert G.golden_records(df, [G.FieldRule("tags", "collect_all", 2, False)]).where("cluster_id = 9").first().tags == ["p", "q"]
    c = G.conflicts(df, [G.FieldRule("name", "most_recent"), G.FieldRule("n", "max")]).collect()
    assert sorted((r.field, r.values, r.integrations, r.resolved_value) for r in c) == [("n", ["1.0", "3.0"], ["a", "b"], "3.0"), ("name", ["x", "", "long one"], ["a", "b", "c"], "long one")]


def test_clusters_and_events(spark):
    rec = spark.createDataFrame([(i, i) for i in range(1, 8)], "id long, created_at long")
    m = spark.createDataFrame([(1, 2, 0.9, False), (2, 3, 0.9, False), (4, 5, 0.4, False), (5, 6, 0.9, True), (6, 7, 0.5, False)], "a long, b long, score double, blocked boolean")
    members = G.cluster_records(rec, m)
    assert {r.id: r.cluster_id for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    assert {r.cluster_id: r.survivor for r in G.survivors(members).collect()} == {1: 1, 4: 4, 5: 5, 6: 6}
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cluster_id long, fingerprint string"), spark.createDataFrame([(1, "a"), (2, "z"), (4, "d")], "cluster_id long, fingerprint string")
    assert {r.cluster_id: r.event_type for r in G.golden_events(old, new).collect()} == {2: "entity.updated", 3: "entity.deleted", 4: "entity.created"}


def test_consolidation_moves_members_edges_and_versions(spark):
    members = spark.createDataFrame([(1, 10, 100), (2, 20, 100), (3, None, 100), (4, 30, 200), (5, None, 300)], "id long, golden_id long, cluster_id long")
    golden = spark.createDataFrame([(10, 5, 1), (20, 3, 4), (30, 1, 2)], "golden_id long, created_at int, version int")
    edges = spark.createDataFrame([("r", 10, 20), ("r", 10, 30), ("r", 20, 30), ("r", 10, 10)], "type string, from_id long, to_id long")
    m, g, e = G.consolidate(members, golden, edges)
    assert sorted((r.id, r.golden_id) for r in m.collect()) == [(1, 20), (2, 20), (3, 20), (4, 30), (5, 300)]
    assert sorted((r.golden_id, r.version, r.merged_into) for r in g.collect()) == [(10, 1, 20), (20, 5, None), (30, 2, None)]
    assert sorted((r.from_id, r.to_id) for r in e.collect()) == [(20, 20), (20, 30)]


def test_consolidation_of_nothing(spark):
    members = spark.createDataFrame([], "id long, golden_id long, cluster_id long")
    golden = spark.createDataFrame([(1, 1, 1)], "golden_id long, created_at int, version int")
    edges = spark.createDataFrame([], "type string, from_id long, to_id long")
    m, g, e = G.consolidate(members, golden, edges)
    assert m.isEmpty() and e.isEmpty() and [tuple(r) for r in g.collect()] == [(1, 1, 1, None)]


def test_stored_criteria_agree_with_compiled_ones(spark):
    rows = [("a", '{"n": 5, "s": "x", "tags": ["p", "q"], "o": {"k": true}}'), ("b", '{"n": "5", "s": null}'), ("c", '{"n": 7.5, "s": "xyz", "tags": []}'), ("d", "{}"), ("e", None)]
    ent = spark.createDataFrame([("t", "k", "i", *r) for r in rows], "tenant_id string, entity_type string, integration string, entity_id string, data string")
    wanted = [
        {"n": 5}, {"s": None}, {"n": {"$gt": 5}}, {"n": {"$gte": 5, "$lt": 7.5}}, {"tags": {"$contains": "q"}}, {"s": {"$contains": "y"}}, {"o.k": True}, {"n": {"$in": [5, "8"]}}, {"s": {"$ne": "x"}},
        {"tags": {"$exists": False}}, {"n": {"$odd": 1}}, {}, {"n": {"$in": []}},
    ]
    given = [{"id": str(i), "tenant_id": "t", "relationship_type": "r", "from_entity_id": "w", "to_entity_type": "k", "criteria": c} for i, c in enumerate(wanted)]
    table = spark.createDataFrame([(c["id"], "t", "r", "w", "k", None, json.dumps(c["criteria"])) for c in given], "criteria_id string, tenant_id string, relationship_type string, from_entity_id string, to_entity_type string, to_integration string, criteria string")
    got, want = (sorted((r.criteria_id, r.to_entity_id) for r in df.collect()) for df in (relations.stored_criteria_edges(table, ent), relations.criteria_edges(given, ent)))
    assert got == want and len(got) > 10


def test_completions_delete_what_the_run_did_not_send(spark, tmp_path):
    records = spark.createDataFrame([(1, "s", "r1", 1), (2, "s", "r2", 2), (3, "s", "r3", 9), (4, "s", None, 1), (5, "z", "r1", 1)], "id long, source_key string, execution_id string, updated_at int")
    events = spark.createDataFrame([("s", "execution.completed", "r1", 2), ("s", "execution.completed", "r2", 5), ("s", "execution.failed", "r3", 6)], "source_key string, type string, execution_id string, ts int")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = completion_batches(lambda: records, str(tmp_path / "out"), ["id"], ["source_key"])
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run(events, 0)  # replayed
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()] == [1]
