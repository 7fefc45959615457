import json
import random

from pyspark.sql import functions as F

from weftline.operators import relations
from weftline.operators.ranges import cover, stabbed


def test_cover_is_exact(spark):
    cases = [(a, b) for a in range(0, 20) for b in range(a - 1, 22)] + [(0, 1 << 20), (5, (1 << 33) + 7)]
    df = spark.createDataFrame(cases, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        spans = sorted((x.node << x.level, (x.node + 1) << x.level) for x in r.n)
        assert len(r.n) <= 2 * 40 and sum(b - a for a, b in spans) == max(0, r.b - r.a + 1)
        assert all(p[1] == q[0] for p, q in zip(spans, spans[1:])) and (not spans or spans[0][0] == r.a)


def test_stabbed_equals_brute_force(spark):
    rnd = random.Random(4)
    number = lambda: rnd.choice([float(rnd.randrange(-5, 30)), rnd.uniform(-5, 30)])
    rules = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, number(), number()]), rnd.random() < 0.5, rnd.choice([None, number(), number()]), rnd.random() < 0.5) for i in range(150)]
    rules += [("only", 900, None, False, None, False), ("a", 901, 3.0, False, 3.0, False), ("a", 902, 3.0, True, 3.0, False), ("a", 903, 9.0, False, 2.0, False)]
    values = [(rnd.choice(["a", "b", None, "only", "none"]), number(), i) for i in range(400)] + [("a", 3.0, 1000 + i) for i in range(200)] + [("a", None, 2000), ("a", float("inf"), 2001), ("a", float("-inf"), 2002)]
    r = spark.createDataFrame(rules, "s string, rule int, lo double, lo_open boolean, hi double, hi_open boolean").repartition(3)
    v = spark.createDataFrame(values, "s string, x double, id int").repartition(3)
    got = sorted((x.rule, x.id) for x in stabbed(r, v, ["s"]).collect())
    inside = lambda x, lo, lo_open, hi, hi_open: (lo is None or x > lo or (x == lo and not lo_open)) and (hi is None or x < hi or (x == hi and not hi_open))
    want = sorted((rule, i) for s, rule, *b in rules for t, x, i in values if s == t and x is not None and inside(x, *b))
    assert got == want
    assert stabbed(r.limit(0), v, ["s"]).count() == stabbed(r, v.limit(0), ["s"]).count() == 0


def test_range_rules_agree_with_compiled_ones(spark):
    rnd = random.Random(7)
    bodies = [{"n": rnd.choice([rnd.randrange(40), round(rnd.uniform(0, 40), 2), "12", "x", None]), "m": {"k": rnd.randrange(9)}, "t": rnd.choice(["u", "w"])} for _ in range(200)]
    ent = spark.createDataFrame([("t", "k", "i", str(n), json.dumps(b)) for n, b in enumerate(bodies)], "tenant_id string, entity_type string, integration string, entity_id string, data string")
    wanted = [{"n": {"$gt": a, "$lte": a + w}} for a in range(0, 40, 3) for w in (0, 1, 7.5)] + [{"n": {"$lt": 6}, "m.k": {"$gte": 2, "$lt": 4}}, {"m.k": {"$gte": 7}}, {"n": {"$gt": "7", "$gte": 7}}, {"n": {"$lt": "no"}}, {"n": {"$gt": 5}, "t": "u"}, {"n": {"$lte": 9, "$ne": 5}}, {"t": {"$ne": "u"}}, {"n": 12.0}, {"n": {"$in": [3.0, "12"]}}]
    rules = [{"id": str(i), "tenant_id": "t", "relationship_type": "r", "from_entity_id": "z", "to_entity_type": "k", "criteria": c} for i, c in enumerate(wanted)]
    table = spark.createDataFrame([(c["id"], "t", "r", "z", "k", None, json.dumps(c["criteria"])) for c in rules], "criteria_id string, tenant_id string, relationship_type string, from_entity_id string, to_entity_type string, to_integration string, criteria string")
    got, want = (sorted((r.criteria_id, r.to_entity_id) for r in df.collect()) for df in (relations.stored_criteria_edges(table, ent), relations.criteria_edges(rules, ent)))
    assert got == want and len(got) > 500


def test_numbers_are_equal_by_value(spark):
    ent = spark.createDataFrame([("t", "k", "i", str(n), d) for n, d in enumerate(['{"n":5}', '{"n":5.0}', '{"n":"5"}', '{"n":5e0}', '{"n":"five"}', '{"n":-0.0}', '{"n":0}', '{"l":[1.0,"a"]}'])], "tenant_id string, entity_type string, integration string, entity_id string, data string")
    cases = [({"n": 5}, "0123"), ({"n": {"$eq": 5.0}}, "0123"), ({"n": {"$in": [5.0, "five"]}}, "01234"), ({"n": {"$ne": 5.0}}, "4567"), ({"n": 0}, "56"), ({"l": {"$contains": 1}}, "7")]
    for criteria, want in cases:
        rule = {"id": "c", "tenant_id": "t", "relationship_type": "r", "from_entity_id": "z", "to_entity_type": "k", "criteria": criteria}
        table = spark.createDataFrame([("c", "t", "r", "z", "k", None, json.dumps(criteria))], "criteria_id string, tenant_id string, relationship_type string, from_entity_id string, to_entity_type string, to_integration string, criteria string")
        for df in (relations.stored_criteria_edges(table, ent), relations.criteria_edges([rule], ent)):
            assert "".join(sorted(r.to_entity_id for r in df.collect())) == want, criteria


def test_counts_of_stored_criteria_equal_their_edges(spark):
    rnd = random.Random(9)
    bodies = [{"n": rnd.choice([rnd.randrange(12), 3.5, "7", "x", None]), "m": {"k": rnd.randrange(4)}, "t": rnd.choice(["u", "w"])} for _ in range(60)]
    ent = [("t", rnd.choice(["k", "k", "z", None]), rnd.choice(["i", "j", None]), str(n % 50), json.dumps(b)) for n, b in enumerate(bodies)] + [("t", "k", "i", "50", None)]
    wanted = [{"n": {"$gt": 2, "$lte": 9}}, {"n": {"$gt": 2, "$lte": 9}, "m.k": {"$gte": 2}}, {"n": {"$gte": 3}}, {"n": {"$lt": 8, "$ne": 5}, "t": {"$ne": "u"}}, {"t": "u", "n": {"$gt": 1}}, {"n": {"$in": [3, "7"]}}, {"t": {"$exists": True}}, {}, {"n": {"$lt": "no"}}]
    rules = [(str(i), "t", "r", rnd.choice(["z", "3", "7", None]), rnd.choice(["k", "k", "z"]), rnd.choice([None, None, "i"]), json.dumps(rnd.choice(wanted))) for i in range(150)]
    e = spark.createDataFrame(ent, "tenant_id string, entity_type string, integration string, entity_id string, data string")
    r = spark.createDataFrame(rules, "criteria_id string, tenant_id string, relationship_type string, from_entity_id string, to_entity_type string, to_integration string, criteria string")
    want = {x.to_entity_id: x.n for x in relations.stored_criteria_edges(r, e).groupBy("to_entity_id").agg(F.count("*").alias("n")).collect()}
    got = relations.stored_criteria_counts(r, e)
    assert {x.to_entity_id: x.n for x in got.collect()} == want and len(want) > 30
    assert relations.stored_criteria_counts(r.limit(0), e).isEmpty() and relations.stored_criteria_counts(r, e.limit(0)).isEmpty()
