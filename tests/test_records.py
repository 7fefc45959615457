import hashlib
import json
import random

from pyspark.sql import functions as F

from weftline.functions import criteria as C
from weftline.functions.validation import validation_errors
from weftline.operators import deletion, graph, relations, routing, scheduling, staging


def test_criteria(spark):
    rows = [{"a": 5, "b": {"c": "x"}, "t": ["p", "q"]}, {"a": "5", "n": None}, {"a": 7.5, "b": {"c": "y"}}, {}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, d string")
    hit = lambda c: [r.i for r in df.where(C.matches(F.col("d"), c)).orderBy("i").collect()]
    assert hit({}) == [0, 1, 2, 3] and hit({"a": 5}) == [0, 1] and hit({"a": "5"}) == [0, 1]
    assert hit({"b.c": "x"}) == [0] and hit({"a": {"$gte": 5, "$lt": "7"}}) == [0, 1] and hit({"a": {"$in": [7.5, 9]}}) == [2]
    assert hit({"b.c": {"$ne": "x"}}) == [1, 2, 3] and hit({"b": {"$exists": False}}) == [1, 3] and hit({"t": {"$contains": "q"}}) == [0]
    assert hit({"a": {"$regex": "5"}}) == [] and hit({"n": None}) == [0, 1, 2, 3]
    assert C.split({"a": 1, "b.c": 2, "d": {"$gt": 1}}) == ({"a": 1}, {"b.c": 2, "d": {"$gt": 1}})
    assert C.criteria_hash({"b": 1, "a": 2}) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()


def test_schema_validation(spark):
    schema = {"required": ["name", "age"], "properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "mail": {"type": "string", "format": "email"}, "tags": {"type": "array", "items": {"type": "string", "format": "date"}}, "home": {"type": "object", "required": ["zip"], "properties": {"zip": {"type": "string"}}}}}
    cases = [
        ({"name": "a", "age": 3, "mail": "a@b.co", "extra": 1, "tags": ["2024-01-01"], "home": {"zip": "1"}}, []),
        ({"age": 3.0}, ["name"]),
        ({"name": 5, "age": 3.5, "mail": "nope"}, ["age", "mail", "name"]),
        ({"name": "a", "age": None}, []),
        ({"name": "a", "age": 1, "tags": ["2024-01-01", "x"], "home": {}}, ["home.zip", "tags[1]"]),
        ({"name": "a", "age": 1, "tags": "no", "home": 3}, ["home", "tags"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "i int, d string")
    got = df.select("i", validation_errors(F.col("d"), schema).alias("e")).orderBy("i").collect()
    assert [sorted(x.field for x in r.e) for r in got] == [w for _, w in cases]


def test_upsert_merges_resurrects_and_continues(spark):
    rows = [("k", 1, '{"email":"e","name":{"first":"A","last":"B"}}'), ("k", 2, '{"phone":"1","name":{"middle":"M"},"n":3}'), ("z", 1, None), ("z", 2, "{}")]
    df = spark.createDataFrame(rows, "id string, o int, data string")
    got = {r.id: json.loads(r.data) for r in staging.upsert(df, ["id"], ["o"]).collect()}
    assert got == {"k": {"email": "e", "name": {"middle": "M"}, "phone": "1", "n": 3}, "z": {}}
    current = staging.upsert(df, ["id"], ["o"]).select("id", "data")
    more = spark.createDataFrame([("k", 3, '{"phone":"2"}'), ("new", 3, '{"a":1}')], "id string, o int, data string")
    got = {r.id: json.loads(r.data) for r in staging.upsert(more, ["id"], ["o"], current=current).collect()}
    assert got["k"]["phone"] == "2" and got["k"]["email"] == "e" and got["new"] == {"a": 1} and got["z"] == {}


def test_fingerprints(spark):
    a, b = '{"b":1,"a":{"x":[1,2],"t":"<&>"}}', '{ "a": {"t":"<&>","x":[1.0,2]}, "b":1 }'
    assert staging.canonical_json(a) == staging.canonical_json(b) == '{"a":{"t":"\\u003c\\u0026\\u003e","x":[1,2]},"b":1}'
    assert staging.canonical_json(a, ("a.t", "b")) == '{"a":{"x":[1,2]}}' and staging.canonical_json(None) is None
    df = spark.createDataFrame([(a,), (b,), (None,)], "d string")
    x = [r.f for r in df.select(staging.fingerprint(F.col("d")).alias("f")).collect()]
    assert x[0] == x[1] == hashlib.sha256(staging.canonical_json(a).encode()).hexdigest() and x[2] is None


def test_fingerprints_equal_the_plain_form_without_python(spark, capsys):
    rnd = random.Random(1)
    leaves = [0, -5, 12345678901234567890, 1.5, 0.1, 1e-7, 123456.789, 1e22, -2.5e-9, 1.0, 2.5e20, 1.7976931348623157e308, "a", "<b>&", "é\u2028", 'q"\\', "\n\t\x01", "1.50", "[1]", "", None, True]

    def value(depth=0):
        kind = rnd.randrange(6 if depth < 3 else 4)
        if kind < 4:
            return rnd.choice(leaves)
        return [value(depth + 1) for _ in range(rnd.randrange(4))] if kind == 4 else {rnd.choice(["a", "b", "x.y", "é", "A", "<"]): value(depth + 1) for _ in range(rnd.randrange(4))}

    docs = [json.dumps({"a": value(), "b": value(), "c": {"d": value(), "e": value()}}, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])) for _ in range(80)]
    docs += ["not json", "[1,2.0]", '"x"', "7.0", '{"a":-0,"b":-0.0,"c":1E2}', "", '{"c":{"d":[[{"a":1,"b":2}]],"e":[{"b":1},{"a":{"b":1}}]}}']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    for exclude in ((), ("a",), ("c.d.b", "c.e.b", "b")):
        got = df.select("d", staging.canonical(F.col("d"), exclude).alias("c"))
        got.explain()
        assert "Python" not in capsys.readouterr().out
        for r in got.collect():
            assert r.c == staging.canonical_json(r.d, exclude)


def test_relationship_messages(spark):
    rows = [({"_relationship_type": "owns", "_from_entity_type": "p", "_from_source_id": "1", "_to_entity_type": "d", "_to_source_id": "2", "since": "x"},), ({"_from_entity_type": "p"},)]
    df = spark.createDataFrame(rows, "m map<string,string>")
    cols = relations.parse_relationship(F.col("m"), F.lit(None).cast("string"), F.lit("crm"))
    got = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert got[0].valid and not got[1].valid and got[0].properties == {"since": "x"} and got[0].to_integration == "crm"
    m = spark.createDataFrame([("t", "p", "1", "crm", [("owns", "d", "7"), ("owns", "d", "8")])], "tenant_id string, entity_type string, source_id string, integration string, relationships array<struct<type:string,to_entity_type:string,to_source_id:string>>")
    edges = relations.stage(relations.embedded_relationships(m).unionByName(relations.embedded_relationships(m)))
    assert edges.count() == 2
    ent = spark.createDataFrame([("t", "p", "1", "crm", "E1"), ("t", "d", "7", "crm", "E7"), ("t", "d", "8", "other", "E8")], "tenant_id string, entity_type string, source_id string, integration string, entity_id string")
    done = relations.resolve_ends(edges, ent)
    assert relations.pending(done).count() == 1 and relations.pending(relations.resolve_ends(edges, ent, scope=False)).count() == 0


def test_properties_of_relationships(spark):
    schema = "tenant_id string, entity_type string, source_id string, integration string, relationships array<struct<type:string,to_entity_type:string,to_source_id:string,data:map<string,string>>>"
    m = spark.createDataFrame([("t", "p", "1", "crm", [("owns", "d", "7", {"a": "1", "b": "x"}), ("owns", "d", "7", {"a": "2", "c": None}), ("owns", "d", "8", None)])], schema)
    edges = relations.stage(relations.embedded_relationships(m))
    got = {r.to_source_id: r for r in edges.collect()}
    assert got["7"].properties == {"a": "2", "b": "x"} and got["8"].properties == {}
    ends = edges.select("id", "relationship_type", "properties", F.lit("E1").alias("from_entity_id"), F.concat(F.lit("E"), "to_source_id").alias("to_entity_id"))
    member = spark.createDataFrame([("E1", 1), ("E7", 2), ("E8", 2)], "entity_id string, cluster_id int")
    golden = relations.golden_edges(ends, member).collect()
    assert [(r.source_count, r.properties) for r in golden] == [(2, {"a": "2", "b": "x"})]


def test_deletion(spark):
    df = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None)], "id long, execution_id string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(deletion.not_seen(df, "r1")) == [2] and ids(deletion.not_seen(df, "r1", null_counts=True)) == [2, 3] and ids(deletion.not_seen(df, "r1", "failed")) == []
    m = spark.createDataFrame([("delete", 2), ("upsert", 1)], "action string, id long")
    assert ids(deletion.apply_deletes(df, m, ["id"])) == [1, 3]
    now = F.lit("2024-03-01").cast("timestamp")
    old = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "2024-02-20", "a"), (3, "2024-01-01", "b"), (4, None, "b")], "id long, u string, integration string").select("id", F.col("u").cast("timestamp").alias("updated_at"), F.col("u").cast("timestamp").alias("created_at"), "integration")
    rule = lambda k, **c: {"strategy_type": k, "config": c}
    p = lambda s: ids(old.where(deletion.policy_predicate(s, now)))
    assert p(rule("staleness", max_age_days=30)) == [1, 3] and p(rule("staleness", max_age_days=30, integration="b")) == [3] and p(rule("explicit")) == []
    assert p(rule("composite", operator="AND", strategies=[rule("staleness", max_age_days=30), rule("retention", max_age_days=90)])) == []


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "d", "u"), ("x", "y", "t")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "id string")
    near = lambda k: sorted(r.node for r in graph.neighbours(e, start, k).collect())
    assert near(1) == ["b", "c"] and near(2) == ["b", "c", "d"] and near(3) == ["a", "b", "c", "d"]
    want = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "y")], "src string, dst string")
    got = {r.dst: (r.hops, r.path) for r in graph.shortest_paths(e, want, 5).collect()}
    assert got == {"d": (2, ["a", "c", "d"]), "a": (0, ["a"])}
    assert sorted(r.other for r in graph.relationships_of(e, start, "out").collect()) == ["b"]
    v = spark.createDataFrame([("a", 1, "old", False), ("b", 1, "x", False)], "id string, ts int, p string, deleted boolean")
    ch = spark.createDataFrame([("a", 2, "new", False), ("b", 2, None, True)], "id string, ts int, p string, deleted boolean")
    assert [(r.id, r.p) for r in graph.merge_nodes(v, ch).collect()] == [("a", "new")]


def test_validation_of_items_and_phones(spark):
    text, number = {"type": "array", "items": {"type": "string"}}, {"type": "array", "items": {"type": "number"}}
    schema = {"required": ["id", "other"], "properties": {"s": text, "n": number, "p": {"type": "string", "format": "phone"}, "id": {"type": "integer"}, "deep": {"type": "array", "items": {"type": "object", "properties": {"d": {"format": "date"}, "in": number}}}}}
    cases = [
        ({"id": 1, "other": None, "s": ["a", None], "n": [1, 2.5, None], "p": "abcdefgh"}, []),
        ({"id": None, "other": 1, "s": [1, "2"], "n": ["5", 6]}, ["n[0]", "s[0]"]),
        ({"other": [], "p": "(12) 34-5"}, ["id", "p"]),
        ({"id": 1, "other": 1, "p": "+1 (555) 123-4567"}, []),
        ({"id": 1, "other": 1, "deep": [{"d": "2024-01-01", "in": [1]}, {"d": "x", "in": ["y"]}, 3]}, ["deep[1].d", "deep[1].in[0]", "deep[2]"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "i int, d string")
    got = df.select("i", validation_errors(F.col("d"), schema).alias("e")).orderBy("i").collect()
    assert [sorted(x.field for x in r.e) for r in got] == [w for _, w in cases]


def test_scheduling(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 9)], "k int")
    delays = lambda kind: [r.d for r in df.orderBy("k").select(scheduling.backoff_seconds(F.col("k"), kind).alias("d")).collect()]
    assert delays("fibonacci") == [1, 1, 2, 3, 5, 8, 13, 21] and delays("exponential")[:7] == [1, 2, 4, 8, 16, 32, 60] and delays("linear")[7] == 8
    p = scheduling.page(df, [F.col("k")], 2, 3).collect()
    assert [(r.k, r.total_count) for r in p] == [(4, 8), (5, 8), (6, 8)]


def test_page_batches_of_json(spark):
    df = spark.createDataFrame([("root", "[1,[2,3],{\"a\":4}]"), ("d", "[[[1,2],[3]],[[[\"x\", [null]]]], 7]"), ("n", None), ("r", "{\"b\":1}"), ("e", "[]")], "step_path string, response_body string")
    got = {(r.step_path, r.response_body) for r in routing.explode_pages(df).collect()}
    assert got == {("root[0]", "1"), ("root[1][0]", "2"), ("root[1][1]", "3"), ("root[2]", '{"a":4}'), ("r", '{"b":1}'), ("n", None), ("d[0][0][0]", "1"), ("d[0][0][1]", "2"), ("d[0][1][0]", "3"), ("d[1][0][0][0]", "x"), ("d[1][0][0][1][0]", "null"), ("d[2]", "7")}


def test_page_batches_keep_what_is_written(spark):
    rows = [("a", '[[[1e400]], 1.50, -0, {"n": 1.0, "s": "1.5 [2]", "q\\"[": [1E5]}, "[x]", "[1]", " 7 ", true, null]'), ("b", '[{"a":1,"a":2},[[[3]]]]'), ("c", '{"x": 1.50}'), ("d", "[1, [2"), ("e", None)]
    df = spark.createDataFrame(rows, "step_path string, response_body string")
    got = {(r.step_path, r.response_body) for r in routing.explode_pages(df).collect()}
    want = {("a[0][0][0]", "1e400"), ("a[1]", "1.50"), ("a[2]", "-0"), ("a[3]", '{"n":1.0,"s":"1.5 [2]","q\\"[":[1E5]}'), ("a[4]", "[x]"), ("a[5]", "[1]"), ("a[6]", " 7 "), ("a[7]", "true"), ("a[8]", "null")}
    assert got == want | {("b[0]", '{"a":1,"a":2}'), ("b[1][0][0][0]", "3"), ("c", '{"x": 1.50}'), ("e", None)}


def test_the_first_binding_is_of_the_row(spark):
    live = "id string, ord int, is_enabled boolean, tenant_id string, mapping_id string, output_topic string, filter struct<integration:string, keys:array<string>, status_codes:array<int>, step_path_prefix:string, request_url_contains:string, min_status_code:int, max_status_code:int>"
    b = [(i, o, True, "t", "m" + i, "o", ("x", k, [], "", "", 0, 0)) for i, o, k in (("b1", 2, []), ("b2", 1, []), ("b3", 3, ["k"]))]
    m = [(None, "t", "x", "k"), (None, "t", "x", "z"), (1, "t", "x", "k"), (1, "t", "x", "z"), (2, "t", "y", "k"), (3, "u", "x", "k"), (4, None, "x", "k")]
    msgs = spark.createDataFrame([(*r, 200, "p", "u") for r in m], "message_id int, tenant_id string, integration string, plan_key string, status_code int, step_path string, request_url string")
    got = sorted((str(r.message_id), r.plan_key, r.binding_id, r.mapping_id, r.score) for r in routing.match_bindings(msgs, spark.createDataFrame(b, live), first=True).collect())
    assert got == [("1", "k", "b3", "mb3", 11), ("1", "z", "b2", "mb2", 1), ("None", "k", "b3", "mb3", 11), ("None", "z", "b2", "mb2", 1)]


def test_deletes_and_records_go_by_time(spark):
    rec = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, None), (5, 5), (6, 5)], "id int, updated_at int")
    msg = spark.createDataFrame([(1, "delete", 4), (2, "delete", 5), (3, "delete", 6), (3, "delete", 1), (4, "delete", 1), (5, "delete", None), (6, "upsert", 9)], "id int, action string, ts int")
    marked = {r.id: r.deleted_at for r in deletion.mark_deleted(rec, msg, ["id"]).collect()}
    assert marked == {1: None, 2: 5, 3: 6, 4: 1, 5: 5, 6: None}
    assert sorted(r.id for r in deletion.apply_deletes(rec, msg, ["id"], "updated_at", "ts").collect()) == [1, 6]
    assert sorted(r.id for r in deletion.apply_deletes(rec, msg, ["id"]).collect()) == [6]


def test_lifecycle_split(spark):
    df = spark.createDataFrame([("execution.started",), (None,), ("response",)], "type string")
    a, b = routing.split_lifecycle(df)
    assert a.count() == 1 and b.count() == 2


def test_dead_letters_by_stage_and_replay(spark):
    from weftline.operators.routing import dead_letters, replay_dead_letters

    df = spark.createDataFrame([(1, "x", None, 1), (2, "x", "y", None), (3, None, "y", 3), (4, None, None, 1)], "id int, a string, b string, attempts int")
    good, dead = dead_letters(df, {"load_mapping": F.col("a"), "publish_output": F.col("b")})
    assert [r.id for r in good.collect()] == [4] and good.columns == df.columns
    assert sorted((r.id, r.error_stage, r.error) for r in dead.collect()) == [(1, "load_mapping", "x"), (2, "load_mapping", "x"), (3, "publish_output", "y")]
    again, exhausted = replay_dead_letters(dead)
    assert sorted((r.id, r.attempts) for r in again.collect()) == [(1, 2), (2, 2)] and again.columns == df.columns
    assert [(r.id, r.error_stage) for r in exhausted.collect()] == [(3, "publish_output")]
    assert {r.attempts for r in replay_dead_letters(dead.drop("attempts"))[0].collect()} == {2}


def test_graph_batches_keep_event_order_and_replay(spark, tmp_path):
    from weftline.streaming.pipeline import graph_batches, graph_rows

    rows = lambda x: spark.createDataFrame(x, "id int, ts int, p string, deleted boolean")
    run = graph_batches(str(tmp_path), ["id"], ["ts"])
    run(rows([(1, 5, "new", False), (2, 1, "gone later", False), (3, 1, "a", None), (3, 1, "b", None)]), 0)
    late = rows([(1, 4, "late", False), (2, 2, None, True)])
    for _ in range(2):
        run(late, 1)
        assert sorted((r.id, r.p) for r in graph_rows(spark, str(tmp_path), ["id"], ["ts"]).collect()) == [(1, "new"), (3, "b")]


def test_each_batch_is_routed_by_the_bindings_of_then(spark, tmp_path):
    from weftline.catalog import _bindings
    from weftline.streaming.pipeline import route_batches

    schema = "message_id int, tenant_id string, integration string, plan_key string, status_code int, step_path string, request_url string"
    batch, all_of_them, asked = spark.createDataFrame([(1, "t", "web", "none", 500, "", "")], schema), _bindings(spark), []

    def bindings():
        asked.append(1)
        return all_of_them if len(asked) == 1 else all_of_them.where("id <> 'b1'")

    run = route_batches(bindings, str(tmp_path))
    run(batch, 0)
    run(batch.withColumn("message_id", F.lit(2)), 1)
    assert [(r.message_id, r.binding_id) for r in spark.read.parquet(f"{tmp_path}/v=0", f"{tmp_path}/v=1").collect()] == [(1, "b1")]


def test_scheduled_deletions_equal_a_replay(spark):
    """Against a store that goes through all moments in their order."""
    rnd, grace, now = random.Random(8), 10, 200
    runs = sorted({("s" + str(rnd.randrange(2)), f"r{i}", rnd.choice([rnd.randrange(190), 300])) for i in range(25)} | {("s0", "late", 195), ("s1", "late", 196)})
    seen = [(s, rnd.randrange(30), r, done - rnd.randrange(1, 15)) for s, r, done in runs for _ in range(8)] + [("s0", 99, None, 3), ("none", 1, "q", 5), ("s1", None, "r1", 4), ("s1", 4, "r1", None)]
    want = {}
    for s, i in {(s, i) for s, i, _, t in seen if i is not None and t is not None and t <= now}:
        own = [(t, r or "") for a, b, r, t in seen if (a, b) == (s, i) and t is not None and t <= now]
        at, by = max(own)
        status, missed, due, gone = "live", None, None, None
        for done, r in sorted((d, r) for a, r, d in runs if a == s and at < d <= now and r != by):
            if due is not None and due <= done and gone is None:
                gone = due
            if gone is None:
                missed, due = missed if missed is not None else done, done + grace
        if due is not None:
            gone = due if gone is None and due <= now else gone
            status = "deleted" if gone is not None else "pending"
        want[s, i] = (at, status, missed, due, gone)
    sec = lambda c: F.timestamp_seconds(F.col(c))
    sight = spark.createDataFrame(seen, "scope string, id int, execution_id string, ts int").withColumn("ts", sec("ts")).repartition(3)
    ends = spark.createDataFrame(runs, "scope string, execution_id string, completed_at int").withColumn("completed_at", sec("completed_at")).repartition(2)
    got = deletion.scheduled_deletions(sight, ends, ["scope"], grace, F.timestamp_seconds(F.lit(now)))
    out = {(r.scope, r.id): tuple(x if i == 1 or x is None else int(x.timestamp()) for i, x in enumerate((r.last_seen, r.status, r.missed_at, r.scheduled_for, r.deleted_at))) for r in got.collect()}
    assert out == want and len({w[1] for w in want.values()}) == 3
    assert deletion.scheduled_deletions(sight, ends.limit(0), ["scope"], grace, F.timestamp_seconds(F.lit(now))).where("status <> 'live'").count() == 0
