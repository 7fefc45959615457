import json

import pytest

from weftline.sources import extraction as X
from weftline.sources.jmespath import JmesError, search

DATA = {"a": {"b": [{"n": 1, "s": "x", "t": [1, 2]}, {"n": 5, "s": "y", "t": [3]}, {"n": 3, "s": None}]}, "next": "p2", "zero": 0, "empty": []}


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("a.b[0].n", 1), ("a.b[-1].n", 3), ("a.b[*].n", [1, 5, 3]), ("a.b[].t[]", [1, 2, 3]), ("a.b[?n > `2`].s", ["y"]), ("a.b[?s == 'x'] | [0].n", 1), ("length(a.b)", 3), ("a.b[1:].n", [5, 3]), ("a.none.c", None),
        ("next != null && zero == `0`", True), ("empty || next", "p2"), ("!empty", True), ("sum(a.b[*].n)", 9), ("max_by(a.b, &n).s", "y"), ("{x: next, y: a.b[0].n}", {"x": "p2", "y": 1}), ("a.b[0].[n, s]", [1, "x"]), ("join(',', ['q', next])", "q,p2"),
        ("contains(next, 'p')", True), ("sort_by(a.b, &n)[*].n", [1, 3, 5]), ("keys(a)", ["b"]), ("not_null(a.c, next)", "p2"), ("type(a.b)", "array"), ("a.*[0].n", [1]), ("@.next", "p2"), ('"next"', "p2"), ("to_number('4.5')", 4.5), ("a.b[?n>`1` && s].n", [5]), ("zero", 0), ("a.b[?!s].n", [3]),
    ],
)
def test_expressions(expression, want):
    assert search(expression, DATA) == want


def test_bad_expressions():
    for e in ("a.[", "nope(a)", "a b", "a[?", "sum('x')"):
        with pytest.raises(JmesError):
            search(e, DATA)


def run(plan, recorded, **kw):
    waits = []
    r = X.PlanRunner(plan, {"id": "c", "base": "http://h", "integration": "i"}, X.replay(recorded), "t", "e", sleep=waits.append, **kw)
    return r, list(r.run()), waits


def test_pagination_and_context():
    rec = [{"url": "http://h/u", "body": {"v": [1], "next": "2"}}, {"url": "http://h/u?page=2", "body": {"v": [2], "next": None}}]
    plan = {"key": "p", "step": {"url": "{{ config.base }}/u", "params": {"page": "{{ prev.next }}"}, "while": "response.next", "set_context": {"seen": "response.v[0]"}}}
    r, out, _ = run(plan, rec)
    assert [json.loads(e["response_body"])["v"] for e in out] == [[1], [2]] and r.context == {"seen": 2} and r.api_calls == 2 and r.status == "completed"
    assert out[0]["plan_key"] == "p" and out[0]["tenant_id"] == "t" and out[0]["step_path"] == "root"


def test_fan_out_enriches_items():
    rec = [{"url": "http://h/u", "body": [{"id": 1}, {"id": 2}]}, {"url": "http://h/u/1", "body": {"d": "x"}}, {"url": "http://h/u/2", "status": 500, "body": {"error": "e"}}]
    sub = {"id": "detail", "url": "{{ config.base }}/u/{{ item.id }}", "retry": {"max_retries": 1, "initial_delay": 10}}
    _, out, waits = run({"step": {"url": "{{ config.base }}/u", "iterate_over": "response", "sub_steps": [sub]}}, rec)
    by = {e["step_path"]: e for e in out if e["error"] is None}
    assert json.loads(by["root.fanout[0]"]["response_body"]) == {"id": 1, "detail": {"d": "x"}} and json.loads(by["root.fanout[1]"]["response_body"]) == {"id": 2}
    assert [e["error"] for e in out if e["error"]] == ["status 500"] and waits == [0.01] and "root" in by
    _, out, _ = run({"step": {"url": "{{ config.base }}/u", "iterate_over": "response", "sub_steps": [sub | {"retry": {"max_retries": 0}}], "fanout_emit_mode": "page"}}, [dict(x) for x in rec])
    assert len(json.loads(next(e for e in out if e["step_path"] == "root.fanout")["response_body"])) == 2


def test_conditions_and_status_policies():
    rec = [{"url": "http://h/a", "status": 404, "body": {"x": 1}}]
    step = {"url": "http://h/a"}
    assert [e["error"] for e in run({"step": step | {"ignore_on": [404]}}, rec)[1]] == ["ignored"]
    r, out, _ = run({"step": step | {"abort_on": [404]}}, rec)
    assert r.status == "aborted" and out[0]["error"] == "aborted"
    ok = [{"url": "http://h/a", "body": {"stop": True}}]
    assert run({"step": step | {"abort_when": "response.stop"}}, ok)[0].status == "aborted"
    assert [e["error"] for e in run({"step": step | {"ignore_when": "response.stop"}}, ok)[1]] == ["ignored"]
    again = [{"url": "http://h/a", "body": {"busy": True}}, {"url": "http://h/a", "body": {"busy": False}}]
    _, out, waits = run({"step": step | {"retry_when": "response.busy"}}, again)
    assert len(out) == 1 and waits == [1.0]
    r, out, _ = run({"step": step | {"set_context": {"x": "response.v"}}}, [{"url": "http://h/a", "body": {"v": "z" * 70_000}}])
    assert "too large" in out[-1]["error"] and r.status == "failed"


def test_backoff():
    d = lambda kind: [X.backoff_ms({"backoff_type": kind, "initial_delay": 100, "max_delay": 1000}, k) for k in range(1, 7)]
    assert d("fibonacci") == [100, 100, 200, 300, 500, 800] and d("exponential") == [100, 200, 400, 800, 1000, 1000] and d("linear") == [100, 200, 300, 400, 500, 600]
    assert X.backoff_ms(None, 1, "7") == 7000 and X.backoff_ms(None, 1, "999") == 60_000


def test_rate_limit_waits():
    now = [0.0]
    waited = []

    def sleep(s):
        waited.append(s)
        now[0] += s

    limiter = X.RateLimiter([{"name": "l", "requests": 2, "window_secs": 10, "endpoint": "/api", "dynamic": {"remaining_header": "X-Left", "reset_header": "X-Reset"}}], lambda: now[0], sleep)
    for _ in range(3):
        limiter.acquire("http://h/api", "c")
    limiter.acquire("http://h/other", "c")
    assert waited == [10.0]
    limiter.observe("http://h/api", "c", X.Response(200, None, {"x-left": "0", "X-Reset": "5"}))
    limiter.acquire("http://h/api", "c")
    assert waited[1] == 5.0


def test_decoding():
    assert X.decode(b'{"a":1}', "application/json; charset=utf-8") == {"a": 1} and X.decode(b"", "application/json") is None
    assert X.decode(b"<r a='1'><c>x</c><c>y</c><d k='2'>z</d></r>", "text/xml") == {"r": {"@a": "1", "c": ["x", "y"], "d": {"@k": "2", "#text": "z"}}}
    assert X.decode(b"hi", "text/plain") == "hi" and X.decode(b"\xff\x00", "image/png") == "/wA=" and X.decode(b"{bad", "application/json") == "{bad"


def test_auth_tokens_are_cached():
    now = [0.0]
    calls = []

    def send(r):
        calls.append(r.url)
        return X.Response(200, {"token": f"t{len(calls)}", "ttl": 100})

    cache, flow = X.TokenCache(lambda: now[0], 10), {"id": "f", "plan": {"step": {"url": "http://h/token"}}, "token_path": "token", "ttl_path": "ttl"}
    assert cache.get(flow, {}, send) == cache.get(flow, {}, send) == "t1"
    now[0] = 91.0
    assert cache.get(flow, {}, send) == "t2"


def test_data_source(spark):
    from weftline.sources import datasource

    datasource.register(spark)
    rec = [{"url": f"http://h/{i}", "body": {"i": i}} for i in range(3)]
    plans = [{"key": f"p{i}", "step": {"url": f"http://h/{i}"}} for i in range(3)]
    df = spark.read.format("plan_responses").option("plans", json.dumps(plans)).option("configs", json.dumps([{"id": "a"}, {"id": "b"}])).option("recorded", json.dumps(rec)).load()
    assert df.rdd.getNumPartitions() == 6
    assert sorted((r.plan_key, r.config_id, r.response_body) for r in df.collect()) == sorted((f"p{i}", c, f'{{"i":{i}}}') for i in range(3) for c in "ab")


def test_feeds(spark):
    from pyspark.sql import functions as F

    from weftline.sources import feeds

    df = spark.createDataFrame([('{"tenant_id":"t","status_code":200}',), ("nonsense",)], "value string")
    got = feeds.parse_envelopes(df).select("tenant_id", "status_code", "_corrupt").collect()
    assert [tuple(r) for r in got] == [("t", 200, None), (None, None, "nonsense")]
    ch = spark.createDataFrame([('{"before":null,"after":{"id":1,"n":"a"},"op":"c","ts_ms":5}',), ('{"before":{"id":1,"n":"a"},"after":null,"op":"d","ts_ms":6}',), (None,), ('{"op":"t"}',)], "value string")
    assert [tuple(r) for r in feeds.parse_changes(ch, "id:int,n:string").collect()] == [("c", 5, 1, "a"), ("d", 6, 1, "a")]
    rows = feeds.to_kafka_rows(spark.createDataFrame([(1, "a")], "id int, topic string"), "id", "topic").collect()
    assert rows[0].key == "1" and json.loads(rows[0].value) == {"id": 1, "topic": "a"} and rows[0].topic == "a"
    ev = feeds.entity_events(spark.createDataFrame([(1, "entity.created")], "cluster_id long, event_type string")).first()
    assert json.loads(ev.value) == {"event_type": "entity.created", "entity_id": "1"}
    assert F is not None


def test_windowed_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftline.sources.feeds import file_stream
    from weftline.streaming.pipeline import map_stream, windowed_counts

    src = spark.createDataFrame([(f"2024-01-01 00:0{i}:00", "k") for i in range(6)], "ts string, k string").select(F.col("ts").cast("timestamp"), "k")
    src.write.parquet(f"file://{tmp_path}/in")
    stream = file_stream(spark, f"file://{tmp_path}/in", src.schema)
    q = windowed_counts(stream, "ts", ["k"]).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c1").start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 5]
    d = {"source_fields": [{"id": "a", "path": "k", "type": "string"}], "target_fields": [{"id": "t", "path": "up", "type": "string"}], "steps": [{"id": "u", "type": "transformer", "action": {"key": "text_to_upper"}}], "links": [{"source": {"field_id": "a"}, "target": {"step_id": "u"}}, {"source": {"step_id": "u"}, "target": {"field_id": "t"}}]}
    q = map_stream(stream, d).select("data.up").writeStream.format("memory").queryName("m").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c2").start()
    q.awaitTermination()
    assert [r.up for r in spark.table("m").collect()] == ["K"] * 6


def test_more_pages_than_the_bound_is_an_error():
    rec = [{"url": "http://h/u", "body": {"next": True}}]
    plan = {"key": "p", "max_loops": 5, "step": {"url": "http://h/u", "while": "response.next"}}
    r, out, _ = run(plan, rec)
    assert [e["error"] is None for e in out] == [True] * 5 + [False] and "more than 5 loops" in out[-1]["error"] and r.status == "failed"


def test_transport_errors_are_retried_and_end_as_rows():
    calls = []

    def flaky(request):
        calls.append(request.url)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return X.Response(200, {"ok": 1})

    waits = []
    runner = X.PlanRunner({"key": "p", "step": {"url": "http://h/u", "retry": {"initial_delay": 10}}}, {"id": "c"}, flaky, sleep=waits.append)
    assert [e["error"] for e in runner.run()] == [None] and waits == [0.01, 0.01] and runner.status == "completed"

    def refused(request):
        raise ConnectionRefusedError("no")

    runner = X.PlanRunner({"key": "p", "step": {"url": "http://h/u", "retry": {"max_retries": 1, "initial_delay": 10}}}, {"id": "c"}, refused, sleep=waits.append)
    out = list(runner.run())
    assert len(out) == 1 and "ConnectionRefusedError" in out[0]["error"] and runner.status == "failed"
    bad = X.PlanRunner({"key": "p", "step": {"url": "http://h/{{ nope( }}"}}, {"id": "c"}, refused)
    assert "JmesError" in next(bad.run())["error"] and bad.status == "failed"


def test_auth_and_context_in_the_data_source(spark):
    from weftline.sources import datasource

    datasource.register(spark)
    auth = {"id": "a", "plan": {"step": {"url": "http://h/token"}}, "token_path": "access"}
    plan = {"key": "p", "auth": auth, "emit_context": True, "step": {"url": "http://h/u", "params": {"since": "{{ context.last }}"}, "set_context": {"last": "response.last"}}}
    recorded = [{"url": "http://h/token", "body": {"access": "T"}}, {"url": "http://h/u", "body": {"last": 7}}, {"url": "http://h/u?since=7", "body": {"last": 9}}]
    options = {"plans": json.dumps([plan]), "configs": json.dumps([{"id": "c"}]), "recorded": json.dumps(recorded)}
    read = lambda **more: {r.step_path: r for r in spark.read.format("plan_responses").options(**options | more).load().collect()}
    got = read()
    assert json.loads(got["context"].extracted_data) == {"last": 7} and got["root"].error is None
    again = read(contexts=json.dumps({"p/c": {"last": 7}}))
    assert again["root"].request_url.endswith("since=7") and json.loads(again["context"].extracted_data) == {"last": 9}
    failed = read(recorded=json.dumps(recorded[1:]))
    assert list(failed) == ["auth"] and failed["auth"].error


def test_upserts_over_many_batches(spark, tmp_path):
    from weftline.streaming import pipeline as P

    path = f"file://{tmp_path}/out"
    rows = lambda *x: spark.createDataFrame([(k, o, json.dumps(d) if d is not None else None) for k, o, d in x], "id string, o int, data string")
    write = P.upsert_batches(path, ["id"], ["o"])
    batches = [rows(("a", 5, {"x": 1, "y": 1}), ("b", 1, None)), rows(("a", 3, {"x": 9, "z": 3})), rows(("a", 7, {"y": None}), ("b", 2, {"q": "s"}))]
    for n, batch in enumerate(batches):
        write(batch, n)
    write(batches[1], 1)  # replayed
    read = lambda: {r.id: (json.loads(r.data), r.n_changes, r.last_o) for r in P.upserted(spark, path, ["id"], ["o"]).collect()}
    want = {"a": ({"x": 1, "y": None, "z": 3}, 3, 7), "b": ({"q": "s"}, 2, 2)}
    assert read() == want
    assert P.compact_upserts(spark, path, ["id"]) == 2 and read() == want
    write(rows(("a", 6, {"x": 6, "y": 6})), 3)
    assert read() == {**want, "a": ({"x": 6, "y": None, "z": 3}, 4, 7)}
    with pytest.raises(ValueError, match="no upserts"):
        P.upserted(spark, f"file://{tmp_path}/none", ["id"], ["o"])


def test_recorded_responses_of_a_folder_are_read_by_config(spark, tmp_path):
    from weftline.sources import datasource

    path = f"file://{tmp_path}/pages"
    rows = [("a", "http://x/items", '{"v":1}'), ("b", "http://x/items", '{"v":2}'), ("b", "http://x/items", '{"v":3}')]
    spark.createDataFrame(rows, "config_id string, url string, body string").coalesce(1).write.parquet(path)
    datasource.register(spark)
    options = {"plans": json.dumps([{"key": "p", "step": {"url": "http://x/items"}}]), "configs": json.dumps([{"id": i} for i in "abc"]), "recorded_path": path}
    got = {r.config_id: r for r in spark.read.format("plan_responses").options(**options).load().collect()}
    assert json.loads(got["a"].response_body) == {"v": 1} and json.loads(got["b"].response_body) == {"v": 2}
    assert got["c"].status_code == 404
