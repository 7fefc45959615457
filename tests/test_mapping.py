import pytest
from pyspark.sql import functions as F

from weftline.functions.paths import json_text, parse_path, typed
from weftline.plans.mapping import apply_mapping, latest_definitions, validate


def f(i, path, kind, **kw):
    return {"id": i, "path": path, "type": kind, **kw}


def link(source, target, priority=0):
    side = lambda x: {"field_id": x[1:]} if x.startswith("@") else {"step_id": x[1:]} if x.startswith("#") else {"constant": x}
    return {"priority": priority, "source": side(source) if isinstance(source, str) else {"constant": source}, "target": side(target)}


def step(i, key, kind="transformer", invert=False, **args):
    return {"id": i, "type": kind, "action": {"key": key, "arguments": args, "invert": invert}}


def run(spark, definition, *bodies, schema=None):
    """Through JSON text and, with a schema, through typed columns: both must agree."""
    import json

    d = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    out = apply_mapping(d, definition, "body").orderBy("i").collect()
    got = [(r.data.asDict(True) if r.data is not None else None, r.error) for r in out]
    if schema:
        t = apply_mapping(d.withColumn("body", F.from_json("body", schema)), definition, "body").orderBy("i").collect()
        assert [(r.data.asDict(True) if r.data is not None else None, r.error) for r in t] == got
    return got


def test_concat_of_two_fields(spark):
    d = {"source_fields": [f("a", "first_name", "string"), f("b", "last_name", "string")], "target_fields": [f("t", "full_name", "string")], "steps": [step("c", "text_concat", separator=" ")], "links": [link("@a", "#c", 0), link("@b", "#c", 1), link("#c", "@t", 2)]}
    assert run(spark, d, {"first_name": "John", "last_name": "Doe"}, schema="first_name string, last_name string") == [({"full_name": "John Doe"}, None)]


def test_condition_break_leaves_the_other_input(spark):
    d = {"source_fields": [f("a", "value_a", "number"), f("b", "value_b", "number")], "target_fields": [f("r", "result", "number")], "steps": [step("e", "number_is_even", "condition"), step("s", "number_add")], "links": [link("@a", "#e", 0), link("#e", "#s", 1), link("@b", "#s", 2), link("#s", "@r", 3)]}
    got = run(spark, d, {"value_a": 4, "value_b": 6}, {"value_a": 5, "value_b": 6}, schema="value_a double, value_b double")
    assert [g[0]["result"] for g in got] == [10.0, 6.0]


def test_validator_failure_leaves_target_absent(spark):
    d = {"source_fields": [f("e", "email", "string")], "target_fields": [f("t", "email", "string")], "steps": [step("v", "any_is_empty", "validator", True)], "links": [link("@e", "#v"), link("#v", "@t")]}
    assert run(spark, d, {"email": ""}, {"email": "a@b.c"}) == [({"email": None}, None), ({"email": "a@b.c"}, None)]


def test_array_of_objects_with_broadcast(spark):
    item = lambda i, *fs: {"id": i, "type": "object", "fields": list(fs)}
    d = {
        "source_fields": [f("o", "response_body.id", "string"), f("ds", "response_body.owned_devices.value", "array", items=item("dv", f("did", "id", "string")))],
        "target_fields": [f("rels", "relationships", "array", items=item("rel", f("rt", "_relationship_type", "string"), f("ff", "_from_source_id", "string"), f("tt", "_to_source_id", "string")))],
        "links": [link("owns", "@rt"), link("@o", "@ff"), link("@did", "@tt")],
    }
    body = {"response_body": {"id": "u1", "owned_devices": {"value": [{"id": "d1"}, {"id": "d2"}]}}}
    want = [{"_relationship_type": "owns", "_from_source_id": "u1", "_to_source_id": x} for x in ("d1", "d2")]
    none = {"response_body": {"id": "u1", "owned_devices": {"value": []}}}
    got = run(spark, d, body, none, schema="response_body struct<id:string, owned_devices:struct<value:array<struct<id:string>>>>")
    assert [g[0]["relationships"] for g in got] == [want, []]


def test_fan_in_constants_defaults_and_nested_targets(spark):
    d = {
        "source_fields": [f("ns", "numbers", "array", items={"id": "n", "type": "number"}), f("m", "Missing", "string"), f("dflt", "gone", "number", default=7)],
        "target_fields": [f("t1", "out.sum", "number"), f("t2", "out.kind", "string"), f("t3", "out.m", "string"), f("t4", "d", "number"), f("t5", "up", "string")],
        "steps": [step("s", "number_add"), step("u", "text_to_upper")],
        "links": [link("@n", "#s"), link("#s", "@t1"), link("person", "@t2"), link("@m", "@t3"), link("@dflt", "@t4"), link("person", "#u"), link("#u", "@t5")],
    }
    got = run(spark, d, {"numbers": [1, 2, 3, 4, 5], "MISSING": "found"}, {"numbers": []})
    assert got[0] == ({"out": {"sum": 15.0, "kind": "person", "m": "found"}, "d": 7.0, "up": "PERSON"}, None)
    assert got[1][0]["out"] == {"sum": None, "kind": "person", "m": ""}


def test_required_and_failing_steps_are_errors(spark):
    d = {"source_fields": [f("a", "a", "number", required=True)], "target_fields": [f("t", "t", "number")], "steps": [step("r", "number_square_root")], "links": [link("@a", "#r"), link("#r", "@t")]}
    got = run(spark, d, {"a": 9}, {"a": -1}, {})
    assert got[0] == ({"t": 3.0}, None) and got[1][0] is None and "r:" in got[1][1] and got[2][0] is None and "required" in got[2][1]


def test_priority_decides_the_last_write(spark):
    d = {"source_fields": [f("a", "a", "string"), f("b", "b", "string")], "target_fields": [f("t", "t", "string")], "links": [link("@b", "@t", 5), link("@a", "@t", 1)]}
    assert run(spark, d, {"a": "x", "b": "y"})[0][0] == {"t": "y"}


def test_validation_errors():
    base = {"source_fields": [f("a", "a", "number")], "target_fields": [f("t", "t", "string")]}
    assert validate(base | {"links": [link("@a", "@t")]})
    assert validate(base | {"links": [link("@zz", "@t")]}) and validate(base | {"links": [link("@a", "#zz")]})
    assert validate(base | {"steps": [step("s", "no_such")], "links": []}) and validate(base | {"steps": [step("s", "number_add", "condition")], "links": [link("@a", "#s")]})
    loop = [step("x", "number_abs"), step("y", "number_abs")]
    assert any("itself" in e for e in validate(base | {"steps": loop, "links": [link("#x", "#y"), link("#y", "#x")]}))


def test_bad_definitions_do_not_compile(spark):
    with pytest.raises(ValueError, match="not defined"):
        apply_mapping(spark.range(1), {"target_fields": [f("t", "t", "string")], "links": [link("@zz", "@t")]})


def test_whole_row_and_empty_table(spark):
    d = {"source_fields": [f("a", "Name", "string"), f("n", "n", "number")], "target_fields": [f("t", "x.y", "string"), f("u", "n", "number")], "links": [link("@a", "@t"), link("@n", "@u")]}
    df = spark.createDataFrame([("q", 3, "extra")], "name string, n int, data string")
    assert apply_mapping(df, d).first().data.asDict(True) == {"x": {"y": "q"}, "n": 3.0}
    assert apply_mapping(df.limit(0), d).collect() == []


def test_mapping_is_one_projection(spark, capsys):
    d = {"source_fields": [f("a", "a", "number")], "target_fields": [f("t", "t", "number")], "steps": [step("s", "number_add", value=1)], "links": [link("@a", "#s"), link("#s", "@t")]}
    apply_mapping(spark.createDataFrame([(1.0, "x")], "a double, b string"), d).select("data.t").explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan


def test_paths(spark):
    assert parse_path("a.b[2].c[*].d") == ["a", "b", 2, "c", "d"]
    t = "struct<A:struct<b:array<struct<c:int,d:array<int>>>>>"
    df = spark.range(1).select(F.from_json(F.lit('{"A":{"b":[{"c":1,"d":[1,2]},{"c":2,"d":[3]}]}}'), t).alias("x"))
    kind = df.schema["x"].dataType
    got = df.select(*[typed(F.col("x"), kind, p)[0].alias(f"c{i}") for i, p in enumerate(["a.b[1].c", "A.b.c", "A.B.d", "a.b[7].c"])]).first()
    assert list(got) == [2, [1, 2], [1, 2, 3], None]
    j = F.lit('{"A":{"b":[{"c":1,"d":[1,2]},{"c":2,"d":["x"]}],"s":"q\\"q"}}')
    got = spark.range(1).select(*[json_text(j, p).alias(f"c{i}") for i, p in enumerate(["a.b[1].c", "A.b.c", "a.B.d", "a.s", "a.none", "A.b[5].c"])]).first()
    assert list(got) == ["2", "[1,2]", '[1,2,"x"]', 'q"q', None, None]


def test_latest_definition(spark):
    df = spark.createDataFrame([("t", "m", 1, True, None), ("t", "m", 3, False, None), ("t", "m", 2, True, None), ("t", "k", 9, True, "x")], "tenant_id string, id string, version int, is_active boolean, deleted_at string")
    assert [(r.id, r.version) for r in latest_definitions(df).collect()] == [("m", 2)]
