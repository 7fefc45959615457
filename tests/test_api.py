import pytest
from pyspark.sql import functions as F

from weftline import api
from weftline.functions.paths import record_array


def test_catalogue():
    found = api.action_catalogue()
    assert len(found) == 81 and next(a for a in found if a["key"] == "number_add")["inputs"] == [{"type": "number", "min": 1, "max": None}]
    assert api.action_output_type("array_filter", ["array<string>"]) == "array<string>" and api.action_output_type("text_length", ["string"]) == "number"


def test_mapping_route(spark):
    d = {"source_fields": [{"id": "a", "path": "a", "type": "number"}], "target_fields": [{"id": "t", "path": "t", "type": "number"}], "links": [{"source": {"field_id": "a"}, "target": {"field_id": "t"}}]}
    assert api.test_mapping(spark, d, {"a": 4}) == {"data": {"t": 4.0}, "error": None}
    assert api.test_mapping(spark, d | {"links": [{"source": {}, "target": {}}]}, {})["errors"]


def test_tenants_and_lookup(spark):
    df = spark.createDataFrame([(1, "t", None, '{"email":"x"}', 5), (2, "t", "gone", '{"email":"x"}', 6), (3, None, None, "{}", 7)], "id long, tenant_id string, deleted_at string, data string, updated_at long")
    assert [r.id for r in api.tenant(df, "t").collect()] == [1] and [r.id for r in api.purge_tenant(df, "t").collect()] == [3]
    assert [r.id for r in api.find_records(df, "email", "x").collect()] == [2, 1]
    with pytest.raises(ValueError, match="secret"):
        api.find_records(df, "secret", "x")


def test_counters_views_and_arrays(spark):
    df = spark.createDataFrame([(None,), ("e",)], "error string")
    assert api.with_counters(df).count() == 2
    api.graph_views(spark, df, df, "g")
    assert spark.sql("select count(*) c from g_edges").first().c == 2
    a = spark.range(1).select(F.array(F.lit(3), F.lit(4)).alias("a"))
    assert a.select(record_array(F.col("a"), "join", separator="+").alias("x")).first().x == "3+4"
    with pytest.raises(ValueError, match="unknown"):
        record_array(F.col("a"), "middle")
