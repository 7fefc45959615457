"""The engine's entry points as plain functions: what a service would expose as routes, over DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.actions import REGISTRY, output_kind
from weftline.functions.values import Kind
from weftline.plans.mapping import apply_mapping, validate

#: Fields that records may be looked up by.
LOOKUP_FIELDS = frozenset(("email", "phone", "source_id", "external_id", "name", "username"))


def action_catalogue() -> list[dict]:
    """Every action with its key, input rules, output and description."""
    return [{"key": a.key, "inputs": [{"type": k, "min": lo, "max": None if hi > 1 << 20 else hi} for k, lo, hi in a.rules], "output": a.out, "description": a.text} for a in sorted(REGISTRY.values(), key=lambda a: a.key)]


def action_output_type(key: str, inputs: list[str], arguments: dict | None = None) -> str:
    """The output type of an action for input types such as "number" or "array<string>"."""

    def kind(s: str) -> Kind:
        return Kind("array", kind(s[6:-1])) if s.startswith("array<") else Kind(s)

    return str(output_kind(key, [kind(s) for s in inputs], arguments))


def test_mapping(spark: SparkSession, definition: dict, message: dict) -> dict:
    """{errors} of the definition, or {data, error} of one message."""
    if errors := validate(definition):
        return {"errors": errors}
    row = apply_mapping(spark.createDataFrame([(json.dumps(message),)], "body string"), definition, "body").select(F.to_json("data").alias("data"), "error").first()
    return {"data": None if row.data is None else json.loads(row.data), "error": row.error}


test_mapping.__test__ = False  # not a test of pytest's


def find_records(records: DataFrame, field: str, value: str, data: str = "data", limit: int = 10, allowed: frozenset[str] = LOOKUP_FIELDS) -> DataFrame:
    """The newest ``limit`` records whose JSON ``data`` has ``value`` at an allow-listed field."""
    if field not in allowed:
        raise ValueError(f"records can't be looked up by {field!r}")
    return records.where(F.get_json_object(data, f"$.{field}") == value).orderBy(F.col("updated_at").desc(), "id").limit(limit)


def tenant(df: DataFrame, tenant_id: str | Column, live: bool = True) -> DataFrame:
    """A tenant's rows; without soft-deleted ones if there is a column deleted_at."""
    out = df.where(F.col("tenant_id") == tenant_id)
    return out.where("deleted_at is null") if live and "deleted_at" in df.columns else out


def purge_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    return df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant_id)))


def memberships(members: DataFrame, golden: DataFrame, records: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Golden records of the given records (column id), each once, the oldest first."""
    own = members.join(records.select("id"), "id", "left_semi").select(cluster).distinct()
    return golden.join(own, cluster, "left_semi").orderBy("created_at", cluster)


def graph_views(spark: SparkSession, vertices: DataFrame, edges: DataFrame, prefix: str = "graph") -> None:
    """Temporary views prefix_vertices and prefix_edges for reads in SQL."""
    vertices.createOrReplaceTempView(f"{prefix}_vertices")
    edges.createOrReplaceTempView(f"{prefix}_edges")


def with_counters(mapped: DataFrame, name: str = "mapping", error: str = "error") -> DataFrame:
    """Counts processed, mapped and failed rows while they pass (Spark's observed metrics), at no extra pass."""
    return mapped.observe(name, F.count(F.lit(1)).alias("processed"), F.count_if(F.col(error).isNull()).alias("mapped"), F.count_if(F.col(error).isNotNull()).alias("failed"))
