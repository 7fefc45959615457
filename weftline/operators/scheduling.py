"""Extraction control as queries: due plans, plan statistics, rate limits, back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def due_plans(plans: DataFrame, configs: DataFrame, integrations: DataFrame, statistics: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Enabled plans × enabled configs of their integration whose wait is over, never-run ones first, then the longest waiting.

    plans (tenant_id, plan_key, integration_id, enabled, wait_seconds), configs (tenant_id, config_id, integration_id, enabled),
    integrations (tenant_id, integration_id, name), statistics (tenant_id, plan_key, config_id, last_execution_at).
    """
    p = plans.where("enabled").join(configs.where("enabled").drop("enabled"), ["tenant_id", "integration_id"]).join(integrations, ["tenant_id", "integration_id"])
    out = p.join(statistics.select("tenant_id", "plan_key", "config_id", "last_execution_at"), ["tenant_id", "plan_key", "config_id"], "left")
    next_at = F.timestamp_micros(F.unix_micros("last_execution_at") + F.col("wait_seconds").cast("long") * 1_000_000)
    out = out.where(F.col("last_execution_at").isNull() | (next_at <= now)).orderBy(F.col("last_execution_at").asc_nulls_first(), "plan_key", "config_id")
    out = out.select("tenant_id", "plan_key", "config_id", "integration_id", F.col("name").alias("integration"), "last_execution_at")
    return out if limit is None else out.limit(limit)


def plan_statistics(executions: DataFrame) -> DataFrame:
    """Counters by plan and config from a run log (tenant_id, plan_key, config_id, status, duration_ms, api_calls, started_at).

    The mean duration is the exact mean of all runs, so it doesn't depend on the order of runs.
    """
    ok = F.col("status") == "completed"
    return executions.groupBy("tenant_id", "plan_key", "config_id").agg(
        F.count("*").alias("total_executions"),
        F.count_if(ok).alias("total_successes"),
        F.count_if(~ok).alias("total_failures"),
        F.coalesce(F.sum("api_calls"), F.lit(0)).alias("total_api_calls"),
        F.avg("duration_ms").alias("average_execution_ms"),
        F.max("started_at").alias("last_execution_at"),
        F.max(F.when(ok, F.col("started_at"))).alias("last_success_at"),
        F.max(F.when(~ok, F.col("started_at"))).alias("last_failure_at"),
        F.max_by("status", "started_at").alias("last_status"),
    )


def rate_limited(requests: DataFrame, scope: list[str], limit: int, window_seconds: float, ts: str = "ts") -> DataFrame:
    """``requests`` with in_window (requests of the scope in the trailing window, itself included) and over_limit."""
    at = F.unix_micros(ts)
    by = Window.partitionBy(*scope).orderBy(at).rangeBetween(-int(window_seconds * 1e6) + 1, 0)
    out = requests.withColumn("in_window", F.count("*").over(by))
    return out.withColumn("over_limit", F.col("in_window") > limit)


def backoff_seconds(attempt: Column, kind: str = "exponential", base: float = 1.0, cap: float = 60.0) -> Column:
    """Delay before retry ``attempt`` (from 1): fibonacci, exponential or linear, at most ``cap`` seconds."""
    if kind == "fibonacci":
        phi = (1 + 5**0.5) / 2
        raw = F.round((F.pow(F.lit(phi), attempt) - F.pow(F.lit(1 - phi), attempt)) / 5**0.5) * base
    elif kind == "linear":
        raw = attempt * base
    else:
        raw = F.pow(F.lit(2.0), attempt - 1) * base
    return F.least(raw.cast("double"), F.lit(cap))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of a list: size 1 … 100 (20 by default), total count beside each row."""
    size = min(max(size, 1), 100)
    total = df.agg(F.count("*").alias("total_count"))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size).crossJoin(F.broadcast(total))
