"""Rate limits over a log of requests: requests in flight, and admission by a sliding window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.plans.storage import Spill, shuffle_partitions


def running_total(rows: DataFrame, scope: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the scope up to this one, by ``order``.

    Rows are dealt by ranges of (scope, order), so a scope of any size takes many tasks: sums run inside a partition, and those of the
    partitions before are added. Orders of a scope should differ; rows with equal ones that fall together come in any order.
    """
    keys = [*scope, *order]
    # Written before ranges are sampled, and summed in one written evaluation.
    held = Spill(rows.withColumn("_value", value.cast("long")), "rows").df
    ranged = held.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = Spill(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered").df
    here = Window.partitionBy("_part", *scope).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*scope, "_part").agg(F.sum("_value").alias("_sum"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    same = F.col("a._part") == F.col("b._part")
    for c in scope:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    summed = placed.withColumn("_own", F.sum("_value").over(here)).alias("a").join(parts.alias("b"), same)
    return summed.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a._own") + F.col("b._before")).alias(name))


def in_flight(requests: DataFrame, scope: list[str], start: str = "started_at", end: str = "ended_at", tie: str = "id", limit: int | None = None) -> DataFrame:
    """``requests`` with in_flight: how many of the scope are under way when one starts, itself included, and over_limit (in_flight above
    ``limit``; null without one).

    A sweep over starts (+1) and ends (-1). A request is under way from its start until before its end, one without an end for ever, one
    that ends before or as it starts not at all for others. Of equal starts the smaller ``tie`` (unique) comes first. Requests without
    a start have a null in_flight and count for nobody.
    """
    payload = F.struct(*[F.col(c) for c in requests.columns])
    moments = [F.struct(F.col(start).alias("_t"), F.lit(1).alias("_step"), F.col(tie).alias("_tie"), payload.alias("_p"))]
    gone = F.when(F.col(end).isNotNull(), F.struct(F.greatest(F.col(end), F.col(start)).alias("_t"), F.lit(-1).alias("_step"), F.col(tie).alias("_tie"), F.lit(None).cast(requests.select(payload.alias("p")).schema["p"].dataType).alias("_p")))
    known = requests.where(F.col(start).isNotNull())
    events = known.select(*scope, F.explode(F.array_compact(F.array(*moments, gone))).alias("_e")).select(*scope, "_e.*")
    # Ends come before the starts of the same moment; that of an empty request must not precede its own start.
    events = events.withColumn("_late", F.when(F.col("_step") == 1, 1).otherwise(0))
    empty = known.where(F.col(end) <= F.col(start)).select(*scope, F.col(tie).alias("_tie"))
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    events = events.alias("e").join(empty.alias("x"), (F.col("e._tie") == F.col("x._tie")) & _same("e", "x", scope), "left").select("e.*", (F.col("x._tie").isNotNull()).alias("_empty"))
    # An empty request's end comes just after its start, before the next one.
    events = events.withColumns({"_late": F.when(F.col("_empty"), 1).otherwise(F.col("_late")), "_last": F.when(F.col("_empty") & (F.col("_step") == -1), 1).otherwise(0)})
    summed = running_total(events, scope, ["_t", "_late", "_tie", "_last"], F.col("_step"), "in_flight").where("_step = 1")
    over = F.lit(None).cast("boolean") if limit is None else F.col("in_flight") > limit
    out = summed.select(*[F.col(f"_p.{c}").alias(c) for c in requests.columns], "in_flight").withColumn("over_limit", over)
    rest = requests.where(F.col(start).isNull()).withColumns({"in_flight": F.lit(None).cast("long"), "over_limit": F.lit(None).cast("boolean")})
    return out.unionByName(rest)


def _same(a: str, b: str, cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def admitted(requests: DataFrame, scope: list[str], limit: int, window_seconds: float, ts: str = "ts", tie: str = "id") -> DataFrame:
    """``requests`` with admitted, remaining and retry_in_us: a log as a limiter with a sliding window would have answered it.

    A request is admitted if fewer than ``limit`` admitted ones of its scope lie in the ``window_seconds`` before it; a refused one leaves no
    entry. ``remaining`` is what is left after it, ``retry_in_us`` how long a refused one has to wait for the oldest entry to go.
    Requests go by (ts, tie); those without a time are refused and wait for nothing.

    Whether a request counts depends on all before it, so a scope's log is read in order by one task, which keeps the last ``limit``
    admitted times of the scope it is at; scopes are dealt over all tasks.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    window = int(window_seconds * 1_000_000)
    columns = requests.columns
    keyed = requests.withColumns({"_scope": F.to_json(F.struct(*scope), {"ignoreNullFields": "false"}), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})
    placed = keyed.repartition(shuffle_partitions(requests.sparkSession), *scope).sortWithinPartitions("_scope", "_us", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, times = None, deque()
        for batch in batches:
            ok, left, wait = [], [], []
            n = batch.num_columns
            for own, t in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                if own != at:
                    at, times = own, deque()
                while times and t is not None and times[0] <= t - window:
                    times.popleft()
                admits = t is not None and len(times) < limit
                if admits:
                    times.append(t)
                ok.append(admits)
                left.append(limit - len(times) if admits else 0)
                wait.append(None if admits or t is None else times[0] + window - t)
            yield pa.record_batch([*batch.columns[: n - 2], pa.array(ok, pa.bool_()), pa.array(left, pa.int64()), pa.array(wait, pa.int64())], [*columns, "admitted", "remaining", "retry_in_us"])

    extra = [T.StructField("admitted", T.BooleanType()), T.StructField("remaining", T.LongType()), T.StructField("retry_in_us", T.LongType())]
    return placed.select(*columns, "_scope", "_us").mapInArrow(run, T.StructType([*requests.schema.fields, *extra]))
