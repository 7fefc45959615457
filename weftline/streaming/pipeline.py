"""Structured Streaming wrappers: mapping as a stateless transform, staged upserts by micro-batch, windowed counts.

Micro-batches are idempotent: a batch writes under its id, and a batch that is run again writes the same rows there. An upsert
writes only the fields its batch changes; readers fold them by the order of the changes (event order, not arrival), and
compact_upserts folds what has piled up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.deletion import completed_runs, unseen_by_last_run
from weftline.operators.routing import match_bindings
from weftline.operators.staging import field_changes, fold_changes, merged_changes
from weftline.plans.mapping import Definition, apply_mapping
from weftline.plans.storage import delete_path, finished_parts


def map_stream(messages: DataFrame, definition: dict | Definition, body: str | None = None) -> DataFrame:
    """apply_mapping on a stream: a projection, so it needs no state."""
    return apply_mapping(messages, definition, body)


def upsert_batches(path: str, key: list[str], order: list[str], data: str = "data") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: batch n's changes, folded by (key, field), are written to ``path``/changes/v=n.

    Nothing earlier is read or written again. A replayed batch overwrites its own version.
    """

    def run(batch: DataFrame, n: int) -> None:
        field_changes(batch, key, order, data).write.mode("overwrite").parquet(f"{path}/changes/v={n}")

    return run


def start_upserts(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], data: str = "data", available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(upsert_batches(path, key, order, data)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _changes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The folded base of the highest version, if there is one, and the changes after it; the highest version."""
    base, changes = finished_parts(spark, f"{path}/base", "v"), finished_parts(spark, f"{path}/changes", "v")
    if not base and not changes:
        raise ValueError(f"no upserts under {path}")
    parts = [f"{path}/base/v={base[-1]}"] if base else []
    parts += [f"{path}/changes/v={n}" for n in changes if not base or n > base[-1]]
    return spark.read.parquet(*parts), max(base[-1:] + changes)


def upserted(spark: SparkSession, path: str, key: list[str], order: list[str], data: str = "data") -> DataFrame:
    """(key..., data, n_changes, last_order): the table as of the last finished batch."""
    return fold_changes(_changes(spark, path)[0], key, order, data)


def _fold(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame]) -> int:
    rows, last = _changes(spark, path)
    fold(rows).write.mode("overwrite").parquet(f"{path}/base/v={last}")
    for kind, keep in (("base", last), ("changes", last + 1)):
        for n in (n for n in finished_parts(spark, f"{path}/{kind}", "v") if n < keep):
            delete_path(spark, f"{path}/{kind}/v={n}")
    return last


def compact_upserts(spark: SparkSession, path: str, key: list[str]) -> int:
    """Folds all changes so far to one base, and deletes what it replaces; returns its version. Readers that began before may have
    to begin again."""
    return _fold(spark, path, lambda rows: merged_changes(rows, key))


def compact_graph(spark: SparkSession, path: str, key: list[str], order: list[str]) -> int:
    """compact_upserts for a table of start_graph. Deletions are kept, as an older change may still come after them."""
    return _fold(spark, path, lambda rows: _last_rows(rows, key, order))


def completion_batches(records: Callable[[], DataFrame], path: str, key: list[str], scope: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over lifecycle events: the keys of the records that a completed run of the batch didn't send are
    written to ``path``/v=n. ``records`` gives the table as it is then; a replayed batch overwrites its own keys."""

    def run(batch: DataFrame, n: int) -> None:
        gone = unseen_by_last_run(records(), completed_runs(batch, scope), scope)
        gone.select(key).distinct().write.mode("overwrite").parquet(f"{path}/v={n}")

    return run


def route_batches(bindings: Callable[[], DataFrame], path: str, first: bool = False, id_col: str = "message_id") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the batch's messages with their bindings (match_bindings) are written to ``path``/v=n.

    ``bindings`` is asked anew for each batch, so a changed table takes effect with the next one. A replayed batch overwrites
    its own version, by the bindings of then.
    """

    def run(batch: DataFrame, n: int) -> None:
        match_bindings(batch, bindings(), first, id_col).write.mode("overwrite").parquet(f"{path}/v={n}")

    return run


def _last_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; ties go to the greatest values of the other columns."""
    rest = [c for c in rows.columns if c not in key + order]
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_x"))
    return last.select(*key, *[F.col(f"_x.{c}").alias(c) for c in order + rest])


def graph_batches(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over changes of nodes or edges: batch n's last change of each key, deletions among them, goes to
    ``path``/changes/v=n. Nothing earlier is read; a replayed batch overwrites its own version."""

    def run(batch: DataFrame, n: int) -> None:
        _last_rows(batch, key, order).write.mode("overwrite").parquet(f"{path}/changes/v={n}")

    return run


def start_graph(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], interval: str = "1 second", available_now: bool = False) -> StreamingQuery:
    """Changes of nodes or edges to a graph table, a micro-batch every ``interval``."""
    writer = stream.writeStream.foreachBatch(graph_batches(path, key, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def graph_rows(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The nodes or edges as of the last finished batch: the last change of each key; those with deleted = true are gone."""
    last = _last_rows(_changes(spark, path)[0], key, order)
    return last.where("not coalesce(deleted, false)") if "deleted" in last.columns else last


def windowed_counts(stream: DataFrame, ts: str, key: list[str], window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by key and event-time window; rows later than ``late`` behind the newest are dropped by the watermark."""
    own = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(own, *key).agg(F.count("*").alias("n"))


def pending_join(edges: DataFrame, entities: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream join of edges with entities of their far end, whichever comes first within ``late`` of the other.

    edges (edge_id, to_source_id, edge_ts), entities (source_id, entity_id, entity_ts).
    """
    e, v = edges.withWatermark("edge_ts", late), entities.withWatermark("entity_ts", late)
    on = F.expr(f"to_source_id = source_id AND entity_ts BETWEEN edge_ts - INTERVAL {late} AND edge_ts + INTERVAL {late}")
    return e.join(v, on)
