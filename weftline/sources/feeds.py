"""Kafka and file feeds, change feeds, and the sinks of mapped messages, dead letters, events and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.datasource import SCHEMA as ENVELOPE


def kafka_stream(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", per_trigger: int | None = None) -> DataFrame:
    """Key and value as text with topic, partition, offset and timestamp. Needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting)
    reader = reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


def file_stream(spark: SparkSession, path: str, schema: str | T.StructType, form: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(form).schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.load(path)


def parse_envelopes(messages: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns of JSON messages; those that can't be read have a null tenant_id and keep their text in _corrupt."""
    parsed = F.from_json(value, ENVELOPE)
    return messages.select("*", parsed.alias("_e")).select(*[c for c in messages.columns if c != value], "_e.*", F.when(F.col("_e.tenant_id").isNull(), F.col(value)).alias("_corrupt"))


def parse_changes(messages: DataFrame, row: str, value: str = "value") -> DataFrame:
    """(op, ts_ms, the row's columns) of change-feed JSON {before, after, op, ts_ms}; deletes carry the row before. Tombstones
    and rows of another op than c, u, d, r are dropped."""
    parsed = F.from_json(value, f"before struct<{row}>, after struct<{row}>, op string, ts_ms long")
    out = messages.where(F.col(value).isNotNull()).select(parsed.alias("e")).where(F.col("e.op").isin("c", "u", "d", "r"))
    return out.select("e.op", "e.ts_ms", F.when(F.col("e.op") == "d", F.col("e.before")).otherwise(F.col("e.after")).alias("r")).select("op", "ts_ms", "r.*")


def to_kafka_rows(df: DataFrame, key: str | None, topic: str | None = None) -> DataFrame:
    """(key, value[, topic]) for a Kafka sink: rows as JSON; equal keys go to one partition."""
    cols = [(F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct("*")).alias("value")]
    return df.select(*cols, *([F.col(topic).alias("topic")] if topic else []))


#: Version of the candidates' messages.
EVENT_VERSION = "1.0"


def _event(kind: Column, key: Column, changes: DataFrame, fields: list[str]) -> DataFrame:
    """(key, value): messages of ``kind`` with those of ``fields``, tenant_id and timestamp that ``changes`` has; nulls are left out."""
    own = [c for c in [*fields, "tenant_id", "timestamp"] if c in changes.columns]
    body = F.struct(kind.alias("event_type"), *own)
    return changes.where(kind.isNotNull()).select(key.cast("string").alias("key"), F.to_json(body).alias("value"))


def entity_events(changes: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, value): event messages {event_type, entity_id, ...} as JSON; ``changes`` has event_type, and of entity_type, data,
    source_entities, version, reason, tenant_id and timestamp what there is."""
    named = changes.withColumn("entity_id", F.col(key).cast("string"))
    return _event(F.col("event_type"), F.col(key), named, ["entity_id", "entity_type", "data", "source_entities", "version", "reason"])


def relationship_events(before: DataFrame, after: DataFrame, reason: str | None = None) -> DataFrame:
    """(key, value): relationship.created and relationship.deleted messages between two tables of edges (relationship_id,
    relationship_type, from_entity_id, to_entity_id, and of from_entity_type, to_entity_type, properties, tenant_id what there is)."""
    made = after.join(before.select("relationship_id"), "relationship_id", "left_anti")
    gone = before.join(after.select("relationship_id"), "relationship_id", "left_anti")
    ends = ["relationship_id", "relationship_type", "from_entity_id", "to_entity_id"]
    created = _event(F.lit("relationship.created"), F.col("relationship_id"), made, [*ends, "from_entity_type", "to_entity_type", "properties"])
    deleted = gone.withColumn("reason", F.lit(reason).cast("string"))
    return created.unionByName(_event(F.lit("relationship.deleted"), F.col("relationship_id"), deleted, [*ends, "reason"]))


#: Statuses of candidates and their events; others (deferred) are no news.
CANDIDATE_EVENTS = {"pending": "match.candidate", "auto_merged": "match.approved", "approved": "match.approved", "rejected": "match.rejected"}


def candidate_events(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(key, value): match.candidate, match.approved and match.rejected messages of the candidates (entity_a, entity_b, score,
    status) that are new or have changed their status; the key is entity_a."""
    new = after
    if before is not None:
        old = before.select("entity_a", "entity_b", F.col("status").alias("_status"))
        new = after.join(old, ["entity_a", "entity_b"], "left").where(~F.col("status").eqNullSafe(F.col("_status"))).drop("_status")
    kind = F.create_map(*[F.lit(x) for kv in CANDIDATE_EVENTS.items() for x in kv])[F.col("status")]
    named = new.withColumns({"schema_version": F.lit(EVENT_VERSION), "entity_a_id": F.col("entity_a").cast("string"), "entity_b_id": F.col("entity_b").cast("string")})
    return _event(kind, F.col("entity_a"), named, ["schema_version", "entity_a_id", "entity_b_id", "entity_type", "score", "status", "rule_name"])
