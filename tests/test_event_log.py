import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import event_log, feeds
from weftline.sources.feeds import file_stream

SCHEMA = "event_type string, entity_id string, entity_a_id string, relationship_id string, score double"


def write(df, path):
    df.select("value").write.format("event_log").option("path", path).mode("append").save()


def test_batches_appear_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    event_log.register(spark)
    assert event_log.read_events(spark, path, SCHEMA).count() == 0
    rows = spark.range(40).select(F.to_json(F.struct(F.lit("entity.created").alias("event_type"), F.col("id").cast("string").alias("entity_id"))).alias("value"))
    write(rows.repartition(4), path)
    write(rows.limit(0), path)
    broken = rows.repartition(4).withColumn("value", F.when(F.col("value").contains('"7"'), F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        write(broken, path)
    got = event_log.read_events(spark, path, SCHEMA)
    assert sorted(int(r.entity_id) for r in got.collect()) == list(range(40))
    listed = {f for m in os.listdir(f"{tmp_path}/log/commits") if m.endswith(".json") and not m.startswith(".") for f in json.load(open(f"{tmp_path}/log/commits/{m}"))["files"]}
    assert len(listed) == 4


def test_a_replayed_stream_batch_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    writer = event_log.StreamWriter({"path": path})
    row = [('{"event_type":"entity.deleted","entity_id":"1"}',)]
    writer.commit([writer.write(iter(row)), None], 0)
    writer.commit([writer.write(iter(row))], 0)  # the same batch again, after a restart
    writer.abort([writer.write(iter(row))], 1)
    assert event_log.read_events(spark, path, SCHEMA).count() == 1 and len(os.listdir(f"{tmp_path}/log/data")) == 1

    def failing():
        yield row[0]
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(failing())
    assert len(os.listdir(f"{tmp_path}/log/data")) == 1


def test_stream_to_the_log(spark, tmp_path):
    path, base = f"file://{tmp_path}/log", f"file://{tmp_path}"
    event_log.register(spark)
    for n in range(2):
        spark.range(n * 10, n * 10 + 10).select(F.col("id").cast("string").alias("value")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = file_stream(spark, f"{base}/in", "value string", files_per_trigger=1)
        stream.select(F.to_json(F.struct(F.col("value").alias("entity_id"))).alias("value")).writeStream.format("event_log").option("path", path).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
        assert sorted(int(r.entity_id) for r in event_log.read_events(spark, path, SCHEMA).collect()) == list(range(n * 10 + 10))


def test_relationship_and_candidate_events(spark):
    edge = "relationship_id string, relationship_type string, from_entity_id string, to_entity_id string, tenant_id string"
    before = spark.createDataFrame([("1", "r", "a", "b", "t"), ("2", "r", "a", "c", "t")], edge)
    after = spark.createDataFrame([("2", "r", "a", "c", "t"), ("3", "r", "b", "c", "t")], edge)
    got = {(r.key, json.loads(r.value)["event_type"], json.loads(r.value).get("reason")) for r in feeds.relationship_events(before, after, "explicit").collect()}
    assert got == {("3", "relationship.created", None), ("1", "relationship.deleted", "explicit")}
    pair = "entity_a long, entity_b long, score double, status string"
    old = spark.createDataFrame([(1, 2, 0.7, "pending"), (1, 3, 0.7, "pending"), (1, 4, 0.9, "approved")], pair)
    new = spark.createDataFrame([(1, 2, 0.7, "approved"), (1, 3, 0.7, "pending"), (1, 4, 0.9, "approved"), (2, 5, 0.99, "auto_merged"), (2, 6, 0.6, "rejected"), (2, 7, 0.6, "deferred"), (3, 8, 0.6, "pending")], pair)
    got = {(r.key, json.loads(r.value)["entity_b_id"], json.loads(r.value)["event_type"]) for r in feeds.candidate_events(old, new).collect()}
    assert got == {("1", "2", "match.approved"), ("2", "5", "match.approved"), ("2", "6", "match.rejected"), ("3", "8", "match.candidate")}
    assert feeds.candidate_events(None, old).count() == 3
