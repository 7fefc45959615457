"""Rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.plans.storage import Spill


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) with the highest score for ``key``: score = -weight / ln(u), u in (0, 1) from XXH64(key, shard).

    A shard of weight w gets a share in proportion to w. Adding a shard moves only rows that it wins itself; removing
    one moves only its own rows. Weights must be positive. A null key is a key like any other. Ties go to the larger shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def score(s: Column) -> Column:
        high = F.call_function("shiftrightunsigned", F.xxhash64(key, s["shard"]), F.lit(11)).cast("double")
        return F.struct((-s["weight"] / F.ln((high + 0.5) / float(1 << 53))).alias("score"), s["shard"].alias("shard"))

    return F.array_max(F.transform(shards, score))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), one row per row of ``docs``.

    ``shard`` depends on doc_id and the weights alone; ``grown_shard`` is the shard under ``grown`` (null if not given).
    ``slot`` numbers a shard's rows from 0 without gaps: rows are numbered inside (shard, input partition), so that a task
    holds no more than a shard's part of one partition however often a key repeats, and the counts of the partitions before
    are added. size = UTF-8 bytes of the text (null: none) + 16. Null doc_ids are one key, repeated rows stay, an empty
    table gives an empty table, other columns are ignored.
    """
    key = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown is not None else F.lit(None).cast(T.IntegerType())).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Written once without the texts: counts and numbers must see the same partitions, whatever ``docs`` is computed from.
    rows = Spill(rows, "shards").df
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("shard", "part").orderBy("at")
    numbered = rows.withColumn("nth", F.row_number().over(inner) - 1)
    joined = numbered.join(offsets, ["shard", "part"])
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
