"""A training corpus in five stages: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, packing.

Part of the subpackage weftline.llm. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, language, packing, simhash, substring
from weftline.llm.queries import TOKENIZER, table
from weftline.plans.storage import Spill

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Lowest rank-order similarity to the nearest profile; what lies below is no language that was learnt.
MIN_SCORE = 0.05


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew where the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every learnt language, go; lang stays what it was."""
    profiles = language.fit_profiles(docs.where(~language.is_held_out()))
    found = language.predict_language(docs.select(COLUMNS), profiles)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the text of the smallest doc_id stays (of several texts with that doc_id the one of the smallest XXH64), once
    if its row repeats. Unlike texts that share a doc_id are groups of their own. Rows without a doc_id, which no group can name,
    all stay; null and empty texts are one group; an empty table stays empty."""
    rows = docs.select(COLUMNS)
    first = simhash.simhash_groups(rows).where("doc_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text_hash").alias("text_hash"))
    named = rows.withColumn("text_hash", F.xxhash64("text")).join(first, ["doc_id", "text_hash"], "left_semi")
    return named.dropDuplicates(["doc_id", "text_hash"]).select(COLUMNS).unionByName(rows.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; emptied documents go."""
    return _columns(substring.remove_repeated_passages(docs.select(COLUMNS)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    found = decontamination.find_contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("hit_spans is null").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into windows."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("language", identify_language), ("simhash", drop_near_copies), ("substring", cut_repeated_passages), ("decontamination", decontaminate), ("packing", pack)]
#: SQL can't express rank-order profiles, SimHash, chaining or packing; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every stage is written to the shared folder once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Spill(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
