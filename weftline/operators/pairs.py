"""Pairs of records under a key, of any number, without a pair that is shuffled or written on the way.

Records of the same facts fold to classes (``fold``): rows that hold up to CHUNK ids each, so what depends on facts alone is computed once
for two classes and not once for each pair of their records. Rows that share a key meet in ``meet``: those of a key that very many have are
dealt to blocks, each of which gets the other side whole, so a hot key is the work of many tasks. ``expand`` makes the pairs of records
of two classes where they are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.storage import shuffle_partitions

#: Ids in a row of a class; records of a key that meet all others of it in one task.
CHUNK, BLOCK = 1000, 1000


def tasks(spark: SparkSession) -> int:
    """Partitions for what is small before pairs are made and large afterwards: AQE would judge it by its bytes and fold it into few."""
    return max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)


def same(a: str, b: str, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in cols])


def fold(rows: DataFrame, facts: list[str], id_col: str = "id", chunk: int = CHUNK) -> DataFrame:
    """(facts..., ids): records of the same facts, up to some ``chunk`` ids a row, ascending. Nulls are equal to each other here."""
    own = rows.select(*[F.col(f"`{c}`") for c in facts], F.col(id_col).alias("_id")).withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in facts]))
    many = own.groupBy("_h").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("_k")).where("_k > 1")
    dealt = own.join(many, "_h", "left").withColumn("_c", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_k")), F.lit(0)))
    return dealt.groupBy(*[F.col(f"`{c}`") for c in facts], "_c").agg(F.sort_array(F.collect_list("_id")).alias("ids")).drop("_c")


def meet(x: DataFrame, y: DataFrame, keys: list[str], tag: str, weight: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``x`` joined with ``y`` on ``keys``, as x and y; null keys meet nothing. The rows of a key in ``x`` that weigh more than ``block`` (``weight``
    of a row, 1 by default) are dealt to blocks by their ``tag``."""
    n = tasks(x.sparkSession)
    many = x.groupBy(*keys).agg(F.ceil(F.sum(F.lit(1) if weight is None else weight) / F.lit(block)).alias("_k")).where("_k > 1")
    own = x.join(many, keys, "left").withColumn("_b", F.coalesce(F.pmod(F.xxhash64(tag), F.col("_k")), F.lit(0))).drop("_k")
    every = y.join(many, keys, "left").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    on = [*keys, "_b"]
    return own.repartition(n, *on).alias("x").join(every.repartition(n, *on).alias("y").hint("merge"), same("x", "y", on))


def expand(found: DataFrame, x: str, y: str, twins: Column) -> DataFrame:
    """Rows of two classes with the ids ``x`` and ``y`` as rows (a, b, other columns...), one for each two records, a < b; with ``twins`` they
    are one and the same row of a class."""
    rest = [c for c in found.columns if c not in (x, y)]
    rows = found.withColumn("_same", twins).select(*rest, "_same", y, F.explode(x).alias("_i")).select(*rest, "_same", "_i", F.explode(y).alias("_j"))
    return rows.where(~F.col("_same") | (F.col("_i") < F.col("_j"))).select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), *rest)


def ordered(found: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of two classes with the ids ``x`` and ``y`` as rows (a, b, other columns...) with a of ``x``, b of ``y`` and a < b: for what depends on which
    of two records comes first, where each class meets the other both ways."""
    rest = [c for c in found.columns if c not in (x, y)]
    rows = found.select(*rest, y, F.explode(x).alias("a")).select(*rest, "a", F.explode(y).alias("b"))
    return rows.where("a < b").select("a", "b", *rest)
