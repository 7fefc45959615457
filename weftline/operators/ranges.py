"""Interval index: which of very many ranges hold a value, as an equi-join.

The endpoints of all ranges of a scope cut the value line into elementary segments: the points themselves and the gaps between them.
A range covers consecutive segments, and is replicated to the few nodes of a binary tree over the segments that cover them exactly
(two a level at most); a value lies in one segment, and looks at that segment's ancestors. So m ranges cost O(m log m) rows, a value
O(log m) keys, and every pair that meets in the join is right: nothing is compared that doesn't match, and no pair is met twice.

Values find their segment by their order among the endpoints. Both are dealt by ranges of (scope, value), so neither a scope
nor a value that very many rows have has to fit into one task; what comes before a partition is added from a table of counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.pairs import meet
from weftline.plans.storage import Spill, shuffle_partitions

#: Levels of the tree over the segments: up to 2 ** 40 segments a scope.
LEVELS = 40


def _same(a: str, b: str, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def locate(points: DataFrame, values: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(points with ``rank``, values with ``segment``), both by (scope..., x).

    ``points`` (scope..., x) are distinct; their ranks count from 1 inside a scope. A value equal to the point of rank r is in segment
    2 r - 1, one between the points of rank r and r + 1 in segment 2 r. NaN is above all numbers. Other columns stay.
    """
    spark = values.sparkSession
    own = [c for c in values.columns if c not in [*scope, "x"]]
    payload = F.struct(*own) if own else F.struct(F.lit(0).alias("_none"))
    both = points.select(*scope, "x", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_any"), F.lit(None).cast(values.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    both = both.unionByName(values.select(*scope, "x", F.lit(1).alias("_kind"), F.xxhash64(payload, F.monotonically_increasing_id()).alias("_any"), payload.alias("_p")))
    # Written before ranges are sampled and counted in one written evaluation, so all steps see the same partitions.
    held = Spill(both, "points").df
    keys = [*scope, "x", "_kind", "_any"]
    ranged = held.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = Spill(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "placed").df
    # The running count of points inside a partition: rows there come sorted already, a point before equal values.
    here = Window.partitionBy("_part", *scope).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    is_point = F.col("_kind") == 0
    counted = placed.withColumns({"_n": F.sum(F.when(is_point, 1).otherwise(0)).over(here), "_last": F.max(F.when(is_point, F.col("x"))).over(here)})
    parts = placed.where(is_point).groupBy(*scope, "_part").agg(F.count("*").alias("_c"), F.max("x").alias("_m"))
    every = placed.select(*scope, "_part").distinct()
    parts = every.alias("a").join(parts.alias("b"), _same("a", "b", [*scope, "_part"]), "left").select("a.*", F.coalesce("b._c", F.lit(0)).alias("_c"), "b._m")
    before = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_below": F.max("_m").over(before)})
    found = counted.alias("c").join(parts.alias("p"), _same("c", "p", [*scope, "_part"]))
    rank = F.col("c._n") + F.col("p._before")
    found = found.select("c.*", rank.alias("_rank"), F.coalesce("c._last", "p._below").alias("_point"))
    at = found.where(is_point).select(*scope, "x", F.col("_rank").cast("long").alias("rank"))
    segment = F.when(F.col("x") == F.col("_point"), 2 * F.col("_rank") - 1).otherwise(2 * F.col("_rank"))
    return at, found.where("_kind = 1").select(*scope, "x", *[F.col(f"_p.{c}").alias(c) for c in own], segment.cast("long").alias("segment"))


def cover(first: Column, last: Column) -> Column:
    """The tree nodes (level, node) that cover the segments first … last exactly, two a level at most; none if first > last."""
    shift = lambda c, n: F.call_function("shiftright", c, n)
    lo, hi = first.cast("long"), last.cast("long") + 1  # half open

    def ends(level: Column) -> Column:
        # What the levels below have left open: an end that is the odd one of its pair is taken here, the rest goes up.
        a, b = -shift(-lo, level), shift(hi, level)
        node = lambda odd, x: F.when((a < b) & (F.pmod(odd, F.lit(2)) == 1), F.struct(level.alias("level"), x.alias("node")))
        return F.array(node(a, a), node(b, b - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), ends)))


def _indexed(ranges: DataFrame, values: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(values with _level and _at, one row for each ancestor of their segment, ranges with the nodes _node that cover them)."""
    ends = ranges.select(*scope, F.explode(F.array("lo", "hi")).alias("x")).where("x is not null").distinct()
    points, placed = locate(ends, values.where("x is not null"), scope)
    points = Spill(points, "ranks").df
    rules = ranges
    for side in ("lo", "hi"):
        p = points.select(*scope, F.col("x").alias(side), F.col("rank").alias(f"_{side}"))
        rules = rules.alias("r").join(p.alias("p"), _same("r", "p", [*scope, side]), "left").select("r.*", f"p._{side}")
    most = points.groupBy(*scope).agg(F.max("rank").alias("_most"))
    rules = rules.alias("r").join(most.alias("m"), _same("r", "m", scope), "left").select("r.*", "m._most")
    first = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(2 * F.col("_lo") - 1 + F.col("lo_open").cast("int"))
    last = F.when(F.col("hi").isNull(), 2 * F.coalesce("_most", F.lit(0))).otherwise(2 * F.col("_hi") - 1 - F.col("hi_open").cast("int"))
    nodes = rules.withColumn("_node", F.explode(cover(first, last))).drop("_lo", "_hi", "_most")
    # Only levels that some range of the scope uses are looked at.
    used = nodes.select(*scope, "_node.level").distinct().groupBy(*scope).agg(F.collect_set("level").alias("_levels"))
    looking = placed.alias("v").join(used.alias("u"), _same("v", "u", scope)).select("v.*", F.explode("u._levels").alias("_level"))
    return looking.withColumn("_at", F.call_function("shiftright", F.col("segment"), F.col("_level"))).drop("segment"), nodes


def stabbed(ranges: DataFrame, values: DataFrame, scope: list[str]) -> DataFrame:
    """The rows of ``values`` (scope..., x, ...) joined with the ``ranges`` (scope..., lo, lo_open, hi, hi_open, ...) that hold x.

    A null bound is none; ``lo_open`` / ``hi_open``: the bound itself is outside. A null x is in no range, not even in one without
    bounds; empty ranges hold nothing. Column names besides the scope must differ.
    """
    looking, nodes = _indexed(ranges, values, scope)
    on = _same("l", "n", scope) & (F.col("l._level") == F.col("n._node.level")) & (F.col("l._at") == F.col("n._node.node"))
    rest = [c for c in ranges.columns if c not in scope]
    return looking.alias("l").join(nodes.alias("n"), on).select(*[f"l.{c}" for c in [*scope, *[c for c in values.columns if c not in scope]]], *[f"n.{c}" for c in rest])


def counted(ranges: DataFrame, values: DataFrame, scope: list[str], by: list[str], weight: str) -> DataFrame:
    """(scope..., x, by..., weight): what stabbed gives for the distinct ``values`` (scope..., x), with the ``weight`` of ranges summed by the columns
    ``by``. Ranges are summed at the nodes first, so a value meets O(log m) rows for each ``by``, however many ranges hold it. Null scopes
    meet nothing."""
    looking, nodes = _indexed(ranges, values.select(*scope, "x").distinct(), scope)
    sums = nodes.groupBy(*scope, F.col("_node.level").alias("_level"), F.col("_node.node").alias("_at"), *by).agg(F.sum(weight).alias(weight))
    met = meet(looking, sums, [*scope, "_level", "_at"], "x")
    return met.groupBy(*[F.col(f"x.{c}").alias(c) for c in [*scope, "x"]], *[F.col(f"y.{c}").alias(c) for c in by]).agg(F.sum(f"y.{weight}").alias(weight))
