"""Joins of points with intervals, with points nearby and with the last event before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """Join of points and intervals of the same keys with low <= point <= high; how is inner, left_semi or left_anti (of the points) or left.

    The axis is cut into cells of width: a point is in one, an interval in each that it touches, so a pair meets in exactly one cell. Choose a width
    near the intervals' usual length. Columns of both sides other than keys must differ. Nulls match nothing.
    """
    cell = F.floor(F.col(point) / width)
    spread = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    left = points.withColumn("_cell", cell)
    right = intervals.where(F.col(low) <= F.col(high)).withColumn("_cell", spread)
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_cell"]})
    met = F.col("_cell") == F.col("_r__cell")
    for k in keys:
        met = met & (F.col(k) == F.col(f"_r_{k}"))
    joined = left.join(right, met & F.col(point).between(F.col(low), F.col(high)), how)
    return joined.drop("_cell", "_r__cell", *[f"_r_{k}" for k in keys])


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], pos_a: str, pos_b: str, within: int) -> DataFrame:
    """Inner join of rows of the same keys whose positions differ by at most within."""
    spans = b.withColumns({"_low": F.col(pos_b) - within, "_high": F.col(pos_b) + within})
    return points_in_intervals(a, spans, keys, pos_a, "_low", "_high", max(2 * within, 1)).drop("_low", "_high")


def in_exactly_one(points: DataFrame, intervals: DataFrame, keys: list[str], identity: list[str], point: str, low: str, high: str, width: int) -> DataFrame:
    """Points, with their interval, that lie in exactly one interval; identity names the columns that tell points apart."""
    pairs = points_in_intervals(points, intervals, keys, point, low, high, width)
    alone = Window.partitionBy(*identity)
    return pairs.withColumn("_n", F.count(F.lit(1)).over(alone)).where("_n = 1").drop("_n")


def nearest(points: DataFrame, others: DataFrame, keys: list[str], identity: list[str], pos_a: str, pos_b: str, within: int, allowed: Column, pick: str) -> DataFrame:
    """For each point the nearest other position within reach for which allowed holds; of equally near ones the lower position: adds pick and distance."""
    pairs = near_pairs(points, others, keys, pos_a, pos_b, within).withColumn("distance", F.abs(F.col(pos_a) - F.col(pos_b))).where(allowed)
    best = F.min(F.struct("distance", F.col(pos_b).alias("_p"))).alias("_best")
    return pairs.groupBy(*identity).agg(best).select(*identity, F.col("_best._p").alias(pick), F.col("_best.distance").alias("distance"))


def last_before(points: DataFrame, events: DataFrame, keys: list[str], point: str, at: str, value: str, shard: int = 1 << 20) -> DataFrame:
    """As-of join: points with value, that of the last event at or before the point within the same keys (null without one).

    Events of a shard of the axis are ordered with its points; what earlier shards hand over is found from each shard's last event. So a window's
    group is a shard or the shards of a key, not all rows of a key. Of events at the same place the greatest value counts. Points with a null in keys
    or position get null.
    """
    names = [c for c in points.columns]
    blank = F.lit(False)
    for c in [*keys, point]:
        blank = blank | F.col(c).isNull()
    known, unknown = points.where(~blank), points.where(blank)
    events = events.select(*keys, F.col(at).cast("long").alias("_at"), F.col(value).alias("_v")).dropna().groupBy(*keys, "_at").agg(F.max("_v").alias("_v"))
    both = (
        known.select(*keys, F.col(point).cast("long").alias("_at"), F.lit(None).cast(events.schema["_v"].dataType).alias("_v"), F.struct(*names).alias("_row"), F.lit(1).alias("_kind"))
        .unionByName(events.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        .withColumn("_shard", F.floor(F.col("_at") / shard))
    )
    within = Window.partitionBy(*keys, "_shard").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_here", F.last("_v", ignorenulls=True).over(within))
    shards = both.groupBy(*keys, "_shard").agg(F.max_by("_v", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    handed = shards.withColumn("_handed", F.last("_last", ignorenulls=True).over(earlier)).select(*keys, "_shard", "_handed")
    found = local.where("_kind = 1").join(handed, [*keys, "_shard"]).select("_row.*", F.coalesce("_here", "_handed").alias(value))
    return found.unionByName(unknown.withColumn(value, F.lit(None).cast(events.schema["_v"].dataType)))
