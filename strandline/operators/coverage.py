"""Continuous coverage and gaps of intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a shard of the coordinate axis. It bounds a window's group: after the ends are reduced to the largest one per start, a shard of one entity has at most this many rows.
SHARD = 1 << 20


def covered_and_gaps(
    df: DataFrame, entity: list[str], start: str, end: str, max_gap: int | None = None, shard: int = SHARD
) -> DataFrame:
    """Per entity, the longest stretches [start, end) covered without interruption and the gaps between neighbouring ones.

    Two-level merge: each interval is clipped into shards of the axis, merged within (entity, shard), and only pieces that reach a shard's
    edge are stitched over the whole entity (at most two of a shard, so an entity's largest group is bounded by its axis, not its rows).
    Gaps come from neighbouring pieces of a shard, and between shards from each shard's first start and last end.

    Rows with a null in start or end, or end <= start, cover nothing and are left out; a null in an entity column is an entity of its own.
    Touching intervals continue each other. Repeated rows and further columns have no effect. An empty table gives no rows.
    Returns kind ('covered' or 'gap'), the entity columns, start_pos and end_pos; a gap longer than max_gap is left out.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    named = [F.col(k).alias(c) for k, c in zip(keys, entity)]
    first, last = F.col("_s"), F.col("_e")
    spans = (
        df.select(*[F.col(c).alias(k) for k, c in zip(keys, entity)], F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
        .where(last > first)
        .withColumn("_shard", F.explode(F.sequence(F.floor(first / shard), F.floor((last - 1) / shard))))
        .withColumn("_s", F.greatest(first, F.col("_shard") * shard))
        .withColumn("_e", F.least(last, (F.col("_shard") + 1) * shard))
        .groupBy(*keys, "_shard", "_s")
        .agg(F.max("_e").alias("_e"))
    )
    in_shard = Window.partitionBy(*keys, "_shard").orderBy("_s")
    before = in_shard.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("_e").over(before)
    pieces = (
        spans.withColumn("_new", (reach.isNull() | (first > reach)).cast("int"))
        .withColumn("_piece", F.sum("_new").over(in_shard))
        .groupBy(*keys, "_shard", "_piece")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    )
    pieces = pieces.withColumn("_next", F.lead("_s").over(in_shard))

    at_edge = (first == F.col("_shard") * shard) | (last == (F.col("_shard") + 1) * shard)
    inside = pieces.where(~at_edge).select(*named, first.alias("start_pos"), last.alias("end_pos"))
    along = Window.partitionBy(*keys).orderBy("_s")
    joined = F.lag("_e").over(along) == first
    stitched = (
        pieces.where(at_edge)
        .withColumn("_new", F.when(joined, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(along))
        .groupBy(*keys, "_run")
        .agg(F.min("_s").alias("start_pos"), F.max("_e").alias("end_pos"))
        .select(*named, "start_pos", "end_pos")
    )

    near = pieces.where(F.col("_next").isNotNull()).select(*named, last.alias("start_pos"), F.col("_next").alias("end_pos"))
    by_shard = pieces.groupBy(*keys, "_shard").agg(F.min("_s").alias("_first"), F.max("_e").alias("_last"))
    far = by_shard.select(
        *named, F.col("_last").alias("start_pos"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_shard")).alias("end_pos")
    ).where(F.col("end_pos") > F.col("start_pos"))
    gaps = near.unionByName(far)
    if max_gap is not None:
        gaps = gaps.where(F.col("end_pos") - F.col("start_pos") <= max_gap)
    out = ["kind", *entity, "start_pos", "end_pos"]
    return (
        inside.unionByName(stitched)
        .withColumn("kind", F.lit("covered"))
        .select(*out)
        .unionByName(gaps.withColumn("kind", F.lit("gap")).select(*out))
    )
