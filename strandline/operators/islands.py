"""Clusters of positions along an axis, split where neighbours are too far apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.lineage import cut
from strandline.operators import ranges
from strandline.operators.skew import join_per_key

#: Width of a shard of the axis, which bounds the distinct positions that one task orders.
SHARD = 1 << 20


def _cluster_starts(df: DataFrame, keys: list[str], position: str, gap: int, name: str, shard: int) -> DataFrame:
    """(keys, position, name, _n) for each distinct position, name being the first position of its cluster."""
    spots = (
        df.select(*keys, F.col(position).cast("long").alias(position))
        .dropna()
        .groupBy(*keys, position)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shard", F.floor(F.col(position) / shard))
    )
    here = Window.partitionBy(*keys, "_shard").orderBy(position)
    before = F.lag(position).over(here)
    opens = before.isNull() | (F.col(position) - before > gap)
    spots = spots.withColumn("_opens", F.when(opens, F.col(position)))
    spots = spots.withColumn("_piece", F.max("_opens").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shards = spots.groupBy(*keys, "_shard").agg(F.min(position).alias("_first"), F.max(position).alias("_last"), F.max("_piece").alias("_last_piece"))
    along = Window.partitionBy(*keys).orderBy("_shard")
    joined = F.coalesce(F.col("_first") - F.lag("_last").over(along) <= gap, F.lit(False))
    passed_on = F.when(~(F.col("_joined") & (F.col("_last_piece") == F.col("_first"))), F.col("_last_piece"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    roots = (
        shards.withColumn("_joined", joined)
        .withColumn("_passed", passed_on)
        .withColumn("_root", F.when(F.col("_joined"), F.last("_passed", ignorenulls=True).over(earlier)).otherwise(F.col("_first")))
        .select(*keys, "_shard", "_first", "_root")
    )
    start = F.when(F.col("_piece") == F.col("_first"), F.col("_root")).otherwise(F.col("_piece"))
    return spots.join(roots, [*keys, "_shard"]).select(*keys, position, start.alias(name), "_n")


def gap_clusters(df: DataFrame, keys: list[str], position: str, gap: int, name: str = "cluster", shard: int = SHARD) -> DataFrame:
    """df with name, the first position of the row's cluster: within keys, a new one begins where a position exceeds the one before by more than gap.

    Distinct positions are clustered within shards of the axis and the shards' first and last clusters are stitched, so neither a key nor a place
    that holds most rows ends in one task. Rows with a null in keys or position are left out; an empty table stays empty. df is read several times; the clusters of its
    distinct positions are written once.
    """
    starts = cut(_cluster_starts(df, keys, position, gap, name, shard))
    return join_per_key(df.withColumn(position, F.col(position).cast("long")), starts, [*keys, position], "_n")


def cluster_counts(df: DataFrame, keys: list[str], position: str, gap: int, shard: int = SHARD) -> DataFrame:
    """(keys, start_pos, end_pos, n) of the clusters of gap_clusters, without going back to the rows."""
    starts = _cluster_starts(df, keys, position, gap, "start_pos", shard)
    return starts.groupBy(*keys, "start_pos").agg(F.max(position).alias("end_pos"), F.sum("_n").alias("n"))


def carried(df: DataFrame, keys: list[str], position: str, order: list[str], what: Column, name: str, before: bool, shard: int = SHARD) -> DataFrame:
    """df with name, the last value of what that isn't null in rows up to this one (with before: ahead of it) within keys, by order, which begins with position.

    Rows are ordered within shards of the axis; what a shard hands on is found from each shard's last value. So no window holds all rows of a key, nor of
    a chain of near ones. order has to tell rows apart; rows with a null in position are left out.
    """
    rows = df.where(F.col(position).isNotNull()).withColumns({"_shard": F.floor(F.col(position) / shard), "_what": what})
    here = Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    shards = rows.groupBy(*keys, "_shard").agg(F.max_by("_what", F.when(F.col("_what").isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    handed = shards.withColumn("_handed", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    local = rows.withColumn("_local", F.last("_what", ignorenulls=True).over(here))
    return local.join(handed, [*keys, "_shard"]).withColumn(name, F.coalesce("_local", "_handed")).drop("_shard", "_what", "_local", "_handed")


def value_clusters(df: DataFrame, keys: list[str], value: str, limit: Column, name: str = "level") -> DataFrame:
    """df with a running number of the value's cluster: within keys a new one begins where the value exceeds the one before by more than limit,
    an expression over the column _before. For groups that are small already, such as those of gap_clusters."""
    values = df.select(*keys, value).dropna().distinct()
    order = Window.partitionBy(*keys).orderBy(value)
    numbered = (
        values.withColumn("_before", F.lag(value).over(order))
        .withColumn("_new", (F.coalesce(F.col(value) - F.col("_before") > limit, F.lit(True))).cast("int"))
        .withColumn(name, F.sum("_new").over(order))
        .select(*keys, value, name)
    )
    return df.join(numbered, [*keys, value])


def anchored_clusters(df: DataFrame, keys: list[str], position: str, width: int) -> DataFrame:
    """(keys, start_pos, center, n) of clusters that each begin at the first position not yet in one and hold all positions less than width after it.

    center is the whole mean of all rows' positions. The positions are split first where neighbours are width or more apart, which always begins a cluster. In
    a longer stretch each position points to the first one width or more after it, and the beginnings are what the stretch's first position leads to:
    pointers are doubled, so a stretch of n clusters takes log2(n) rounds of joins and is never held by one task. Nulls are left out.
    """
    starts = cut(_cluster_starts(df, keys, position, width - 1, "_stretch", SHARD))
    spans = starts.groupBy(*keys, "_stretch").agg((F.max(position) - F.col("_stretch")).alias("_span"))
    long = cut(starts.join(spans.where(F.col("_span") >= width).select(*keys, "_stretch"), [*keys, "_stretch"], "left_semi").select(*keys, "_stretch", F.col(position).alias("_p"), "_n"))
    own = [*keys, "_stretch"]
    # Mirrored, the first position after a place is the last one before it.
    targets = long.select(*own, (-F.col("_p")).alias("_at"), F.col("_p").alias("_to"))
    pointers = ranges.last_before(long.select(*own, "_p", (-F.col("_p") - width).alias("_back")), targets, own, "_back", "_at", "_to")
    pointers = cut(pointers.where("_to is not null").select(*own, "_p", "_to"))
    reached = long.select(*own).distinct().withColumn("_p", F.col("_stretch"))
    while not pointers.isEmpty():
        reached = cut(reached.unionByName(reached.join(pointers.hint("merge"), [*own, "_p"]).select(*own, F.col("_to").alias("_p"))).distinct())
        further = pointers.select(*own, F.col("_p").alias("_to"), F.col("_to").alias("_next"))
        pointers = cut(pointers.join(further.hint("merge"), [*own, "_to"]).select(*own, "_p", F.col("_next").alias("_to")))
    begun = ranges.last_before(long, reached.select(*own, F.col("_p").alias("_at"), F.col("_p").alias("start_pos")), own, "_p", "_at", "start_pos")
    short = starts.join(long.select(*own).distinct(), own, "left_anti").select(*keys, F.col("_stretch").alias("start_pos"), F.col(position).alias("_p"), "_n")
    placed = short.unionByName(begun.select(*keys, "start_pos", "_p", "_n"))
    return placed.groupBy(*keys, "start_pos").agg(F.floor(F.sum(F.col("_p") * F.col("_n")) / F.sum("_n")).alias("center"), F.sum("_n").alias("n"))
