"""Equi-joins of large tables, safe when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys whatever the size of the table.
HOT_SHARE = 500
#: Rows of a key that one task of join_split takes from either side.
PART = 20_000


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with per_key, which has one row for each value of keys and in column count the number of rows with it.

    The fewer than HOT_SHARE hot keys are broadcast, so rows of a hot key stay where they are; only rows of the other keys are shuffled. Without a hot
    key it is a plain join. Rows with a null in a key have no partner and are dropped, as in any inner join. per_key is read several times, once to
    look for hot keys right away: pass a written table. Spark isn't left to broadcast it, since its size estimates of such tables are too low.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    is_hot: Column = F.col(count) * HOT_SHARE > total
    hot = per_key.where(is_hot).drop(count)
    if hot.isEmpty():
        return rows.join(per_key.drop(count).hint("merge"), keys)
    in_hot = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return in_hot.unionByName(rest.join(per_key.where(~is_hot).drop(count).hint("merge"), keys))


def join_split(a: DataFrame, b: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """Inner join of two tables on keys in which either side may have many rows of a key.

    A key's rows are cut into parts of about part rows on both sides, by their content, and each part of the one side meets each of the other in a group of
    its own; keys of at most part rows on both sides, which is nearly all, are one group. Both sides are read twice, for the counts and the join: pass what
    is cheap to read. Rows with a null in a key are dropped; columns other than keys must differ.
    """
    counts = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_a", F.lit(1)).unionByName(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_a", F.lit(0)))
    parts = lambda s: F.max(F.when(F.col("_a") == s, F.ceil(F.col("_n") / part)).otherwise(1)).cast("int")
    # Keys that are split are fewer than the rows of both sides by part.
    split = counts.groupBy(*keys).agg(parts(1).alias("_pa"), parts(0).alias("_pb")).where("_pa > 1 or _pb > 1")

    def salted(side: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*[F.col(c) for c in side.columns]), F.coalesce(own, F.lit(1))).cast("int")
        rows = side.join(split, keys, "left").withColumn(f"_{own}", place)
        return rows.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_pa", "_pb")

    return salted(a, "_pa", "_pb").join(salted(b, "_pb", "_pa"), [*keys, "__pa", "__pb"]).drop("__pa", "__pb")
