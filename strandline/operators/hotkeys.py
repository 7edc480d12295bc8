"""Exact per-key statistics when a handful of keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per (key, value) with its frequency n, counted map-side first, so a hot key is spread over its values.

    Nulls in either column form groups of their own; further columns are not read. An empty table gives no rows.
    """
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def key_counts(weighted: DataFrame) -> DataFrame:
    """Rows per key, duplicates included: columns key and n."""
    return weighted.groupBy("key").agg(F.sum("n").alias("n"))


def frequent_keys(weighted: DataFrame, share: str) -> DataFrame:
    """Keys that hold at least share of all rows, with n; null keys count in the total but are not listed. No rows give no keys."""
    counts = key_counts(weighted)
    total = weighted.agg(F.sum("n").alias("n")).scalar()
    return counts.where(F.col("key").isNotNull() & (F.col("n") >= total * F.lit(Decimal(share)).cast("decimal(9,6)")))


def key_profile(weighted: DataFrame) -> DataFrame:
    """Per key: rows n, rows with a value, distinct values, mode (of equally frequent ones the smallest), minimum, maximum and sum.

    All are exact and come from weighted values. A key without any value has n_values 0, n_distinct 0 and null for the rest.
    """
    some = F.col("value").isNotNull()
    return weighted.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(some, F.struct(-F.col("n"), F.col("value")))).alias("mode_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.sum(F.col("value") * F.col("n")).alias("sum_value"),
    )


def bin_of(value: str, bits: int) -> F.Column:
    """Order-preserving bin of a whole number: its sign, its number of binary digits and the bits after the first one, at most 2 * 64 * 2**bits bins."""
    size = F.abs(F.col(value))
    digits = F.length(F.bin(size))
    shift = F.greatest(digits - 1 - bits, F.lit(0))
    code = shift.cast("long") * (1 << bits) + F.call_function("shiftright", size, shift)
    return F.when(F.col(value) < 0, -code - 1).otherwise(code)


def _whole_rank(share: F.Column, total: F.Column) -> F.Column:
    return F.greatest(F.ceil(share * total).cast("long"), F.lit(1))


def key_percentiles(weighted: DataFrame, shares: list[str], bits: tuple[int, ...] = (7, 23), rank: Callable[[F.Column, F.Column], F.Column] = _whole_rank) -> DataFrame:
    """Exact percentiles of whole-number values per key: the smallest value whose cumulative frequency reaches share * n (shares are decimal texts, such as "0.5").

    Frequencies are summed into order-preserving bins of bits[0] bits, the bin that holds the wanted rank is found from their running sum, only its rows go
    on to finer bins of bits[1] bits, and so on; the values of the last bin are ordered themselves. So a window orders at most 2 * 64 * 2**bits[0] bins of a
    key, then 2**(bits[1] - bits[0]), then 2**(digits - 1 - bits[-1]) values of that many binary digits. Null values are left out; a key without values has
    no row. Returns key, share and value, one row per key and share. rank gives the wanted rank from the share and the number of values.
    """
    some = weighted.where(F.col("value").isNotNull()).select(F.struct("key").alias("_k"), "value", "n").withColumn("_bin", F.lit(0).cast("long"))
    decimals = F.array(*[F.lit(Decimal(s)).cast("decimal(9,6)") for s in shares])
    wanted = some.groupBy("_k", "_bin").agg(F.sum("n").alias("_total")).withColumn("share", F.explode(decimals))
    wanted = wanted.select("_k", "_bin", "share", rank(F.col("share"), F.col("_total")).cast("long").alias("_rank"))
    for b in [*bits, None]:
        code = bin_of("value", b) if b is not None else F.col("value").cast("long")
        some = some.withColumn("_next", code)
        upto = Window.partitionBy("_k", "_bin").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = some.groupBy("_k", "_bin", "_next").agg(F.sum("n").alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
        met = sums.join(wanted, ["_k", "_bin"]).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        wanted = met.select("_k", F.col("_next").alias("_bin"), "share", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"))
        # Only rows of the bins that hold a wanted rank are ordered any further.
        some = some.drop("_bin").withColumnRenamed("_next", "_bin").join(wanted.select("_k", "_bin").distinct(), ["_k", "_bin"], "left_semi")
    return wanted.select("_k.key", "share", F.col("_bin").alias("value"))
