"""The gap clusters and bins of this package for unbounded tables, with event time in place of the contig's axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start_pos, end_pos, n) of runs of events that are no more than gap apart; rows later than late are left out.

    Works for a stream in append mode and for a stored table alike. Null keys form a run of their own, null times are left out.
    """
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, late)
    runs = rows.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(key, F.col("w.start").alias("start_pos"), F.col("w.end").alias("end_pos"), "n")


def tumbling_counts(events: DataFrame, key: str, at: str, width: str, late: str) -> DataFrame:
    """(key, bin, n): rows per key and bin of event time."""
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, late)
    return rows.groupBy(F.col(key), F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("bin"), "n")
