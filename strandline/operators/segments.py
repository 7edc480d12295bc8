"""Steps on read segments: deliveries, routing, clips, pairs, labels and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names

BIN = 1000
READ = ["genome_id", "read_id"]


def keep_first(df: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One row of each identity: the first by order, nulls last. Rows with the same order must be equal."""
    by = Window.partitionBy(*identity).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def clean(segments: DataFrame) -> DataFrame:
    """First deliveries with a place and a read; segments whose end precedes their start are left out."""
    return keep_first(segments, ["seg_id"], ["loaded_at"]).where("ref_id is not null and read_id is not null and ref_start <= ref_end")


IS_SPLIT = "not is_insertion and not is_clipped"


def distinct_starts(segments: DataFrame) -> DataFrame:
    """Split segments without those that begin at the same place of the read as the one before them; insertions and clips all stay."""
    split = segments.where(IS_SPLIT)
    first = Window.partitionBy(*READ, "read_start").orderBy("align_start", "seg_id")
    return split.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").unionByName(segments.where(f"not ({IS_SPLIT})"))


def route(segments: DataFrame) -> DataFrame:
    """Per genome: reads with more than one split segment, insertion segments, and clipped segments that passed or have no label."""
    per_read = segments.groupBy(*READ).agg(F.count_if(F.expr(IS_SPLIT)).alias("n"), F.count_if("is_insertion").alias("ins"), F.count_if(F.expr("is_clipped and coalesce(is_pass, 'PASS') = 'PASS'")).alias("clip"))
    return per_read.groupBy("genome_id").agg(F.count_if(F.col("n") > 1).alias("n_split_reads"), F.sum("ins").alias("n_insertions"), F.sum("clip").alias("n_clipped"))


def clips(segments: DataFrame, longer_than: int = 500) -> DataFrame:
    """Unaligned heads and tails of reads beyond their first and last passed split segment: side, place and length."""
    row = F.struct("read_start", "seg_id", "ref_id", "strand", "ref_start", "ref_end", "read_length")
    last = F.struct("read_end", "seg_id", "ref_id", "strand", "ref_start", "ref_end", "read_length")
    reads = segments.where(f"{IS_SPLIT} and is_pass = 'PASS'").groupBy(*READ).agg(F.min(row).alias("h"), F.max(last).alias("t"))
    at_start, at_end = F.col("h.strand") == 1, F.col("t.strand") == 1
    head = F.struct(F.lit("head").alias("side"), F.col("h.ref_id").alias("ref_id"), F.when(at_start, F.col("h.ref_start")).otherwise(F.col("h.ref_end")).alias("position"), F.col("h.read_start").alias("length"))
    tail = F.struct(F.lit("tail").alias("side"), F.col("t.ref_id").alias("ref_id"), F.when(at_end, F.col("t.ref_end")).otherwise(F.col("t.ref_start")).alias("position"), (F.col("t.read_length") - F.col("t.read_end")).alias("length"))
    return reads.select(*READ, F.inline(F.array(head, tail))).where(F.col("length") > longer_than)


def adjacent_pairs(segments: DataFrame, max_distance: int = 1000, more: tuple[str, ...] = ()) -> DataFrame:
    """Connections of neighbouring split segments of a read that leave less than max_distance of it between them, first end first on the axis.

    gap is what they leave of the read; more names further columns of the segments, which both ends carry.
    """
    rows = segments.where(f"{IS_SPLIT} and (is_pass = 'PASS' or segment_length >= {max_distance})")
    along = Window.partitionBy(*READ).orderBy("align_start", "read_start", "seg_id")
    one = F.struct(*dict.fromkeys(["seg_id", "ref_id", "ref_start", "ref_end", "strand", "read_start", "read_end", "haplotype", "is_pass", *more]))
    pairs = rows.select(*READ, one.alias("x"), F.lead(one).over(along).alias("y")).where(F.col("y").isNotNull() & (F.col("y.read_start") - F.col("x.read_end") < max_distance))
    forward = F.col("y.read_start") > F.col("x.read_start")
    kept = ["chr", "pos", "dir", "hp", "passed", *more]

    def side(s: str, when_forward: str) -> Column:
        other = "left" if when_forward == "right" else "right"
        a, b = (names.end_of(k, F.col(f"{s}.strand"), F.col(f"{s}.ref_start"), F.col(f"{s}.ref_end")) for k in (when_forward, other))
        end = F.when(forward, a).otherwise(b)
        passed = F.coalesce(F.col(f"{s}.is_pass") == "PASS", F.lit(False))
        own = [F.col(f"{s}.ref_id").alias("chr"), end["pos"].alias("pos"), end["dir"].alias("dir"), F.col(f"{s}.haplotype").alias("hp"), passed.alias("passed")]
        return F.struct(*own, *[F.col(f"{s}.{c}").alias(c) for c in more])

    gap = (F.col("y.read_start") - F.col("x.read_end")).alias("gap")
    ends = pairs.select(*READ, F.col("x.seg_id").alias("seg_id"), gap, side("x", "right").alias("p"), side("y", "left").alias("q"))
    first = F.when(F.col("p.pos") <= F.col("q.pos"), F.struct(F.col("p").alias("a"), F.col("q").alias("b"))).otherwise(F.struct(F.col("q").alias("a"), F.col("p").alias("b")))
    cols = [F.col(f"_o.{e}.{f}").alias(f"{f}_{e}") for e in "ab" for f in kept]
    return ends.withColumn("_o", first).select(*READ, "seg_id", *cols, (F.col("_o.a.passed") & F.col("_o.b.passed")).alias("passed"), "gap")


def bins(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row for each bin from first to last; none if last is before first."""
    return df.withColumn("_to", last).withColumn("bin", first).where("bin <= _to").withColumn("bin", F.explode(F.sequence("bin", "_to"))).drop("_to")


def coverage_histogram(segments: DataFrame) -> DataFrame:
    """How many passed split segments fill each inner bin, by genome, haplotype and contig; bins without any have no row."""
    rows = segments.where(f"{IS_SPLIT} and is_pass = 'PASS'")
    inner = bins(rows, F.floor(F.col("ref_start") / BIN) + 1, F.floor(F.col("ref_end") / BIN) - 1)
    return inner.groupBy("genome_id", "haplotype", "ref_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def background(segments: DataFrame, share: float = 0.95) -> DataFrame:
    """Per genome the share-quantile of the mismatch rate of split segments, each counted once per begun 2000 positions."""
    rows = segments.where(f"{IS_SPLIT} and mismatch_rate is not null")
    weight = F.floor((F.col("ref_end") - F.col("ref_start")) / 2000) + 1
    return rows.groupBy("genome_id").agg(F.percentile("mismatch_rate", share, weight).alias("background"))


def high_mismatch_bins(segments: DataFrame, limit: Column) -> DataFrame:
    """Bins with five or more split segments of which at least four reach limit and one exceeds it, while the max(5, min(n/10, 15))-th lowest stays below it.

    Ranks are asked as counts, so no bin's values are gathered, however deep its coverage.
    """
    rows = segments.where(f"{IS_SPLIT} and mismatch_rate is not null")
    touched = bins(rows, F.floor(F.col("ref_start") / BIN), F.floor(F.col("ref_end") / BIN)).select("ref_id", "bin", "mismatch_rate")
    v = F.col("mismatch_rate")
    counts = touched.groupBy("ref_id", "bin", v).agg(F.count(F.lit(1)).alias("c")).groupBy("ref_id", "bin").agg(
        F.sum("c").alias("n"), F.sum(F.when(v >= limit, F.col("c")).otherwise(0)).alias("reach"),
        F.sum(F.when(v > limit, F.col("c")).otherwise(0)).alias("over"), F.sum(F.when(v < limit, F.col("c")).otherwise(0)).alias("below"),
    )
    rank = F.greatest(F.lit(5), F.least(F.floor(F.col("n") / 10), F.lit(15)))
    return counts.where((F.col("n") >= 5) & (F.col("reach") >= 4) & (F.col("over") >= 1) & (F.col("below") >= rank)).select("ref_id", "bin")


def labels(segments: DataFrame, masked: DataFrame, limit: Column, min_mapq: int = 10, min_share: float = 0.5, min_length: int = 2000) -> DataFrame:
    """(seg_id, label): what speaks against a segment, PASS if nothing does.

    Low mapq; a mismatch rate of at least limit where the bins of its original ends touch a masked one; a read of which less than min_share or min_length is aligned. Aligned
    lengths are those of all segments but clipped ones, as long as the read is.
    """
    whole = Window.partitionBy(*READ)
    aligned = F.sum(F.when(~F.col("is_clipped"), F.col("read_end") - F.col("read_start"))).over(whole)
    length = F.min_by("read_length", F.struct("align_start", "read_start", "seg_id")).over(whole)
    own = lambda c: F.floor(F.coalesce(f"{c}_ori", c) / BIN)
    touched = bins(segments.where(F.col("mismatch_rate") >= limit).select("seg_id", "ref_id", own("ref_start").alias("_from"), own("ref_end").alias("_last")), F.col("_from"), F.col("_last"))
    high = touched.join(masked, ["ref_id", "bin"], "left_semi").select("seg_id").distinct().withColumn("_high", F.lit(True))
    parts = F.concat(
        F.when(F.col("mapq") < min_mapq, "_LOW_MAPQ").otherwise(""), F.when(F.col("_high"), "_HIGH_MM_rate").otherwise(""),
        F.when((F.col("_aligned") < min_share * F.col("_length")) | (F.col("_aligned") < min_length), "_LOW_ALIGNED_LEN").otherwise(""),
    )
    rows = segments.withColumn("_aligned", aligned).withColumn("_length", length).join(high, "seg_id", "left")
    return rows.select("seg_id", F.when(parts == "", "PASS").otherwise(parts).alias("label"))
