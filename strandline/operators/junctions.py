"""Steps on junctions: support, clusters, filters, genotypes, types and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.lineage import cut
from strandline.operators import islands, ranges


def with_ends(junctions: DataFrame) -> DataFrame:
    """One row of each key, genome and haplotypes, and the ends read from the key: chr_a, pos_a, dir_a, chr_b, pos_b, dir_b and size of an insertion.

    Of different rows the one with most support counts, then that with most dv, then by vcf_id and is_pass.
    """
    order = [F.desc_nulls_last("supp"), F.desc_nulls_last("dv"), F.asc_nulls_first("vcf_id"), F.asc_nulls_first("is_pass")]
    best = F.row_number().over(Window.partitionBy("junction_key", "genome_id", "hp1", "hp2").orderBy(*order))
    rows = junctions.where("junction_key is not null and genome_id is not null").withColumn("_r", best).where("_r = 1").drop("_r")
    return rows.withColumn("_e", names.ends_of_key(F.col("junction_key"))).select("*", "_e.*").drop("_e")


def end_positions(pairs: DataFrame) -> DataFrame:
    """Both ends of connections as rows: chr, dir, pos, passed."""
    ends = F.array(*[F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"dir_{e}").alias("dir"), F.col(f"pos_{e}").alias("pos")) for e in "ab"])
    return pairs.select("genome_id", "read_id", "seg_id", "passed", F.inline(ends))


def end_clusters(ends: DataFrame, gap: int = 50, least: int = 2) -> DataFrame:
    """Clusters of ends of one direction: place (whole median of passed ends, of all if none passed), spread and size, least rows or more."""
    keys = ["chr", "dir"]
    placed = islands.gap_clusters(ends, keys, "pos", gap)
    return (
        placed.groupBy(*keys, "cluster")
        .agg(
            F.floor(F.coalesce(F.median(F.when(F.col("passed"), F.col("pos"))), F.median("pos"))).alias("position"),
            (F.max("pos") - F.min("pos")).alias("spread"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("n") >= least)
    )


def supported(pairs: DataFrame, gap: int = 50, min_support: int = 3, precise: int = 50) -> DataFrame:
    """Junctions of connections whose ends fall in the same two clusters, with distinct reads per genome and haplotypes.

    label is FAIL unless some genome has min_support reads of passed connections; prec is 0 if either end spreads precise or more.
    """
    a = cut(islands.gap_clusters(cut(pairs), ["chr_a", "dir_a"], "pos_a", gap, "cluster_a"))
    both = cut(islands.gap_clusters(a, ["chr_b", "dir_b"], "pos_b", gap, "cluster_b"))
    key = ["chr_a", "dir_a", "cluster_a", "chr_b", "dir_b", "cluster_b"]
    place = both.groupBy(*key).agg(
        F.floor(F.median("pos_a")).alias("position_a"), F.floor(F.median("pos_b")).alias("position_b"),
        F.when((F.max("pos_a") - F.min("pos_a") < precise) & (F.max("pos_b") - F.min("pos_b") < precise), 1).otherwise(0).alias("prec"),
    )
    best = both.where("passed").groupBy(*key, "genome_id").agg(F.count_distinct("read_id").alias("r")).groupBy(*key).agg(F.max("r").alias("most"))
    support = both.groupBy(*key, "genome_id", "hp_a", "hp_b").agg(F.count_distinct("read_id").alias("supp"))
    label = F.when(F.col("most") >= min_support, "PASS").otherwise("FAIL")
    return support.join(place.join(best, key).withColumn("label", label), key)


def merged_ends(rows: DataFrame, keys: list[str], position: str, nearer_than: int = 50) -> DataFrame:
    """Runs of positions each nearer than the limit to the one before, at the place of the last: (keys, start_pos, end_pos, n)."""
    return islands.cluster_counts(rows.select(*keys, position), keys, position, nearer_than - 1)


def similar_deletions(rows: DataFrame, longest: int = 20_000, length_slack: int = 50) -> DataFrame:
    """(junction_key, group_key): deletions that overlap the one before on their contig and are about as long share the first one's key."""
    dels = rows.where(f"vcf_sv_type = 'DEL' and length <= {longest} and pos_b > pos_a").select("junction_key", "chr_a", "pos_a", "pos_b", "length")
    order = ["pos_a", "pos_b", "junction_key"]
    # Repeated rows begin and end alike; one of them stands for all.
    near = islands.carried(dels.distinct(), ["chr_a"], "pos_a", order, F.struct("pos_b", "length"), "before", before=True)
    same = (F.col("pos_a") < F.col("before.pos_b")) & (F.col("before.pos_b") < F.col("pos_b")) & (F.abs(F.col("length") - F.col("before.length")) < length_slack)
    begins = F.when(~F.coalesce(same, F.lit(False)), F.col("junction_key"))
    return islands.carried(near, ["chr_a"], "pos_a", order, begins, "group_key", before=False).select("junction_key", "group_key")


def insertion_clusters(segments: DataFrame, gap: int = 1000, min_reads: int = 2, min_size: int = 50) -> DataFrame:
    """Insertions clustered by place, then by length, with min_reads passed reads of one genome.

    Length and place are whole medians of passed rows; those shorter than min_size, or spread wider than length * (reads + 1), are left out; prec is 0 if the
    places spread wider than min_size or the lengths' coefficient of variation exceeds 0.2.
    """
    rows = segments.where("is_insertion and segment_length is not null").select("genome_id", "read_id", "seg_id", "ref_id", "ref_end", "segment_length", (F.coalesce(F.col("is_pass") == "PASS", F.lit(False))).alias("passed"))
    placed = islands.gap_clusters(rows, ["ref_id"], "ref_end", gap)
    sized = cut(islands.value_clusters(placed, ["ref_id", "cluster"], "segment_length", F.greatest(F.lit(50.0), 0.25 * F.col("_before"))))
    key = ["ref_id", "cluster", "level"]
    reads = sized.where("passed").groupBy(*key, "genome_id").agg(F.count_distinct("read_id").alias("r")).groupBy(*key).agg(F.max("r").alias("most_reads"))
    size, place = F.col("segment_length"), F.col("ref_end")
    stats = sized.where("passed").groupBy(*key).agg(
        F.floor(F.median(size)).alias("length"), F.floor(F.median(place)).alias("position"), (F.max(place) - F.min(place)).alias("spread"),
        (F.stddev_pop(size) / F.avg(size)).alias("cv"), F.count(F.lit(1)).alias("n"),
    )
    kept = stats.join(reads, key).where((F.col("most_reads") >= min_reads) & (F.col("length") >= min_size) & (F.col("length") * (F.col("n") + 1) >= F.col("spread")))
    return kept.withColumn("prec", F.when((F.col("spread") > min_size) | (F.col("cv") > 0.2), 0).otherwise(1)).drop("cv")


def clip_clusters(segments: DataFrame, gap: int = 50) -> DataFrame:
    """Clipped ends clustered by place: (ref_id, cluster, position, strand of the first, n)."""
    placed = islands.gap_clusters(segments.where("is_clipped"), ["ref_id"], "ref_end", gap)
    return placed.groupBy("ref_id", "cluster").agg(F.floor(F.median("ref_end_ori")).alias("position"), F.min_by("strand", F.struct("ref_end", "seg_id")).alias("strand"), F.count(F.lit(1)).alias("n"))


def indel_clusters(rows: DataFrame, gap: int = 20_000, more_than: int = 5) -> DataFrame:
    """Places with more than more_than deletions and insertions of which twice the length exceeds the span."""
    events = rows.where("vcf_sv_type in ('DEL', 'INS')").select("chr_a", "pos_a", "length")
    placed = islands.gap_clusters(events, ["chr_a"], "pos_a", gap)
    sums = placed.groupBy("chr_a", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), (F.max("pos_a") - F.min("pos_a")).alias("span"))
    return sums.where((F.col("n") > more_than) & (2 * F.col("total") > F.col("span")))


def merged_in_repeats(rows: DataFrame) -> DataFrame:
    """Junctions of one kind in one repeat, merged where the sorted lengths differ by at most max(150, a quarter)."""
    inside = rows.where("vntr is not null and length is not null").select("chr_a", "vntr.vntr_start", "vntr.vntr_end", "vcf_sv_type", "length", "supp")
    key = ["chr_a", "vntr_start", "vntr_end", "vcf_sv_type"]
    sized = islands.value_clusters(inside, key, "length", F.greatest(F.lit(150.0), 0.25 * F.col("length")))
    return sized.groupBy(*key, "level").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("length")).alias("length"), F.sum("supp").alias("supp"))


def vaf(rows: DataFrame) -> DataFrame:
    """Per junction and genome: supporting reads, reference reads and their share; null without reads."""
    sums = rows.where("is_pass <> 'FAIL_MERGED_HP'").groupBy("junction_key", "genome_id").agg(F.sum("supp").alias("dv"), F.max("dr").alias("dr"))
    return sums.withColumn("vaf", F.when(F.col("dv") + F.col("dr") > 0, F.col("dv") / (F.col("dv") + F.col("dr"))))


def genotype(rows: DataFrame, is_control: Column, max_control_vaf: float = 0.01, min_vaf: float = 0.05, min_support: int = 3) -> DataFrame:
    """Per junction: hom if the haplotypes of both sides sum to 0 or 3, somatic if no control carries it, PASS if share and support suffice."""
    shares = vaf(rows).groupBy("junction_key").agg(
        F.max("vaf").alias("most_vaf"), F.max("dv").alias("most_dv"), F.coalesce(F.max(F.when(is_control, F.col("vaf"))), F.lit(0.0)).alias("control_vaf"), F.max(is_control).alias("in_control")
    )
    sides = rows.groupBy("junction_key").agg(F.sum_distinct("hp1").alias("h1"), F.sum_distinct("hp2").alias("h2"))
    both = sides.join(shares, "junction_key")
    return both.select(
        "junction_key", F.when(F.col("h1").isin(0, 3) & F.col("h2").isin(0, 3), "hom").otherwise("het").alias("genotype"),
        F.when(~F.col("in_control") | (F.col("control_vaf") <= max_control_vaf), "somatic").otherwise("germline").alias("mut_type"),
        F.when((F.col("most_vaf") >= min_vaf) & (F.col("most_dv") >= min_support), "PASS").otherwise("FAIL").alias("vaf_pass"),
    )


def sv_type(single: Column, kind: Column, ins_seq: Column, chr_a: Column, chr_b: Column, dir_a: Column, dir_b: Column) -> Column:
    """The kind to report; the first rule that applies counts."""
    return (
        F.when(single, "BND").when(kind == "tandem_duplication", "DUP").when((kind == "INS") & (ins_seq == "<DUP>"), "DUP").when(kind == "INS", "INS")
        .when(chr_a != chr_b, "BND").when(kind == "DEL", "DEL").when((dir_a == 1) & (dir_b == -1) & kind.isNull(), "DEL").otherwise(F.coalesce(kind, F.lit("BND")))
    )


def reciprocal_inversions(rows: DataFrame, within: int = 200, share: float = 0.95) -> DataFrame:
    """Pairs of head-to-head and tail-to-tail junctions of a contig with near first and second ends and about the same length."""
    inv = rows.where("chr_a = chr_b and dir_a = dir_b").select("junction_key", "chr_a", "pos_a", "pos_b", "dir_a")
    plus = inv.where("dir_a = 1").select("chr_a", F.col("junction_key").alias("key_p"), F.col("pos_a").alias("p_a"), F.col("pos_b").alias("p_b"))
    minus = inv.where("dir_a = -1").select("chr_a", F.col("junction_key").alias("key_m"), F.col("pos_a").alias("m_a"), F.col("pos_b").alias("m_b"))
    met = ranges.near_pairs(plus, minus, ["chr_a"], "p_a", "m_a", within)
    lp, lm = F.col("p_b") - F.col("p_a"), F.col("m_b") - F.col("m_a")
    return met.where((F.abs(F.col("p_b") - F.col("m_b")) <= within) & (F.abs(lp - lm) < within) & (F.least(lp, lm) > share * F.greatest(lp, lm))).select("key_p", "key_m")


def foldbacks(rows: DataFrame, longest: int = 50_000) -> DataFrame:
    """Short same-direction junctions without one of the other direction that begins within them."""
    inv = rows.where("chr_a = chr_b and dir_a = dir_b and pos_b >= pos_a")
    short = inv.where(F.col("pos_b") - F.col("pos_a") <= longest).select("junction_key", "chr_a", "pos_a", "pos_b", "dir_a")
    out = []
    for d in (1, -1):
        spans = short.where(F.col("dir_a") == d).select("chr_a", "junction_key", F.col("pos_a").alias("low"), F.col("pos_b").alias("high"))
        other = inv.where(F.col("dir_a") == -d).select("chr_a", F.col("pos_a").alias("at"))
        hit = ranges.points_in_intervals(other, spans, ["chr_a"], "at", "low", "high", longest).select("junction_key").distinct()
        out.append(spans.join(hit, "junction_key", "left_anti").select("junction_key", F.lit(d).alias("dir")))
    return out[0].unionByName(out[1])


def translocation_pairs(rows: DataFrame, within: int = 1_000_000) -> DataFrame:
    """Pairs of junctions between the same two contigs with opposite directions, similar support and near ends; shared says whether they share reads."""
    tra = rows.where("chr_a <> chr_b and supp is not null").select("junction_key", "chr_a", "chr_b", "pos_a", "pos_b", "dir_a", "dir_b", "supp", "supp_read_ids")
    x = tra.select("chr_a", "chr_b", *[F.col(c).alias(f"x_{c}") for c in tra.columns if c not in ("chr_a", "chr_b")])
    y = tra.select("chr_a", "chr_b", *[F.col(c).alias(f"y_{c}") for c in tra.columns if c not in ("chr_a", "chr_b")])
    met = ranges.near_pairs(x, y, ["chr_a", "chr_b"], "x_pos_a", "y_pos_a", within)
    balanced = F.abs(F.col("x_supp") - F.col("y_supp")) <= F.least(F.greatest(F.lit(4.0), 0.5 * F.col("x_supp")), F.lit(10.0))
    opposite = (F.col("x_dir_a") == -F.col("y_dir_a")) & (F.col("x_dir_b") == -F.col("y_dir_b")) & (F.col("x_junction_key") < F.col("y_junction_key"))
    near = F.abs(F.col("x_pos_b") - F.col("y_pos_b")) <= within
    shared = F.coalesce(F.arrays_overlap("x_supp_read_ids", "y_supp_read_ids"), F.lit(False))
    return met.where(balanced & opposite & near).select(F.col("x_junction_key").alias("key_x"), F.col("y_junction_key").alias("key_y"), shared.alias("shared"))


def inside_duplications(rows: DataFrame, most: float = 1.2) -> DataFrame:
    """Insertions that lie in a duplication no longer than most times their length: (junction_key, dup_key)."""
    ins = rows.where("vcf_sv_type = 'INS' and length is not null").select("chr_a", "pos_a", "junction_key", F.col("length").alias("ins_length"))
    dup = rows.where("vcf_sv_type = 'DUP' and pos_b > pos_a").select("chr_a", F.col("junction_key").alias("dup_key"), F.col("pos_a").alias("low"), (F.col("pos_b") - 1).alias("high"))
    met = ranges.points_in_intervals(ins, dup, ["chr_a"], "pos_a", "low", "high", 10_000)
    return met.where(F.col("high") + 1 - F.col("low") <= most * F.col("ins_length")).select("junction_key", "dup_key")


def insertions_near_translocations(rows: DataFrame, within: int = 2000, min_size: int = 50) -> DataFrame:
    """Insertions near an end of a translocation that are long enough to reach it: (junction_key, tra_key)."""
    ins = rows.where("vcf_sv_type = 'INS' and length is not null").select("chr_a", F.col("pos_a").alias("ins_pos"), "junction_key", "length")
    tra = rows.where("chr_a <> chr_b")
    ends = tra.select("chr_a", F.col("pos_a").alias("end_pos"), F.col("junction_key").alias("tra_key")).union(tra.select("chr_b", "pos_b", "junction_key"))
    met = ranges.near_pairs(ins, ends, ["chr_a"], "ins_pos", "end_pos", within)
    return met.where(F.col("length") + min_size >= F.abs(F.col("ins_pos") - F.col("end_pos"))).select("junction_key", "tra_key").distinct()


def similar_neighbours(segments: DataFrame, within: int = 2000, share: float = 0.7) -> DataFrame:
    """Passed insertions whose distinct 6-mers make up share of the smaller set with the one before within reach: (seg_id, before, shared)."""
    rows = segments.where("is_insertion and is_pass = 'PASS' and ins_seq is not null").select("ref_id", "ref_end", "seg_id", "ins_seq")
    # The sequences are handed on, not their many 6-mers.
    both = islands.carried(rows, ["ref_id"], "ref_end", ["ref_end", "seg_id"], F.struct("seg_id", "ref_end", "ins_seq"), "_b", before=True)
    both = both.where(F.col("ref_end") - F.col("_b.ref_end") < within).select("seg_id", F.col("_b.seg_id").alias("before"), "ins_seq", F.col("_b.ins_seq").alias("seq_before"))
    both = both.select("seg_id", "before", names.kmers(F.col("ins_seq")).alias("k"), names.kmers(F.col("seq_before")).alias("kb"))
    shared = both.withColumn("shared", F.size(F.array_intersect("k", "kb")))
    return shared.where((F.col("shared") > 0) & (F.col("shared") >= share * F.least(F.size("k"), F.size("kb")))).select("seg_id", "before", "shared")


def position_coverage(positions: DataFrame, segments: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Split segments of mapq above min_mapq that hold a position strictly inside, by genome and haplotype: (ref_id, position, genome_id, h0, h1, h2)."""
    spans = segments.where("not is_insertion and not is_clipped").where(F.col("mapq") > min_mapq)
    spans = spans.select("ref_id", "genome_id", "haplotype", (F.col("ref_start") + 1).alias("low"), (F.col("ref_end") - 1).alias("high"))
    at = positions.select("ref_id", "position").dropna().distinct()
    met = ranges.points_in_intervals(at, spans, ["ref_id"], "position", "low", "high", 10_000)
    return met.groupBy("ref_id", "position", "genome_id").agg(*[F.count_if(F.coalesce(F.col("haplotype"), F.lit(0)) == h).alias(f"h{h}") for h in range(3)])


def in_panel(rows: DataFrame, panel: DataFrame, within: int = 2000, apart: int = 150, loose: int = 1000, alike: int = 50, pad: int = 25) -> DataFrame:
    """Keys of junctions that a panel record matches: its place is within of the first end, or in the junction's padded repeat, and it is near enough.

    Near enough is a difference of at most alike with all differences summing to at most loose, or a sum of at most the wider interval and apart (loose in a
    repeat). The difference is that of the lengths on one contig, and that of the second places on two. rows: (junction_key, c, c2, pos_a, pos_b, length,
    rep_low, rep_high), bounds of the repeat or null; panel: (c, p, c2, q, ci), q being the place and the length of an insertion. The junctions
    here have no intervals of their own, so only the panel's count.
    """
    both = panel.unionByName(panel.where("c2 <> c").select(F.col("c2").alias("c"), F.col("q").alias("p"), F.col("c").alias("c2"), F.col("p").alias("q"), "ci")).distinct()
    in_repeat = F.col("rep_low").isNotNull()
    spans = rows.withColumns({"low": F.when(in_repeat, F.col("rep_low") - pad).otherwise(F.col("pos_a") - within), "high": F.when(in_repeat, F.col("rep_high") + pad).otherwise(F.col("pos_a") + within)})
    met = ranges.points_in_intervals(both, spans, ["c", "c2"], "p", "low", "high", 2 * within)
    off = F.when(F.col("c") == F.col("c2"), F.abs(F.col("q") - F.col("p") - F.col("length"))).otherwise(F.abs(F.col("q") - F.col("pos_b")))
    total = F.abs(F.col("p") - F.col("pos_a")) + off
    return met.where(((off <= alike) & (total <= loose)) | (total <= F.col("ci") + F.when(in_repeat, loose).otherwise(apart))).select("junction_key").distinct()
