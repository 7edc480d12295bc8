"""Further steps from connections to calls: one-sided ends, haplotypes, consensus, consistency, coverage and inversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.lineage import cut
from strandline.operators import islands, junctions, ranges
from strandline.operators.skew import join_per_key


def matched_ends(pairs: DataFrame, gap: int = 50, least: int = 2) -> DataFrame:
    """(genome_id, read_id, seg_id, n_ends): how many of a connection's two ends fall into a cluster of at least least ends."""
    ends = junctions.end_positions(pairs)
    placed = cut(islands.gap_clusters(cut(ends), ["chr", "dir"], "pos", gap))
    sizes = placed.groupBy("chr", "dir", "cluster").agg(F.count(F.lit(1)).alias("n"))
    in_large = join_per_key(placed, cut(sizes.where(F.col("n") >= least)), ["chr", "dir", "cluster"], "n")
    return in_large.groupBy("genome_id", "read_id", "seg_id").agg(F.count(F.lit(1)).alias("n_ends"))


def single_ends(pairs: DataFrame, gap: int = 50, least: int = 2, share: float = 0.67, most_partners: int = 7) -> DataFrame:
    """End clusters of which no connection, or too few, has its other end in a cluster, or that have too many partners: (chr, dir, cluster, n, n_paired, partners)."""
    a = cut(islands.gap_clusters(cut(pairs), ["chr_a", "dir_a"], "pos_a", gap, "cluster_a"))
    both = cut(islands.gap_clusters(a, ["chr_b", "dir_b"], "pos_b", gap, "cluster_b"))
    joined = both.groupBy("chr_a", "dir_a", "cluster_a", "chr_b", "dir_b", "cluster_b").agg(F.count(F.lit(1)).alias("m"))
    sides = joined.select(F.inline(F.array(
        F.struct(F.col("chr_a").alias("chr"), F.col("dir_a").alias("dir"), F.col("cluster_a").alias("cluster"), "m"),
        F.struct(F.col("chr_b").alias("chr"), F.col("dir_b").alias("dir"), F.col("cluster_b").alias("cluster"), "m"),
    )))
    sums = sides.groupBy("chr", "dir", "cluster").agg(F.sum("m").alias("n"), F.coalesce(F.sum(F.when(F.col("m") >= least, F.col("m"))), F.lit(0)).alias("n_paired"), F.count_if(F.col("m") >= least).alias("partners"))
    alone = (F.col("partners") == 0) | (F.col("n") - F.col("n_paired") > share * F.col("n")) | (F.col("partners") > most_partners)
    return sums.where((F.col("n") >= least) & alone)


def breakend_groups(rows: DataFrame, within: int = 50) -> DataFrame:
    """Runs of ends of one direction that hold first and second ends of junctions: (chr, dir, cluster, n_junctions)."""
    ends = rows.select("junction_key", F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"dir_{e}").alias("dir"), F.col(f"pos_{e}").alias("pos"), F.lit(e).alias("side")) for e in "ab"]))).where("dir is not null")
    placed = islands.gap_clusters(ends, ["chr", "dir"], "pos", within)
    sums = placed.groupBy("chr", "dir", "cluster").agg(F.count_distinct("junction_key").alias("n_junctions"), F.min("side").alias("s"), F.max("side").alias("t"))
    return sums.where("s <> t").drop("s", "t")


def merged_haplotypes(rows: DataFrame, share: float = 0.66) -> DataFrame:
    """Support per junction, genome and haplotypes, after unphased support and that of a weaker haplotype are folded into the strongest one.

    First by the first side: haplotype 0, and one whose support is below share of the strongest's, take the strongest (of equal ones the lower); then by the
    second side likewise.
    """
    for side in ("hp1", "hp2"):
        sums = rows.groupBy("junction_key", "genome_id", side).agg(F.sum("supp").alias("s"))
        whole = Window.partitionBy("junction_key", "genome_id")
        phased = F.when(F.col(side) > 0, F.struct(F.col("s"), (-F.col(side)).alias("minus")))
        best = sums.withColumn("top", F.max(phased).over(whole))
        folded = (F.col(side) == 0) | (F.col("top.s") * share > F.col("s"))
        target = F.when(F.col("top").isNotNull() & folded, -F.col("top.minus")).otherwise(F.col(side))
        map_to = best.select("junction_key", "genome_id", side, target.cast("int").alias("to"))
        rows = rows.join(map_to, ["junction_key", "genome_id", side]).withColumn(side, F.col("to")).drop("to")
    return rows.groupBy("junction_key", "genome_id", "hp1", "hp2").agg(F.sum("supp").alias("supp"))


def consensus(segments: DataFrame, gap: int = 1000, share: float = 0.7, slack: int = 50) -> DataFrame:
    """Insertions that agree with their cluster's representative: (seg_id, representative).

    The representative is the passed insertion nearest to the medians of place and length; a member stays if its 6-mers found in the
    representative number more than share of the representative's, less the larger of the length difference and slack.
    """
    rows = segments.where("is_insertion and is_pass = 'PASS' and segment_length is not null and ins_seq is not null").select("seg_id", "ref_id", "ref_end", "segment_length", "ins_seq")
    placed = islands.gap_clusters(rows, ["ref_id"], "ref_end", gap)
    sized = cut(islands.value_clusters(placed, ["ref_id", "cluster"], "segment_length", F.greatest(F.lit(50.0), 0.25 * F.col("_before"))))
    key = ["ref_id", "cluster", "level"]
    middle = sized.groupBy(*key).agg(F.floor(F.median("ref_end")).alias("mp"), F.floor(F.median("segment_length")).alias("ml"), F.count(F.lit(1)).alias("n"))
    scored = join_per_key(sized, cut(middle), key, "n").withColumn("score", F.abs(F.col("ref_end") - F.col("mp")) + F.abs(F.col("segment_length") - F.col("ml")))
    first = scored.groupBy(*key).agg(F.min(F.struct("score", "seg_id", "ins_seq", "segment_length")).alias("f"), F.count(F.lit(1)).alias("n"))
    both = join_per_key(sized, cut(first), key, "n")
    k, rep = names.kmers(F.col("ins_seq")), names.kmers(F.col("f.ins_seq"))
    enough = share * F.size(rep) - F.greatest(F.abs(F.col("segment_length") - F.col("f.segment_length")), F.lit(slack))
    return both.where(F.size(F.array_intersect(k, rep)) > enough).select("seg_id", F.col("f.seg_id").alias("representative"))


def overlap_shift(segments: DataFrame, least: int = 50) -> DataFrame:
    """How far, and on which side, neighbouring segments of reads overlap in the read: the side with the higher mismatch rate gives way.

    (genome_id, chr_x, chr_y, overlap, side), medians over the pairs of split segments that overlap by least or more.
    """
    rows = segments.where("not is_insertion and not is_clipped and mismatch_rate is not null")
    along = Window.partitionBy("genome_id", "read_id").orderBy("align_start", "read_start", "seg_id")
    one = F.struct("ref_id", "read_start", "mismatch_rate")
    both = rows.select("genome_id", F.col("ref_id").alias("chr_x"), "read_end", "mismatch_rate", F.lead(one).over(along).alias("y")).where("y is not null")
    over = both.withColumn("o", F.col("read_end") - F.col("y.read_start")).where(F.col("o") >= least)
    sums = over.groupBy("genome_id", "chr_x", F.col("y.ref_id").alias("chr_y")).agg(F.floor(F.median("o")).alias("overlap"), F.median("mismatch_rate").alias("mx"), F.median("y.mismatch_rate").alias("my"))
    return sums.select("genome_id", "chr_x", "chr_y", "overlap", F.when(F.col("mx") > F.col("my"), "x").otherwise("y").alias("side"))


def coverage_calls(rows: DataFrame, coverage: DataFrame, dup_share: float = 0.5, del_share: float = 1.5, flank: int = 5) -> DataFrame:
    """Duplications and deletions of any length that coverage alone bears out (typed_by_coverage has those that need none): the median inside is deeper than in the flanks by dup_share of the support, or lower by del_share of it."""
    own = rows.where("vcf_sv_type in ('DUP', 'DEL') and chr_a = chr_b and pos_b > pos_a and supp is not null")
    key = ["junction_key", "genome_id", "haplotype"]
    own = own.groupBy("junction_key", "genome_id", F.coalesce("hp1", F.lit(0)).alias("haplotype"), "vcf_sv_type", F.col("chr_a").alias("ref_id"), F.floor(F.col("pos_a") / 1000).alias("lo"), F.floor(F.col("pos_b") / 1000).alias("hi")).agg(F.max("supp").alias("supp"))
    inside = own.select(*key, "ref_id", F.col("lo").alias("low"), F.col("hi").alias("high")).distinct()
    sides = F.array(F.struct((F.col("lo") - flank).alias("low"), (F.col("lo") - 1).alias("high")), F.struct((F.col("hi") + 1).alias("low"), (F.col("hi") + flank).alias("high")))
    outside = own.select(*key, "ref_id", F.inline(sides)).distinct()
    depths = median_depth(inside, coverage, key).withColumnRenamed("depth", "inside").join(median_depth(outside, coverage, key).withColumnRenamed("depth", "outside"), key)
    both = own.select(*key, "vcf_sv_type", "supp").join(depths, key)
    deeper, lower = F.col("inside") > F.col("outside") + dup_share * F.col("supp"), F.col("inside") < F.col("outside") - del_share * F.col("supp")
    call = F.when((F.col("vcf_sv_type") == "DUP") & deeper, "tandem_duplication").when((F.col("vcf_sv_type") == "DEL") & lower, "DEL")
    return both.withColumn("call", call).where("call is not null").select(*key, "call")


def median_depth(wanted: DataFrame, coverage: DataFrame, key: list[str], haplotypes: tuple[int, ...] | None = None, base: int = 8, levels: int = 5) -> DataFrame:
    """Whole median of segments per bin over the ranges [low, high] of bins of each key: (*key, depth). wanted: (*key, haplotype, ref_id, low, high), key with genome_id.

    With haplotypes, wanted has none: each range counts for all of them, and key names haplotype. Bins are also counted by depth in blocks of base, base ** 2, and so on;
    a range is read as its whole blocks of the greatest size that fit, so it costs less than 2 * base rows a level, however long, but for blocks of the last level.
    Bins without segments count as 0. wanted is read twice: pass what is cheap to read.
    """
    place = ["genome_id", "ref_id"] if haplotypes else ["genome_id", "ref_id", "haplotype"]
    own = [c for c in dict.fromkeys([*key, *place]) if not (haplotypes and c == "haplotype")]
    # A block of a level is one number: its place along the axis by levels, and the level.
    none = F.array().cast("array<bigint>")
    upto = lambda i, a, b: F.when(a < b, F.sequence(a * levels + i, (b - 1) * levels + i, F.lit(levels).cast("long"))).otherwise(none)
    first, end = [F.ceil(F.col("low") / base**i).cast("long") for i in range(levels)], [F.floor((F.col("high") + 1) / base**i).cast("long") for i in range(levels)]
    pieces = [upto(levels - 1, first[-1], end[-1])]
    for i in range(levels - 1):
        inner = first[i + 1] < end[i + 1]
        pieces += [upto(i, first[i], F.when(inner, first[i + 1] * base).otherwise(end[i])), F.when(inner, upto(i, end[i + 1] * base, end[i])).otherwise(none)]
    blocks = F.explode(F.array(*[F.floor(F.col("bin") / base**i).cast("long") * levels + i for i in range(levels)]))
    # The bins of a block of the last level come together once, so its smaller blocks are counted where they are.
    near = coverage.withColumn("top", F.floor(F.col("bin") / base ** (levels - 1))).repartition("genome_id", "ref_id", "top")
    counts = near.select("genome_id", "ref_id", "top", "haplotype", "n", blocks.alias("block")).groupBy("genome_id", "ref_id", "top", "haplotype", "block", "n").agg(F.count(F.lit(1)).alias("c")).drop("top")
    whole = wanted.select(*own, F.greatest(F.col("high") - F.col("low") + 1, F.lit(0)).alias("c"))
    if haplotypes:
        counts = counts.where(F.col("haplotype").isin(*haplotypes))
        whole = whole.withColumn("haplotype", F.explode(F.array(*[F.lit(h) for h in haplotypes])))
    met = wanted.select(*own, F.explode(F.concat(*pieces)).alias("block")).join(counts, [*place, "block"])
    # All bins count as 0 at first; those with segments are taken from them.
    found = met.select(*key, F.inline(F.array(F.struct("n", "c"), F.struct(F.lit(0).cast("long").alias("n"), (-F.col("c")).alias("c")))))
    by = whole.select(*key, F.lit(0).cast("long").alias("n"), "c").unionByName(found).groupBy(*key, "n").agg(F.sum("c").alias("c"))
    return by.where("c > 0").groupBy(*key).agg(F.floor(F.percentile("n", 0.5, F.col("c"))).alias("depth"))


def typed_by_coverage(rows: DataFrame, coverage: DataFrame, contigs: DataFrame, dup_share: float = 0.5, del_share: float = 1.5, short: int = 10_000, small: int = 5000, flank: int = 5) -> DataFrame:
    """Duplications and deletions among passed junctions by orientation, of any length: (junction_key, genome_id, haplotype, call).

    Deletions of at most short, and deletions and duplications without an end of a passed junction of at most small strictly between their ends, need no
    coverage, nor do known duplications. Others need a median of segments per bin that is deeper inside than in the flanks by dup_share of the support, or
    lower by del_share of it: inside are the bins from the first end's to the second's, of the first end's haplotype; flanks are the flank bins
    before that, of the same haplotype, and flank bins from the second end's on, of the second end's haplotype.
    """
    passed = rows.where("is_pass = 'PASS' and pos_b is not null")
    ends = passed.where(F.col("length") <= small).select(F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("chr_a"), F.col(f"pos_{e}").alias("end")) for e in "ab"])))
    key = ["junction_key", "genome_id", "haplotype", "second"]
    own = passed.withColumns({"haplotype": F.coalesce("hp1", F.lit(0)), "second": F.coalesce("hp2", F.lit(0)), "known": F.coalesce("is_dup", F.lit(False))})
    own = own.withColumns({"is_del": F.coalesce((F.col("dir_a") == 1) & (F.col("dir_b") == -1), F.lit(False)), "is_dup": F.coalesce((F.col("dir_a") == -1) & (F.col("dir_b") == 1), F.lit(False))})
    own = own.where("chr_a = chr_b and pos_b >= pos_a and (is_del or is_dup or known)").select(*key, "chr_a", "pos_a", "pos_b", "supp", "is_del", "is_dup", "known", (-F.col("pos_a") - 1).alias("back"))
    # Mirrored, the next end to the right is the last one before.
    near = ranges.last_before(own, ends.withColumn("at", -F.col("end")), ["chr_a"], "back", "at", "end")
    alone = F.col("end").isNull() | (F.col("end") >= F.col("pos_b"))
    sure = F.when(F.col("is_del"), alone | (F.col("pos_b") - F.col("pos_a") <= short)).otherwise(alone | F.col("known"))
    judged = cut(near.withColumn("sure", sure).join(contigs.select(F.col("ref_id").alias("chr_a"), F.floor(F.col("length") / 1000).alias("top")), "chr_a", "left"))

    open_ = judged.where("not sure").withColumns({"lo": F.floor(F.col("pos_a") / 1000), "hi": F.floor(F.col("pos_b") / 1000)}).select(*key, F.col("chr_a").alias("ref_id"), "lo", "hi", F.coalesce("top", F.col("hi") + flank).alias("top")).distinct()
    inside = open_.select(*key, "ref_id", F.col("lo").alias("low"), F.least("hi", "top").alias("high"))
    sides = F.array(F.struct(F.col("haplotype").alias("own"), F.greatest(F.col("lo") - flank, F.lit(0)).alias("low"), (F.col("lo") - 1).alias("high")), F.struct(F.col("second").alias("own"), F.col("hi").alias("low"), F.least(F.col("hi") + flank - 1, "top").alias("high")))
    # In the flanks a bin's haplotype is that of its side, so the key carries the first end's under another name.
    around = open_.select("junction_key", "genome_id", F.col("haplotype").alias("first"), "second", "ref_id", F.inline(sides)).withColumnRenamed("own", "haplotype")
    outside = median_depth(around, coverage, ["junction_key", "genome_id", "first", "second"]).select("junction_key", "genome_id", F.col("first").alias("haplotype"), "second", F.col("depth").alias("outside"))
    depths = median_depth(inside, coverage, key).withColumnRenamed("depth", "inside").join(outside, key)
    both = judged.join(depths, key, "left")
    lower, deeper = F.col("inside") < F.col("outside") - del_share * F.col("supp"), F.col("inside") > F.col("outside") + dup_share * F.col("supp")
    call = F.when(F.col("is_del") & (F.col("sure") | lower), "DEL").when(F.col("known") | (F.col("is_dup") & (F.col("sure") | deeper)), "tandem_duplication")
    return both.withColumn("call", call).where("call is not null").select("junction_key", "genome_id", "haplotype", "call").distinct()


def complex_inversions(rows: DataFrame, within: int = 2_000_000) -> DataFrame:
    """The nearest partner of each head-to-head junction among tail-to-tail ones of similar support, and what they make together: (key_p, key_m, what)."""
    inv = rows.where("chr_a = chr_b and dir_a = dir_b and supp is not null and pos_b >= pos_a")
    side = lambda d, s: inv.where(F.col("dir_a") == d).select("chr_a", F.col("junction_key").alias(f"key_{s}"), F.col("pos_a").alias(f"{s}_a"), F.col("pos_b").alias(f"{s}_b"), F.col("supp").alias(f"{s}_supp"))
    met = ranges.near_pairs(side(1, "p"), side(-1, "m"), ["chr_a"], "p_a", "m_a", within)
    balanced = F.abs(F.col("p_supp") - F.col("m_supp")) <= F.least(F.greatest(0.5 * F.col("p_supp"), F.lit(4.0)), F.lit(10.0))
    distance = F.abs(F.col("p_a") - F.col("m_a")) + F.abs(F.col("p_b") - F.col("m_b"))
    best = met.where(balanced).groupBy("key_p").agg(F.min(F.struct(distance.alias("distance"), "key_m", "p_a", "p_b", "m_a", "m_b")).alias("b")).select("key_p", "b.*")
    lp, lm = F.col("p_b") - F.col("p_a"), F.col("m_b") - F.col("m_a")
    alike = (F.least(lp, lm) > 0.95 * F.greatest(lp, lm)) & (F.abs(lp - lm) < 200)
    crossing = (F.col("p_a") - 50 < F.col("m_a")) & (F.col("m_a") < F.col("p_b")) & (F.col("p_b") < F.col("m_b") + 50)
    what = F.when(crossing & alike, "INV").when(crossing, "reciprocal_inv_del").when((F.col("m_a") - 50 < F.col("p_a")) & (F.col("p_a") < F.col("m_b") + 50), "dup_inv_segment").otherwise("complex_inv")
    return best.select("key_p", "key_m", what.alias("what"))


def inconsistent(rows: DataFrame, other_ends: DataFrame, within: int = 50, share: float = 0.3, least: int = 2) -> DataFrame:
    """Junctions near one of whose ends too many other ends lie for their support: (junction_key, genome_id). other_ends: (ref_id, position)."""
    near = other_ends.groupBy(F.col("ref_id").alias("chr"), F.col("position").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ends = rows.where("supp is not null").select("junction_key", "genome_id", "hp1", "hp2", "supp", F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.lit(e).alias("side")) for e in "ab"])))
    met = ranges.near_pairs(ends, near, ["chr"], "pos", "at", within)
    sums = met.groupBy("junction_key", "genome_id", "hp1", "hp2", "supp", "side").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= F.greatest(share * F.col("supp"), F.lit(float(least)))).select("junction_key", "genome_id").distinct()


def repeat_lengths(segments: DataFrame, repeats: DataFrame) -> DataFrame:
    """The net length change of each read in each repeat, from insertions and from gaps between neighbouring split segments that lie in exactly one.

    A gap counts by the difference of what is skipped in the read and on the axis. repeats: (ref_id, low, high), already padded. (genome_id, read_id, ref_id, low, high, net).
    """
    key = ["genome_id", "read_id"]
    ins = segments.where("is_insertion and segment_length is not null").select(*key, "seg_id", "ref_id", F.col("ref_end").alias("x"), F.col("ref_end").alias("y"), F.col("segment_length").alias("change"))
    along = Window.partitionBy(*key).orderBy("align_start", "read_start", "seg_id")
    nxt = F.lead(F.struct("ref_id", "strand", "ref_start", "ref_end", "read_start")).over(along)
    split = segments.where("not is_insertion and not is_clipped and read_end is not null").withColumn("n", nxt).where("n.ref_id = ref_id and n.strand = strand")
    a, b = F.when(F.col("strand") == 1, F.col("ref_end")).otherwise(F.col("n.ref_end")), F.when(F.col("strand") == 1, F.col("n.ref_start")).otherwise(F.col("ref_start"))
    gaps = split.select(*key, "seg_id", "ref_id", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), ((F.col("n.read_start") - F.col("read_end")) - (b - a)).alias("change"))
    pad = repeats.select("ref_id", "low", "high").distinct()
    met = ranges.in_exactly_one(ins.unionByName(gaps), pad, ["ref_id"], [*key, "seg_id"], "x", "low", "high", 1000).where("y <= high")
    return met.groupBy(*key, "ref_id", "low", "high").agg(F.sum("change").alias("net"))


def crowded_repeats(rows: DataFrame, repeats: DataFrame, most: int = 3) -> DataFrame:
    """Junctions in repeats that hold more than most different ones: (junction_key, low, high)."""
    points = rows.select("junction_key", "chr_a", "pos_a").distinct()
    met = ranges.points_in_intervals(points, repeats, ["chr_a"], "pos_a", "low", "high", 1000)
    sums = met.groupBy("chr_a", "low", "high").agg(F.count_distinct("junction_key").alias("k")).where(F.col("k") > most)
    return met.join(sums.drop("k"), ["chr_a", "low", "high"], "left_semi").select("junction_key", "low", "high")


def facing_ends(rows: DataFrame, longest: int = 2_000_000) -> DataFrame:
    """Genomic segments: for each end that keeps its right side, the next end to the right on the contig that keeps its left side, if it is near enough.

    Ends of the same genome only; of equally near ones the first key. (genome_id, chr, start_pos, end_pos, key_l, key_r). The nearest is found from
    the next opposite end within shards of the axis and from each shard's first one.
    """
    ends = rows.select("genome_id", "junction_key", F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.col(f"dir_{e}").alias("dir")) for e in "ab"]))).where("dir is not null")
    # Mirrored, the next end to the right is the last one before.
    right = ends.where("dir = 1").groupBy("genome_id", "chr", "pos").agg(F.min("junction_key").alias("k"))
    events = right.select("genome_id", "chr", (-F.col("pos")).alias("at"), F.struct("pos", "k").alias("r"))
    left = ends.where("dir = -1").select("genome_id", "chr", F.col("pos").alias("start_pos"), F.col("junction_key").alias("key_l"), (-F.col("pos") - 1).alias("back"))
    found = ranges.last_before(left, events, ["genome_id", "chr"], "back", "at", "r")
    return found.where(F.col("r.pos") - F.col("start_pos") <= longest).select("genome_id", "chr", "start_pos", F.col("r.pos").alias("end_pos"), "key_l", F.col("r.k").alias("key_r"))


def reference_adjacent(rows: DataFrame, longest: int = 1_000_000) -> DataFrame:
    """Neighbouring ends of a genome's contig that face away from each other with balanced support, so the stretch between them joins what they cut."""
    ends = rows.select("genome_id", "supp", F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.col(f"dir_{e}").alias("dir")) for e in "ab"]))).where("dir is not null and supp is not null")
    places = ends.groupBy("genome_id", "chr", "pos", "dir").agg(F.sum("supp").alias("supp"))
    plus = places.where("dir = 1").select("genome_id", "chr", F.col("pos").alias("at"), F.struct("pos", "supp").alias("p"))
    minus = places.where("dir = -1").select("genome_id", "chr", F.col("pos").alias("minus_pos"), F.col("supp").alias("minus_supp"), (F.col("pos") - 1).alias("before"))
    found = ranges.last_before(minus, plus, ["genome_id", "chr"], "before", "at", "p").where("p is not null")
    balanced = F.abs(F.col("p.supp") - F.col("minus_supp")) <= F.least("p.supp", "minus_supp")
    return found.where(balanced & (F.col("minus_pos") - F.col("p.pos") <= longest)).select("genome_id", "chr", F.col("p.pos").alias("plus_pos"), "minus_pos")


def component_table(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Per component with more than one junction: junctions, counts by orientation, genomes, rank and whether it is complex or simple.

    Simple ones have only deletions, insertions and inversions, none more often than 1.5 times its nodes; their rank is 4, that of others the rows + 2.
    """
    of = edges.join(parts.withColumnRenamed("node", "src"), "src")
    plain = F.col("vcf_sv_type").isin("DEL", "INS", "INV")
    sums = of.groupBy("component").agg(
        F.count_distinct("junction_key").alias("n_junctions"), F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set("genome_id")), ",").alias("genomes"),
        F.count_if(~F.coalesce(plain, F.lit(False))).alias("other"),
    )
    nodes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    both = sums.where("n_junctions > 1").join(nodes, "component")
    simple = (F.col("other") == 0) & (F.col("n_rows") <= 1.5 * F.col("n_nodes"))
    return both.select("component", "n_junctions", "n_nodes", "genomes", F.when(simple, "simple").otherwise("complex").alias("kind"), F.when(simple, F.lit(4).cast("long")).otherwise(F.col("n_rows") + 2).alias("rank"))


def _directed(rows: DataFrame, *more: str) -> DataFrame:
    """Both ends of junctions as rows (chr, pos, dir)."""
    return rows.select("genome_id", "junction_key", *more, F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.col(f"dir_{e}").alias("dir"), F.col(f"hp{i}").alias("hp"), F.col(f"phaseset{i}").alias("ps")) for i, e in ((1, "a"), (2, "b"))]))).where("dir is not null")


def neighbour_segments(rows: DataFrame, contigs: DataFrame, longest: int = 2_000_000, flank: int = 10_000) -> DataFrame:
    """For each end that keeps its right side, where the segment that begins there ends: (genome_id, junction_key, chr, start_pos, end_pos, level).

    Level 1: the nearest facing end whose junction shares a supporting read. Level 2: else the nearest facing end that isn't on the other haplotype of the same phase set and
    whose support differs by less than the smaller one. Level 3: else longest away, but flank before the contig's end at most.
    Ends of the same genome only, no farther than longest; a junction's own ends count too. Rows without support can't be reached on level 2.
    """
    left = _directed(rows, "supp", "supp_read_ids").where("dir = -1")
    right = _directed(rows, "supp", "supp_read_ids").where("dir = 1")
    own = left.select("genome_id", "junction_key", "chr", F.col("pos").alias("start_pos")).distinct()
    key = ["genome_id", "junction_key", "chr", "start_pos"]

    far = right.select("genome_id", "chr", F.col("pos").alias("r_pos"), F.explode("supp_read_ids").alias("read")).distinct()
    reads = left.select(*key[:3], F.col("pos").alias("start_pos"), F.explode("supp_read_ids").alias("read")).distinct()
    first = reads.join(far, ["genome_id", "chr", "read"]).where(F.col("r_pos").between(F.col("start_pos") + 1, F.col("start_pos") + longest))
    first = first.groupBy(*key).agg(F.min("r_pos").alias("end_1"))

    a = left.select(*key[:3], F.col("pos").alias("start_pos"), F.col("hp").alias("a_hp"), F.col("ps").alias("a_ps"), F.col("supp").alias("a_supp"))
    b = right.select("genome_id", "chr", F.col("pos").alias("r_pos"), F.col("hp").alias("b_hp"), F.col("ps").alias("b_ps"), F.col("supp").alias("b_supp"))
    met = ranges.near_pairs(a, b, ["genome_id", "chr"], "start_pos", "r_pos", longest).where("r_pos > start_pos")
    apart = F.coalesce((F.col("a_ps") == F.col("b_ps")) & (F.col("a_hp") > 0) & (F.col("b_hp") > 0) & (F.col("a_hp") != F.col("b_hp")), F.lit(False))
    second = met.where(~apart & (F.abs(F.col("a_supp") - F.col("b_supp")) < F.least("a_supp", "b_supp"))).groupBy(*key).agg(F.min("r_pos").alias("end_2"))

    ends = own.join(first, key, "left").join(second, key, "left").join(contigs.select(F.col("ref_id").alias("chr"), "length"), "chr")
    last = F.greatest(F.least(F.col("start_pos") + longest, F.col("length") - flank), F.col("start_pos"))
    level = F.when(F.col("end_1").isNotNull(), 1).when(F.col("end_2").isNotNull(), 2).otherwise(3)
    return ends.select(*key, F.coalesce("end_1", "end_2", last).alias("end_pos"), level.alias("level"))


def spanning_share(rows: DataFrame, spanning: DataFrame) -> DataFrame:
    """Reference reads and share of support from the segments that span a junction's ends: (junction_key, genome_id, dv, dr, vaf).

    dr is the whole mean of both ends' segments, or for an insertion those of its place less its support, at least 0. spanning: position_coverage.
    """
    sums = spanning.select("ref_id", "position", "genome_id", (F.col("h0") + F.col("h1") + F.col("h2")).alias("n"))
    dv = rows.where("is_pass <> 'FAIL_MERGED_HP'").groupBy("junction_key", "genome_id", "chr_a", "pos_a", "chr_b", "pos_b").agg(F.coalesce(F.sum("supp"), F.lit(0)).alias("dv"))
    for e in "ab":
        dv = dv.join(sums.select(F.col("ref_id").alias(f"chr_{e}"), F.col("position").alias(f"pos_{e}"), "genome_id", F.col("n").alias(f"n_{e}")), [f"chr_{e}", f"pos_{e}", "genome_id"], "left")
    na, nb = (F.coalesce(f"n_{e}", F.lit(0)) for e in "ab")
    dr = F.when(F.col("pos_b").isNull(), F.greatest(na - F.col("dv"), F.lit(0))).otherwise(F.floor((na + nb) / 2))
    both = dv.withColumn("dr", dr)
    return both.select("junction_key", "genome_id", "dv", "dr", F.when(F.col("dv") + F.col("dr") > 0, F.col("dv") / (F.col("dv") + F.col("dr"))).alias("vaf"))


def lone_clusters(clusters: DataFrame, rows: DataFrame, within: int = 100) -> DataFrame:
    """End clusters (chr, position, ...) with no junction end nearer than within."""
    known = _directed(rows).select("chr", "pos").distinct().withColumns({"low": F.col("pos") - (within - 1), "high": F.col("pos") + (within - 1)}).drop("pos")
    return ranges.points_in_intervals(clusters, known, ["chr"], "position", "low", "high", 1000, "left_anti")


def shared_ends(rows: DataFrame) -> DataFrame:
    """Junctions of a genome that share an end, each with the next one by key, where their supports balance: (genome_id, chr, pos, key_x, key_y)."""
    ends = _directed(rows.where("supp is not null"), "supp").select("genome_id", "chr", "pos", "dir", "junction_key", "supp").distinct()
    order = Window.partitionBy("genome_id", "chr", "pos", "dir").orderBy("junction_key", "supp")
    both = ends.withColumn("y", F.lead(F.struct("junction_key", "supp")).over(order)).where("y is not null")
    return both.where(F.abs(F.col("supp") - F.col("y.supp")) < F.least("supp", "y.supp")).select("genome_id", "chr", "pos", F.col("junction_key").alias("key_x"), F.col("y.junction_key").alias("key_y"))


def final_calls(rows: DataFrame) -> DataFrame:
    """Passed junctions with passed share and a quality, in the sets all and, if somatic, somatic as well; one-sided ones need a share of 0.25 and a quality above 55."""
    good = rows.where("is_pass = 'PASS' and vcf_qual > 0 and ((not is_single and vaf_pass = 'PASS') or (is_single and vaf >= 0.25 and vcf_qual > 55))")
    return good.select("junction_key", "genome_id", F.explode(F.when(F.col("mut_type") == "somatic", F.array(F.lit("all"), F.lit("somatic"))).otherwise(F.array(F.lit("all")))).alias("set"))


def genome_sets(rows: DataFrame) -> DataFrame:
    """Junctions by the set of genomes that carry them."""
    sets = rows.groupBy("junction_key").agg(F.array_join(F.array_sort(F.collect_set("genome_id")), ",").alias("genomes"))
    return sets.groupBy("genomes").agg(F.count(F.lit(1)).alias("n_junctions"))


def cluster_rows(edges: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per junction of a component with more than one: its component, ends' orientation, support and genomes."""
    of = edges.join(parts.withColumnRenamed("node", "src"), "src").select("junction_key", "component").distinct()
    several = of.groupBy("component").agg(F.count_distinct("junction_key").alias("k")).where("k > 1").select("component")
    own = rows.groupBy("junction_key").agg(
        F.max("chr_a").alias("chr_a"), F.max("chr_b").alias("chr_b"), F.max("dir_a").alias("dir_a"), F.max("dir_b").alias("dir_b"), F.sum("supp").alias("supp"), F.array_join(F.array_sort(F.collect_set("genome_id")), ",").alias("genomes")
    )
    turn = F.when(F.col("chr_a") != F.col("chr_b"), "Interchr").otherwise(F.concat(F.when(F.col("dir_a") > 0, "H").otherwise("T"), F.when(F.col("dir_b") > 0, "H").otherwise("T")))
    return of.join(several, "component", "left_semi").join(own, "junction_key").select("component", "junction_key", turn.alias("orientation"), "supp", "genomes")
