"""What speaks for and against junctions and insertions: spanning segments, checks of either side, control coverage, one-sided ends, and reads without a junction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import junction_key
from strandline.lineage import cut
from strandline.operators import hotkeys, islands, ranges, segments

KEY = ["node_a", "node_b"]
MORE = ("mapq", "mismatch_rate")


def connections(rows: DataFrame, gap: int = 50) -> DataFrame:
    """Connections with the places their two ends belong to (node_a, node_b): runs of ends of one direction, of either side, at most gap apart.

    Connections with a null in an end are left out. A place is named contig:direction:first position.
    """
    pairs = cut(segments.adjacent_pairs(rows, more=MORE))
    ends = pairs.select("seg_id", F.inline(F.array(*[F.struct(F.lit(e).alias("side"), F.col(f"chr_{e}").alias("chr"), F.col(f"dir_{e}").alias("dir"), F.col(f"pos_{e}").alias("pos")) for e in "ab"])))
    placed = islands.gap_clusters(ends, ["chr", "dir"], "pos", gap).withColumn("node", F.concat_ws(":", "chr", "dir", "cluster"))
    nodes = placed.groupBy("seg_id").agg(*[F.max(F.when(F.col("side") == e, F.col("node"))).alias(f"node_{e}") for e in "ab"]).dropna()
    return cut(pairs.join(nodes.hint("merge"), "seg_id"))


def places(conns: DataFrame, least: int = 2) -> DataFrame:
    """Per place of at least least ends, one of them passed: (node, chr, dir, position, qual, n, n_passed, first_contigs).

    position and qual are whole medians of passed ends and their mapq; first_contigs counts the contigs of the first ends of connections that pass there.
    """
    end = lambda e: F.struct(*[F.col(f"{c}_{e}").alias(c) for c in ("node", "chr", "dir", "pos", "passed", "mapq")], F.col("chr_a").alias("first"))
    ends = conns.select(F.inline(F.array(end("a"), end("b"))))
    passed = lambda c: F.when(F.col("passed"), F.col(c))
    by = ends.groupBy("node", "chr", "dir").agg(
        F.floor(F.median(passed("pos"))).alias("position"), F.floor(F.median(passed("mapq"))).alias("qual"), F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.count_distinct(passed("first")).alias("first_contigs"),
    )
    return by.where((F.col("n") >= least) & F.col("position").isNotNull())


def spanning_slots(positions: DataFrame, rows: DataFrame, min_mapq: int = 10, near: int = 50) -> DataFrame:
    """Segments at each position by genome: (ref_id, position, genome_id, h0, h1, h2, ends, starts, others).

    h0 to h2 count primary segments of mapq above min_mapq by haplotype that hold the position strictly inside; others counts segments that aren't primary and
    touch it, starts those of them that begin at most near before it, ends those of the rest that end at most near after it. Positions without segments have no row.
    """
    at = positions.select("ref_id", "position").dropna().distinct()
    spans = rows.where(segments.IS_SPLIT).select("ref_id", "genome_id", F.coalesce("haplotype", F.lit(0)).alias("hp"), F.coalesce("is_primary", F.lit(False)).alias("prime"), "mapq", F.col("ref_start").alias("low"), F.col("ref_end").alias("high"))
    met = ranges.points_in_intervals(at, spans.where(f"not prime or mapq > {min_mapq}"), ["ref_id"], "position", "low", "high", 10_000)
    inside = F.col("prime") & (F.col("position") > F.col("low")) & (F.col("position") < F.col("high"))
    begins, stops = F.col("position") - F.col("low") <= near, F.col("high") - F.col("position") <= near
    other = ~F.col("prime")
    return met.groupBy("ref_id", "position", "genome_id").agg(
        *[F.count_if(inside & (F.col("hp") == h)).alias(f"h{h}") for h in range(3)], F.count_if(other & ~begins & stops).alias("ends"), F.count_if(other & begins).alias("starts"), F.count_if(other).alias("others"),
    )


def detected(conns: DataFrame, spots: DataFrame) -> DataFrame:
    """Junctions as pairs of places: (node_a, node_b, genome_id, hp_a, hp_b, supp), supp being distinct reads; both places are in spots, not equal, and some connection passed."""
    known = spots.select("node")
    both = conns.join(known.withColumnRenamed("node", "node_a"), "node_a", "left_semi").join(known.withColumnRenamed("node", "node_b"), "node_b", "left_semi").where("node_a <> node_b")
    passed = both.groupBy(*KEY).agg(F.max("passed").alias("some")).where("some").select(*KEY)
    return both.join(passed, KEY, "left_semi").groupBy(*KEY, "genome_id", "hp_a", "hp_b").agg(F.count_distinct("read_id").alias("supp"))


def _control_depth(keys: DataFrame, slots: DataFrame, is_control: Column, sides: str) -> DataFrame:
    """Adds for each side how many control segments of the key's haplotypes (of all if it is only on 0) span it: low_control is whether all have at most most."""
    spans = slots.where(is_control).groupBy("ref_id", "position").agg(*[F.sum(f"h{h}").alias(f"h{h}") for h in range(3)])
    for e in sides:
        own = spans.select(F.col("ref_id").alias(f"chr_{e}"), F.col("position").alias(f"position_{e}"), *[F.col(f"h{h}").alias(f"_h{h}") for h in range(3)])
        keys = keys.join(own, [f"chr_{e}", f"position_{e}"], "left")
        wanted = lambda h, e=e: F.array_contains(f"haps_{e}", h) | (F.array_max(f"haps_{e}") == 0)
        depth = sum((F.when(wanted(h), F.coalesce(f"_h{h}", F.lit(0))).otherwise(0) for h in range(3)), F.lit(0))
        keys = keys.withColumn(f"control_{e}", depth).drop("_h0", "_h1", "_h2")
    return keys


def junction_checks(conns: DataFrame, rows: DataFrame, is_control: Column, most_control: int = 3, min_insertion: int = 50) -> DataFrame:
    """One row per detected junction with what each side fails by, what becomes of it, and the length of a sequence in between.

    A side fails with the first rule that applies: FAIL_MAP_CONS if the ends are out of order on a contig; FAIL_SEC_CONS if segments that aren't primary and end there
    number 0.3 of the support or more, at least 2; FAIL_MAP_CONS if less than half of its connections pass there or the junction's median quality is below 30;
    FAIL_CONN_CONS if the support is below 0.3 of the connections that pass there, or these come from more than two contigs. A junction of which one side fails goes
    on as the one-sided end of the other (single); if both fail, sides with FAIL_CONN_CONS and a quality of 55 or more do, and label is side a's failure unless side b does.
    If none fails, inserted is the whole median of what connections leave of the read, if it is at least min_insertion and varies little. Junctions with two good
    sides that no control carries get FAIL_LOWCOV_NORMAL if at most most_control control segments span either end.
    """
    spots = cut(places(conns))
    found = cut(detected(conns, spots))
    control = F.max(is_control)
    by = found.groupBy(*KEY).agg(F.sum("supp").alias("supp"), control.alias("in_control"), F.collect_set("genome_id").alias("genomes"), *[F.array_sort(F.collect_set(F.coalesce(f"hp_{e}", F.lit(0)))).alias(f"haps_{e}") for e in "ab"])
    for e in "ab":
        by = by.join(spots.select(F.col("node").alias(f"node_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in ("chr", "dir", "position", "qual", "n", "n_passed", "first_contigs")]), f"node_{e}")
    by = cut(by)
    slots = cut(spanning_slots(by.select(F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("ref_id"), F.col(f"position_{e}").alias("position")) for e in "ab"]))), rows))
    other = slots.select(F.col("ref_id").alias("r"), F.col("position").alias("p"), "genome_id", "ends", "starts")
    checked = by
    for e in "ab":
        met = by.select(*KEY, F.explode("genomes").alias("genome_id"), F.col(f"chr_{e}").alias("r"), F.col(f"position_{e}").alias("p"), F.col(f"dir_{e}").alias("d")).join(other, ["r", "p", "genome_id"])
        checked = checked.join(met.groupBy(*KEY).agg(F.sum(F.when(F.col("d") == 1, F.col("ends")).otherwise(F.col("starts"))).alias(f"sec_{e}")), KEY, "left")
    both = conns.join(by.select(*KEY), KEY, "left_semi").where("passed").groupBy(*KEY).agg(F.floor(F.median("gap")).alias("inserted"), F.stddev_pop("gap").alias("varies"))
    checked = checked.join(both, KEY, "left").withColumn("quality", (F.col("qual_a") + F.col("qual_b")) / 2)

    def fails(e: str) -> Column:
        out_of_order = (F.col("chr_a") == F.col("chr_b")) & (F.col("position_a") > F.col("position_b"))
        secondary = F.coalesce(f"sec_{e}", F.lit(0)) >= F.greatest(0.3 * F.col("supp"), F.lit(2.0))
        poor = (F.col(f"n_passed_{e}") < 0.5 * F.col(f"n_{e}")) | (F.col("quality") < 30)
        scattered = (F.col("supp") < 0.3 * F.col(f"n_passed_{e}")) | (F.col(f"first_contigs_{e}") > 2)
        return F.when(out_of_order, "FAIL_MAP_CONS").when(secondary, "FAIL_SEC_CONS").when(poor, "FAIL_MAP_CONS").when(scattered, "FAIL_CONN_CONS")

    checked = checked.withColumns({"fail_a": fails("a"), "fail_b": fails("b")})
    fine_a, fine_b = F.col("fail_a").isNull(), F.col("fail_b").isNull()
    alone = lambda e: (F.col(f"fail_{e}") == "FAIL_CONN_CONS") & (F.col(f"qual_{e}") >= 55)
    none = ~fine_a & ~fine_b
    keeps_a, keeps_b = (fine_a & ~fine_b) | (none & alone("a")), (fine_b & ~fine_a) | (none & alone("b"))
    single = F.concat(F.when(keeps_a, "a").otherwise(""), F.when(keeps_b, "b").otherwise(""))
    checked = _control_depth(checked, slots, is_control, "ab").withColumn("single", single)
    low = (F.col("single") == "") & ~F.col("in_control") & (F.col("control_a") <= most_control) & (F.col("control_b") <= most_control)
    label = F.when(low, "FAIL_LOWCOV_NORMAL").when(none & ~alone("b"), F.col("fail_a")).otherwise("PASS")
    has_ins = F.when(fine_a & fine_b & (F.col("inserted") >= min_insertion) & (F.col("varies") < 25), F.col("inserted"))
    return checked.select(*[f"{c}_{e}" for e in "ab" for c in ("chr", "dir", "position")], "supp", "fail_a", "fail_b", "single", has_ins.alias("inserted"), label.alias("label"), "in_control", "haps_a", "haps_b", "control_a", "control_b", "qual_a", "qual_b")


def one_sided(checks: DataFrame, most_control: int = 3) -> DataFrame:
    """The good ends of junctions that failed on the other side: (chr, dir, position, other, supp, label), other naming the lost end.

    label is FAIL_LOWCOV_NORMAL if no control carries the junction and at most most_control control segments span the end.
    """
    sides = []
    for e, o in ("ab", "ba"):
        name = F.concat(F.when(F.col(f"dir_{o}") > 0, "+").otherwise("-"), F.col(f"chr_{o}"), F.lit(":"), F.col(f"position_{o}"))
        low = ~F.col("in_control") & (F.col(f"control_{e}") <= most_control)
        own = checks.where(F.contains("single", F.lit(e)))
        sides.append(own.select(F.col(f"chr_{e}").alias("chr"), F.col(f"dir_{e}").alias("dir"), F.col(f"position_{e}").alias("position"), name.alias("other"), "supp", F.when(low, "FAIL_LOWCOV_NORMAL").otherwise("PASS").alias("label")))
    return sides[0].unionByName(sides[1])


def insertion_checks(rows: DataFrame, is_control: Column, gap: int = 1000, most_control: int = 3) -> DataFrame:
    """(ref_id, position, length, supp, label) of clusters of insertions by place and length with a passed one.

    FAIL_SEC_CONS if segments there that aren't primary number 1.5 times the support and the primary ones of haplotypes 0 and 1 or more; FAIL_MAP_CONS if less than half
    of the insertions passed or their median mapq is below 30; FAIL_LOWCOV_NORMAL if no control carries it and at most most_control control segments span it.
    """
    ins = rows.where("is_insertion and segment_length is not null").select("genome_id", "read_id", "haplotype", "ref_id", "ref_end", "segment_length", "mapq", F.coalesce(F.col("is_pass") == "PASS", F.lit(False)).alias("passed"))
    placed = islands.gap_clusters(ins, ["ref_id"], "ref_end", gap)
    sized = cut(islands.value_clusters(placed, ["ref_id", "cluster"], "segment_length", F.greatest(F.lit(50.0), 0.25 * F.col("_before"))))
    own = lambda c: F.when(F.col("passed"), F.col(c))
    by = cut(sized.groupBy("ref_id", "cluster", "level").agg(
        F.floor(F.median(own("ref_end"))).alias("position"), F.floor(F.median(own("segment_length"))).alias("length"), F.count_distinct(F.when(F.col("passed"), F.struct("genome_id", "read_id"))).alias("supp"), F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("n_passed"), F.median(own("mapq")).alias("quality"), F.collect_set("genome_id").alias("genomes"), F.max(is_control).alias("in_control"), F.array_sort(F.collect_set(F.coalesce("haplotype", F.lit(0)))).alias("haps_a"),
    ).where("n_passed > 0"))
    slots = cut(spanning_slots(by.select("ref_id", "position"), rows))
    key = ["ref_id", "cluster", "level"]
    met = by.select(*key, "position", F.explode("genomes").alias("genome_id")).join(slots, ["ref_id", "position", "genome_id"])
    sums = met.groupBy(*key).agg(F.sum("others").alias("sec"), F.sum(F.col("h0") + F.col("h1")).alias("prime"))
    full = by.join(sums, key, "left").fillna(0, ["sec", "prime"]).withColumnsRenamed({"ref_id": "chr_a", "position": "position_a"})
    full = _control_depth(full, slots, is_control, "a")
    label = (
        F.when(~F.col("in_control") & (F.col("control_a") <= most_control), "FAIL_LOWCOV_NORMAL").when(F.col("sec") >= 1.5 * (F.col("prime") + F.col("supp")), "FAIL_SEC_CONS")
        .when((F.col("n_passed") < 0.5 * F.col("n")) | (F.col("quality") < 30), "FAIL_MAP_CONS").otherwise("PASS")
    )
    return full.select(F.col("chr_a").alias("ref_id"), F.col("position_a").alias("position"), "length", "supp", label.alias("label"))


# Reads without a junction.


def simple_reads(rows: DataFrame) -> DataFrame:
    """Reads that are one primary split segment and no insertion: (genome_id, read_id, haplotype, ref_id, ref_start, ref_end, read_length, align_len, mapq, mismatch_rate)."""
    one = F.count_if(F.expr(segments.IS_SPLIT)).alias("n"), F.count_if("is_insertion").alias("i")
    seg = F.struct("haplotype", "ref_id", "ref_start", "ref_end", "read_length", "align_len", "mapq", "mismatch_rate", "is_primary")
    by = rows.groupBy(*segments.READ).agg(*one, F.min(F.when(F.expr(segments.IS_SPLIT), seg)).alias("s")).where("n = 1 and i = 0 and s.is_primary")
    return by.select(*segments.READ, "s.*").drop("is_primary")


def length_nx(lengths: DataFrame, key: str, length: str, shares: list[str]) -> DataFrame:
    """(key, share, value): the smallest length such that those up to it hold share of all bases of the key; "0.1" gives N90."""
    weighted = hotkeys.compress(lengths.where(F.col(length) > 0), key, length).withColumn("n", F.col("n") * F.col("value"))
    return hotkeys.key_percentiles(weighted, shares)


def good_simple_reads(reads: DataFrame, background: DataFrame, n90: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Simple reads with good, whether they count for coverage: mapq above min_mapq, mismatches below the genome's background, longer than its N90, aligned for more than half."""
    limits = reads.join(background, "genome_id", "left").join(n90.select(F.col("key").alias("genome_id"), F.col("value").alias("n90")), "genome_id", "left")
    good = (F.col("mapq") > min_mapq) & (F.col("mismatch_rate") < F.col("background")) & (F.col("read_length") > F.col("n90")) & (F.abs(F.col("read_length") - F.col("align_len")) < F.col("align_len"))
    return limits.withColumn("good", F.coalesce(good, F.lit(False))).drop("background", "n90")


def simple_coverage(good: DataFrame) -> DataFrame:
    """How many good simple reads touch each bin: (genome_id, haplotype, ref_id, bin, n)."""
    touched = segments.bins(good.where("good"), F.floor(F.col("ref_start") / segments.BIN), F.floor(F.col("ref_end") / segments.BIN))
    return touched.groupBy("genome_id", "haplotype", "ref_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def read_statistics(rows: DataFrame) -> DataFrame:
    """Per genome: reads, their bases, aligned bases, N50 and N90 of reads and alignments, and quartiles of error and mismatch rates of split segments."""
    split = rows.where(segments.IS_SPLIT)
    reads = rows.where("read_length > 0").groupBy(*segments.READ).agg(F.max("read_length").alias("l"))
    out = reads.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("l").alias("bases"))
    for lengths, name in ((reads, "read"), (split.select("genome_id", F.col("segment_length").alias("l")), "alignment")):
        nx = length_nx(lengths, "genome_id", "l", ["0.5", "0.1"]).groupBy(F.col("key").alias("genome_id"))
        out = out.join(nx.agg(F.max(F.when(F.col("share") > 0.3, F.col("value"))).alias(f"{name}_n50"), F.max(F.when(F.col("share") < 0.3, F.col("value"))).alias(f"{name}_n90")), "genome_id")
    quartiles = [F.round(F.percentile(F.when(F.col(c).between(0, 999), F.col(c)), i / 4), 6).alias(f"{n}_q{i}") for c, n in (("error_rate", "error"), ("mismatch_rate", "mismatch")) for i in (1, 2, 3)]
    return out.join(split.groupBy("genome_id").agg(F.sum("segment_length").alias("aligned"), *quartiles), "genome_id")


# Repeats. intervals: (ref_id, low, high).


def in_repeat_only(rows: DataFrame, intervals: DataFrame, pad: int = 25, share: float = 0.95) -> DataFrame:
    """(seg_id, low, high) of split segments that lie in exactly one padded interval and are longer than share of it."""
    own = rows.where(segments.IS_SPLIT).select("seg_id", "ref_id", "ref_start", "ref_end", "segment_length")
    padded = intervals.select("ref_id", (F.col("low") - pad).alias("pad_low"), (F.col("high") + pad).alias("pad_high"), "low", "high").distinct()
    met = ranges.in_exactly_one(own, padded, ["ref_id"], ["seg_id"], "ref_start", "pad_low", "pad_high", 1000)
    return met.where((F.col("ref_end") <= F.col("pad_high")) & (F.col("segment_length") > share * (F.col("high") - F.col("low")))).select("seg_id", "low", "high")


def spanned_repeats(rows: DataFrame, intervals: DataFrame, beyond: int = 500) -> DataFrame:
    """(ref_id, low, high, n_reads): how many reads have a segment that reaches more than beyond to both sides of an interval; intervals without one have 0."""
    spots = intervals.select("ref_id", "low", "high").distinct()
    wide = rows.where("not is_clipped").select("ref_id", "genome_id", "read_id", (F.col("ref_start") + beyond + 1).alias("_from"), (F.col("ref_end") - beyond - 1).alias("_to"))
    met = ranges.points_in_intervals(spots, wide, ["ref_id"], "low", "_from", "_to", 10_000).where("high <= _to")
    counts = met.groupBy("ref_id", "low", "high").agg(F.count_distinct(F.struct("genome_id", "read_id")).alias("n_reads"))
    return spots.join(counts, ["ref_id", "low", "high"], "left").fillna(0, ["n_reads"])


# Fragments.


def standard_places(ends: DataFrame, width: int = 50) -> DataFrame:
    """(ref_id, place, standard) of the distinct ends (ref_id, place): standard is the first center of a cluster of ends (anchored_clusters) at most width away, the end itself without one."""
    centers = islands.anchored_clusters(ends, ["ref_id"], "place", width).select("ref_id", "center").distinct()
    spots = ends.select("ref_id", "place").dropna().distinct()
    met = ranges.near_pairs(spots, centers, ["ref_id"], "place", "center", width).groupBy("ref_id", "place").agg(F.min("center").alias("center"))
    return spots.join(met, ["ref_id", "place"], "left").select("ref_id", "place", F.coalesce("center", "place").alias("standard"))


def named_fragments(rows: DataFrame, least: int = 1) -> DataFrame:
    """(ref_id, left_place, right_place, n, number) of fragments between standard places that occur least times; number is the rank by n, ties share it.

    rows: (ref_id, ref_start, ref_end). Ranks come from how many fragments have each n, so no window holds all fragments.
    """
    known = cut(rows.select("ref_id", "ref_start", "ref_end").dropna())
    spots = cut(standard_places(known.select("ref_id", F.explode(F.array("ref_start", "ref_end")).alias("place"))))
    side = lambda old, new: spots.select("ref_id", F.col("place").alias(old), F.col("standard").alias(new))
    full = known.join(side("ref_start", "left_place").hint("merge"), ["ref_id", "ref_start"]).join(side("ref_end", "right_place").hint("merge"), ["ref_id", "ref_end"])
    counts = cut(full.groupBy("ref_id", "left_place", "right_place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    more = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(sizes.select("n", (more + 1).alias("number")), "n").select("ref_id", "left_place", "right_place", "n", "number")


# Junctions of the reads themselves, in the columns of a junction table.


def as_junctions(rows: DataFrame) -> DataFrame:
    """Junctions and insertions that the segments show, a row per key, genome and haplotypes, in the columns of junctions.with_ends.

    Pairs of places of connections (detected) are typed by their directions; clusters of insertions by place and length with a passed one are INS. All
    have passed and none has a repeat, phase set or quality.
    """
    conns = connections(rows)
    spots = cut(places(conns))
    at = lambda e: spots.select(F.col("node").alias(f"node_{e}"), *[F.col(c).alias(f"{t}_{e}") for c, t in (("chr", "chr"), ("dir", "dir"), ("position", "pos"))])
    pairs = detected(conns, spots).select(*KEY).distinct().join(at("a"), "node_a").join(at("b"), "node_b")
    named = pairs.select(*KEY, *[f"{c}_{e}" for e in "ab" for c in ("chr", "pos", "dir")])
    full = conns.select(*KEY, "genome_id", F.col("hp_a").alias("hp1"), F.col("hp_b").alias("hp2"), "read_id").join(named, KEY)
    kind = F.when(F.col("chr_a") != F.col("chr_b"), "BND").when(F.col("dir_a") == F.col("dir_b"), "INV").when(F.col("dir_a") == 1, "DEL").otherwise("DUP")
    key = junction_key(*[F.col(f"{c}_{e}") for e in "ab" for c in ("chr", "pos", "dir")])
    length = F.when(F.col("chr_a") == F.col("chr_b"), F.abs(F.col("pos_b") - F.col("pos_a")))
    two = full.select(key.alias("junction_key"), "genome_id", "hp1", "hp2", "read_id", kind.alias("vcf_sv_type"), length.alias("length"), *[f"{c}_{e}" for e in "ab" for c in ("chr", "pos", "dir")])

    ins = rows.where("is_insertion and segment_length is not null").select("genome_id", "read_id", "haplotype", "ref_id", "ref_end", "segment_length", F.coalesce(F.col("is_pass") == "PASS", F.lit(False)).alias("passed"))
    sized = cut(islands.value_clusters(islands.gap_clusters(ins, ["ref_id"], "ref_end", 1000), ["ref_id", "cluster"], "segment_length", F.greatest(F.lit(50.0), 0.25 * F.col("_before"))))
    group = ["ref_id", "cluster", "level"]
    spot = sized.where("passed").groupBy(*group).agg(F.floor(F.median("ref_end")).alias("pos_a"), F.floor(F.median("segment_length")).alias("length"))
    one = sized.join(spot, group).select(
        F.concat(F.col("ref_id"), F.lit(":"), F.col("pos_a"), F.lit("|INS:"), F.col("length")).alias("junction_key"), "genome_id", F.col("haplotype").alias("hp1"), F.col("haplotype").alias("hp2"), "read_id",
        F.lit("INS").alias("vcf_sv_type"), "length", F.col("ref_id").alias("chr_a"), "pos_a", *[F.lit(None).cast(k).alias(c) for c, k in (("dir_a", "int"), ("chr_b", "string"), ("pos_b", "long"), ("dir_b", "int"))],
    )
    every = two.unionByName(one)
    by = every.groupBy(*[c for c in every.columns if c != "read_id"]).agg(F.count_distinct("read_id").alias("supp"), F.array_sort(F.collect_set("read_id")).alias("supp_read_ids"))
    empty = {"sv_type": "string", "phaseset1": "long", "phaseset2": "long", "vntr": "struct<vntr_start:bigint,vntr_end:bigint>", "gr_id": "string"}
    return by.withColumns({c: F.lit(None).cast(k) for c, k in empty.items()} | {"is_pass": F.lit("PASS"), "is_single": F.lit(False), "is_dup": F.col("vcf_sv_type") == "DUP", "size": F.when(F.col("vcf_sv_type") == "INS", F.col("length"))})


def lone_ends(conns: DataFrame, contigs: DataFrame, min_support: int = 3, share: float = 0.4, near: int = 100, flank: int = 10_000, one_sided: float = 0.67, most_partners: int = 7) -> DataFrame:
    """(chr, dir, position, n, n_passed, supp) of places whose connections lead to no other place, mostly to none, or to more than most_partners, and that have enough support.

    A partner is a place that two or more connections lead to. Enough are min_support ends, of which min_support and share of all passed, and min_support distinct reads of one
    genome that passed (supp). Places nearer than near to one of a detected junction, or to flank from either end of the contig, are left out.
    """
    spots = cut(places(conns))
    joined = conns.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"))
    sides = joined.select(F.inline(F.array(F.struct(F.col("node_a").alias("node"), F.col("node_b").alias("to"), "m"), F.struct(F.col("node_b").alias("node"), F.col("node_a").alias("to"), "m"))))
    sides = sides.join(spots.select(F.col("node").alias("to"), F.lit(True).alias("known")), "to", "left")
    paired = F.col("known") & (F.col("m") >= 2)
    by = sides.groupBy("node").agg(F.sum("m").alias("all"), F.coalesce(F.sum(F.when(paired, F.col("m"))), F.lit(0)).alias("paired"), F.count_if(paired).alias("partners"))
    alone = (F.col("partners") == 0) | (F.col("all") - F.col("paired") > one_sided * F.col("all")) | (F.col("partners") > most_partners)
    end = lambda e: F.struct(F.col(f"node_{e}").alias("node"), F.col(f"passed_{e}").alias("ok"), "genome_id", "read_id")
    reads = conns.select(F.inline(F.array(end("a"), end("b")))).where("ok").groupBy("node", "genome_id").agg(F.count_distinct("read_id").alias("r")).groupBy("node").agg(F.max("r").alias("supp"))
    enough = (F.col("n") >= min_support) & (F.col("n_passed") >= F.greatest(F.lit(float(min_support)), share * F.col("n"))) & (F.col("supp") >= min_support)
    own = spots.join(by.where(alone).select("node"), "node", "left_semi").join(reads, "node").where(enough)
    used = detected(conns, spots).select(F.explode(F.array(*KEY)).alias("node")).distinct().join(spots, "node")
    taken = used.select("chr", F.col("position").alias("at")).unionByName(contigs.select(F.col("ref_id").alias("chr"), F.explode(F.array(F.lit(flank).cast("long"), F.col("length") - flank)).alias("at")))
    taken = taken.select("chr", (F.col("at") - (near - 1)).alias("low"), (F.col("at") + (near - 1)).alias("high")).distinct()
    return ranges.points_in_intervals(own.select("chr", "dir", "position", "n", "n_passed", "supp"), taken, ["chr"], "position", "low", "high", 1000, "left_anti")


def repeat_labels(rows: DataFrame, segs: DataFrame, pad: int = 25, most: int = 3) -> DataFrame:
    """(chr, low, high, n_junctions, n_reads, label) of the padded repeats that junctions lie in by their first end.

    n_reads counts their distinct supporting reads with a split segment that isn't vntr_only. FAIL_VNTR with fewer than two such reads, FAIL_COMPLEX_VNTR with more than most
    different junctions, MERGE with two or more, else PASS.
    """
    spots = rows.where("vntr is not null").select(F.col("chr_a").alias("chr"), (F.col("vntr.vntr_start") - pad).alias("low"), (F.col("vntr.vntr_end") + pad).alias("high")).distinct()
    met = cut(ranges.points_in_intervals(rows.select(F.col("chr_a").alias("chr"), "pos_a", "junction_key", "supp_read_ids"), spots, ["chr"], "pos_a", "low", "high", 1000))
    key = ["chr", "low", "high"]
    good = segs.where(segments.IS_SPLIT).where("is_pass is distinct from 'vntr_only'").select(F.col("read_id").alias("read")).distinct()
    reads = met.select(*key, F.explode("supp_read_ids").alias("read")).distinct().join(good, "read", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n_reads"))
    by = met.groupBy(*key).agg(F.count_distinct("junction_key").alias("n_junctions")).join(reads, key, "left").fillna(0, ["n_reads"])
    label = F.when(F.col("n_reads") < 2, "FAIL_VNTR").when(F.col("n_junctions") > most, "FAIL_COMPLEX_VNTR").when(F.col("n_junctions") > 1, "MERGE").otherwise("PASS")
    return by.select(*key, "n_junctions", "n_reads", label.alias("label"))


def moved_ends(conns: DataFrame, least: int = 50) -> DataFrame:
    """(chr_a, dir_a, position_a, chr_b, dir_b, position_b, overlap) of detected junctions whose segments overlap in the read by a median of least or more, after the end with the higher median of mismatches gave way by that much.

    Connections that don't overlap don't count for overlap; of equal mismatches the second end gives way.
    """
    spots = cut(places(conns))
    own = detected(conns, spots).select(*KEY).distinct()
    by = conns.join(own, KEY, "left_semi").groupBy(*KEY).agg(
        F.floor(F.median(F.when(F.col("gap") < 0, -F.col("gap")))).alias("overlap"), F.median("mismatch_rate_a").alias("mm_a"), F.median("mismatch_rate_b").alias("mm_b")
    ).where(F.col("overlap") >= least)
    for e in "ab":
        by = by.join(spots.select(F.col("node").alias(f"node_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in ("chr", "dir", "position")]), f"node_{e}")
    first = F.coalesce(F.col("mm_a") > F.col("mm_b"), F.lit(False))
    moved = lambda e, gives: (F.col(f"position_{e}") + F.when(gives, F.when(F.col(f"dir_{e}") == -1, F.col("overlap")).otherwise(-F.col("overlap"))).otherwise(0)).alias(f"position_{e}")
    return by.select("chr_a", "dir_a", moved("a", first), "chr_b", "dir_b", moved("b", ~first), "overlap")


def loss_regions(coverage: DataFrame, is_control: Column, most: int = 3, gap: int = 2000, least: int = 10_000) -> DataFrame:
    """(genome_id, ref_id, haplotype, start_pos, end_pos) of stretches of least or more in which one haplotype of a genome that is no control has at most most segments a bin and the other more.

    Bins are left out where the first control by name has at most most on haplotype 1 and more on 2. Gaps up to gap are bridged. coverage: that of coverage_histogram.
    """
    h = lambda n: F.coalesce(F.sum(F.when(F.col("haplotype") == n, F.col("n"))), F.lit(0))
    by = coverage.groupBy("genome_id", "ref_id", "bin").agg(h(1).alias("h1"), h(2).alias("h2"))
    chosen = coverage.where(is_control).agg(F.min("genome_id").alias("g"))
    tested = by.where(F.col("genome_id") == chosen.scalar()).where((F.col("h1") <= most) & (F.col("h2") > most)).select("ref_id", "bin")
    lost = by.where(~is_control).where((F.col("h1") <= most) != (F.col("h2") <= most)).join(tested, ["ref_id", "bin"], "left_anti").withColumn("haplotype", F.when(F.col("h1") <= most, 1).otherwise(2))
    runs = islands.cluster_counts(lost, ["genome_id", "ref_id", "haplotype"], "bin", gap // segments.BIN + 1)
    start, end = F.col("start_pos") * segments.BIN, (F.col("end_pos") + 1) * segments.BIN
    return runs.where(end - start >= least).select("genome_id", "ref_id", "haplotype", start.alias("start_pos"), end.alias("end_pos"))
