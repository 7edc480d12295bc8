"""Relations between junctions: foldbacks, neighbours along the axis, long insertions and the junctions they belong to, shared evidence, and components by orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.lineage import cut
from strandline.operators import islands, ranges


def ends_of(rows: DataFrame, *more: str) -> DataFrame:
    """Both ends of junctions as rows (chr, pos, dir, hp, ps) with genome_id, junction_key and further columns; ends without a direction are left out."""
    sides = [F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.col(f"dir_{e}").alias("dir"), F.col(f"hp{i}").alias("hp"), F.col(f"phaseset{i}").alias("ps")) for i, e in ((1, "a"), (2, "b"))]
    return rows.select("genome_id", "junction_key", *more, F.inline(F.array(*sides))).where("dir is not null")


def lone_foldbacks(rows: DataFrame, longest: int = 50_000, before: int = 5000) -> DataFrame:
    """(junction_key, dir) of same-direction junctions of a contig of at most longest that no junction of the other direction answers.

    None of the other direction begins from before ahead of the first end up to the second, and the next one to begin, if there are some on either side,
    ends longest or farther away. Junctions that are typed as something else are for the caller to leave out.
    """
    inv = rows.where("chr_a = chr_b and dir_a = dir_b and pos_b >= pos_a").select("junction_key", "chr_a", "pos_a", "pos_b", "dir_a").distinct()
    # Mirrored, the next one to begin is the last one before.
    other = inv.select("chr_a", (-F.col("dir_a")).alias("dir_a"), F.col("pos_a").alias("at"), (-F.col("pos_a")).alias("back"), F.col("pos_b").alias("far"))
    short = inv.where(F.col("pos_b") - F.col("pos_a") <= longest).withColumns({"low": F.col("pos_a") - before, "behind": F.col("pos_a") - before - 1, "ahead": -F.col("pos_b")})
    hit = ranges.points_in_intervals(other.select("chr_a", "dir_a", "at"), short.select("chr_a", "dir_a", "junction_key", "low", (F.col("pos_b") - 1).alias("high")), ["chr_a", "dir_a"], "at", "low", "high", longest)
    open_ = short.join(hit.select("junction_key").distinct(), "junction_key", "left_anti")
    # Of several that begin at one place the one that ends first counts.
    nexts = other.groupBy("chr_a", "dir_a", "back").agg(F.struct(F.min("far").alias("far")).alias("next"))
    found = ranges.last_before(open_, nexts, ["chr_a", "dir_a"], "ahead", "back", "next")
    found = ranges.last_before(found, other.select("chr_a", "dir_a", "at", F.col("at").alias("earlier")), ["chr_a", "dir_a"], "behind", "at", "earlier")
    lone = F.col("next").isNull() | F.col("earlier").isNull() | (F.abs(F.col("next.far") - F.col("pos_b")) >= longest)
    return found.where(lone).select("junction_key", F.col("dir_a").alias("dir"))


def neighbours(rows: DataFrame, contigs: DataFrame, longest: int = 2_000_000, flank: int = 10_000, reaches: tuple[int, ...] = (20_000, 200_000)) -> DataFrame:
    """The genomic segment at each end: (genome_id, junction_key, chr, dir, pos, other, level), other being where it ends.

    An end that keeps its right side (dir -1) looks to the right for the next end that keeps its left side, one with dir 1 to the left for the next with dir -1.
    Level 1: the nearest whose junction shares a supporting read. Level 2: else the nearest that isn't on the other haplotype of the same phase set and whose support
    differs by less than the smaller one. Level 3: else longest away, but flank before the contig's end at most. No end is farther than longest. Level 2 looks
    within growing reaches, each time only for ends that are still without one, so few far pairs are ever formed.
    """
    ends = cut(ends_of(rows, "supp", "supp_read_ids").withColumn("x", -F.col("dir") * F.col("pos")))
    key = ["genome_id", "junction_key", "chr", "dir", "pos"]
    own = ends.select(*key, "x").distinct()
    # Along x every end looks upwards; the ends it can meet have the other direction and are placed on the same axis.
    facing = ends.select("genome_id", "chr", (-F.col("dir")).alias("dir"), (-F.col("x")).alias("y"), F.col("hp").alias("b_hp"), F.col("ps").alias("b_ps"), F.col("supp").alias("b_supp"), F.col("supp_read_ids").alias("b_reads"))
    near = F.col("y").between(F.col("x") + 1, F.col("x") + longest)
    # Spread by the join's own columns, the rows are told apart without another shuffle.
    together = ["genome_id", "chr", "dir", "read"]
    by_read = facing.select("genome_id", "chr", "dir", "y", F.explode("b_reads").alias("read")).repartition(*together).distinct()
    first = ends.select(*key, "x", F.explode("supp_read_ids").alias("read")).repartition(*together).distinct().join(by_read, together).where(near)
    first = cut(first.groupBy(*key).agg(F.min("y").alias("y1")))
    apart = F.coalesce((F.col("ps") == F.col("b_ps")) & (F.col("hp") > 0) & (F.col("b_hp") > 0) & (F.col("hp") != F.col("b_hp")), F.lit(False))
    fits = near & ~apart & (F.abs(F.col("supp") - F.col("b_supp")) < F.least("supp", "b_supp"))
    left = cut(ends.join(first.select(*key), key, "left_anti").drop("supp_read_ids").distinct())
    second = None
    for reach in (*reaches, longest):
        met = ranges.near_pairs(left, facing.drop("b_reads").distinct(), ["genome_id", "chr", "dir"], "x", "y", reach).where(fits)
        found = cut(met.groupBy(*key).agg(F.min("y").alias("y2")))
        second = found if second is None else second.unionByName(found)
        left = left.join(found.select(*key), key, "left_anti")
    sized = own.join(first, key, "left").join(second, key, "left").join(contigs.select(F.col("ref_id").alias("chr"), "length"), "chr")
    limit = F.when(F.col("dir") == -1, F.least(F.col("x") + longest, F.col("length") - flank)).otherwise(F.least(F.col("x") + longest, F.lit(-flank)))
    end = F.coalesce("y1", "y2", F.greatest(limit, F.col("x")))
    level = F.when(F.col("y1").isNotNull(), 1).when(F.col("y2").isNotNull(), 2).otherwise(3)
    return sized.select(*key, (-F.col("dir") * end).alias("other"), level.alias("level"))


def long_insertions(rows: DataFrame, lengths: DataFrame, within: int = 2000, min_size: int = 50, share: float = 1.2, far: int = 100_000) -> DataFrame:
    """Insertions that are what a duplication or a translocation-like junction brings in: (junction_key, target, route).

    Of the junctions those of one contig with equal directions, and deletion-like ones shorter than far, take none. A known duplication takes (route dup) insertions
    between its ends, unless it is longer than share times the insertion. Any other takes insertions within of its first end (route a), or if there is none
    of its second (route b), that are long enough to reach the end and the 0.9-quantile of its supporting segments on the other end's contig. lengths: (junction_key, chr, q90).
    """
    ins = rows.where("pos_b is null and size is not null").groupBy("junction_key", F.col("chr_a").alias("chr")).agg(F.max("pos_a").alias("ins_pos"), F.max("size").alias("ins_size"))
    other = rows.where("pos_b is not null").groupBy("junction_key", "chr_a", "pos_a", "dir_a", "chr_b", "pos_b", "dir_b").agg(F.max("length").alias("length"), F.max(F.coalesce("is_dup", F.lit(False))).alias("known")).withColumnRenamed("junction_key", "target")
    intra = F.col("chr_a") == F.col("chr_b")
    takes = other.where(~F.coalesce(intra & (F.col("dir_a") == F.col("dir_b")), F.lit(False)) & ~F.coalesce(intra & (F.col("dir_a") > 0) & (F.col("dir_b") < 0) & (F.col("pos_b") - F.col("pos_a") < far), F.lit(False)))
    dups = takes.where("known and pos_b > pos_a").select(F.col("chr_a").alias("chr"), "target", F.col("pos_a").alias("low"), (F.col("pos_b") - 1).alias("high"), "length")
    inside = ranges.points_in_intervals(ins, dups, ["chr"], "ins_pos", "low", "high", 10_000).where(F.col("length") <= share * F.col("ins_size"))
    out = inside.select("junction_key", "target", F.lit("dup").alias("route"))
    rest = takes.where("not known")
    for e, o in ("ab", "ba"):
        own = rest.select("target", F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.col(f"chr_{o}").alias("_o"))
        own = own.join(lengths.select(F.col("junction_key").alias("target"), F.col("chr").alias("_o"), "q90"), ["target", "_o"], "left").drop("_o")
        # The window is half open.
        met = ranges.near_pairs(ins, own, ["chr"], "ins_pos", "pos", within).where(F.col("ins_pos") < F.col("pos") + within)
        enough = F.col("ins_size") + min_size
        found = cut(met.where((enough >= F.abs(F.col("ins_pos") - F.col("pos"))) & (enough >= F.coalesce("q90", F.lit(0)))).select("junction_key", "target", F.lit(e).alias("route")))
        out = out.unionByName(found)
        rest = rest.join(found.select("target").distinct(), "target", "left_anti")
    return out.distinct()


def moved_support(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Support of junctions that take insertions, by genome and first haplotype: (junction_key, genome_id, hp1, supp, reads), with the insertions' distinct reads added."""
    own = rows.join(routes.select(F.col("target").alias("junction_key")).distinct(), "junction_key", "left_semi").select("junction_key", "genome_id", "hp1", F.explode_outer("supp_read_ids").alias("read"))
    more = routes.select("junction_key", "target").distinct().join(rows.select("junction_key", "genome_id", "hp1", F.explode_outer("supp_read_ids").alias("read")), "junction_key").drop("junction_key").withColumnRenamed("target", "junction_key")
    by = own.unionByName(more).groupBy("junction_key", "genome_id", "hp1")
    return by.agg(F.count_distinct("read").alias("supp"), F.array_join(F.array_sort(F.collect_set("read")), ",").alias("reads"))


def shared_evidence(rows: DataFrame, within: int = 50) -> DataFrame:
    """(junction_key, side, n_reads): the distinct reads of all junctions whose ends lie in one run of ends of one direction, for runs that hold first and second ends."""
    side = lambda e: F.struct(F.lit(e).alias("side"), F.col(f"chr_{e}").alias("chr"), F.col(f"dir_{e}").alias("dir"), F.col(f"pos_{e}").alias("pos"))
    ends = rows.select("junction_key", "supp_read_ids", F.inline(F.array(side("a"), side("b")))).where("dir is not null")
    placed = cut(islands.gap_clusters(cut(ends), ["chr", "dir"], "pos", within))
    run = ["chr", "dir", "cluster"]
    mixed = placed.groupBy(*run).agg(F.min("side").alias("s"), F.max("side").alias("t")).where("s <> t").select(*run)
    reads = placed.select(*run, F.explode("supp_read_ids").alias("read")).groupBy(*run).agg(F.count_distinct("read").alias("n_reads"))
    return placed.select("junction_key", "side", *run).distinct().join(mixed, run).join(reads, run, "left").select("junction_key", "side", F.coalesce("n_reads", F.lit(0)).alias("n_reads"))


def orientation(chr_a: Column, dir_a: Column, chr_b: Column, dir_b: Column) -> Column:
    """HH, TT, TH or HT by the directions of the two ends, Interchr between contigs."""
    letter = lambda d: F.when(d > 0, "H").otherwise("T")
    return F.when(chr_a != chr_b, "Interchr").otherwise(F.concat(letter(dir_a), letter(dir_b)))


def chosen_sequences(junctions: DataFrame, alignments: DataFrame) -> DataFrame:
    """(junction_key, inserted): what a chosen read has between the two ends of its junction, from its primary alignment, in the direction the read was sequenced.

    junctions: (junction_key, read_id, read_from, read_to), places in the read as sequenced; alignments: those of a reader with query_sequence, which for reverse
    alignments is the reverse complement. The text is taken as the alignment has it; keys whose read has no primary alignment with a sequence have no row.
    """
    prime = alignments.where("not is_supplementary and not is_secondary and not is_unmapped and query_sequence is not null").select("read_id", "is_reverse", "query_sequence")
    size = F.length("query_sequence")
    start = F.when(F.col("is_reverse"), size - F.col("read_to")).otherwise(F.col("read_from"))
    return junctions.join(prime, "read_id").select("junction_key", F.substr("query_sequence", (start + 1).cast("int"), (F.col("read_to") - F.col("read_from")).cast("int")).alias("inserted"))


def component_orientations(edges: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    """(component, what, n_junctions) of components with more than one junction: how many of each orientation."""
    of = edges.join(parts.withColumnRenamed("node", "src"), "src").select("junction_key", "component").distinct()
    several = of.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component")
    turned = rows.select("junction_key", orientation(F.col("chr_a"), F.col("dir_a"), F.col("chr_b"), F.col("dir_b")).alias("what")).distinct()
    return of.join(several, "component", "left_semi").join(turned, "junction_key").groupBy("component", "what").agg(F.count_distinct("junction_key").alias("n_junctions"))


def support_by_haplotype(rows: DataFrame) -> DataFrame:
    """One row per junction, and for each genome and pair of haplotypes that occur label, support and share; '' and 0 where a junction lacks it."""
    column = F.concat_ws("_", "genome_id", F.coalesce("hp1", F.lit(0)), F.coalesce("hp2", F.lit(0)))
    wide = rows.withColumn("_c", column).groupBy("junction_key").pivot("_c").agg(F.max("is_pass").alias("label"), F.sum("supp").alias("support"), F.max("vaf").alias("vaf"))
    labels = [c for c in wide.columns if c.endswith("_label")]
    return wide.fillna("", labels).fillna(0, [c for c in wide.columns if c != "junction_key" and c not in labels])


def support_rows(table: DataFrame) -> DataFrame:
    """support_by_haplotype as one row per junction, genome and haplotypes."""
    cells = [c.removesuffix("_label") for c in table.columns if c.endswith("_label")]
    one = [F.struct(F.lit(c).alias("genome_hp"), F.col(f"{c}_label").alias("label"), F.col(f"{c}_support").alias("support"), F.col(f"{c}_vaf").alias("vaf")) for c in cells]
    return table.select("junction_key", F.inline(F.array(*one))) if one else table.selectExpr("junction_key", "'' genome_hp", "'' label", "0L support", "0D vaf").limit(0)


def complement(signs: Column) -> Column:
    """Signs turned over."""
    return F.translate(signs, "+-", "-+")


def end_names(rows: DataFrame) -> DataFrame:
    """(junction_key, side, name, turned, left_of, right_of): an end with its sign, with the other sign, and without one if it keeps its left or its right side."""
    ends = rows.select("junction_key", F.inline(F.array(*[F.struct(F.lit(e).alias("side"), F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.col(f"dir_{e}").alias("dir")) for e in "ab"]))).where("dir is not null").distinct()
    sign, at = names.sign(F.col("dir")), F.concat_ws(":", "chr", "pos")
    kept = lambda d: F.when(F.col("dir") == d, at).otherwise("")
    return ends.select("junction_key", "side", F.concat(sign, at).alias("name"), F.concat(complement(sign), at).alias("turned"), kept(1).alias("left_of"), kept(-1).alias("right_of"))


def paired_inversions(rows: DataFrame, within: int = 2_000_000, min_size: int = 50, alike: float = 0.95, slack: int = 200) -> DataFrame:
    """(key_i, key_j, chr, what): for each end of a junction the nearest later end of the other direction on the contig, of a junction of the same genomes, and what the two make.

    Support, summed over a junction's rows, differs by at most half of the first's, but 4 to 10 are always, or at most, allowed. If the first is one row of a haplotype, the other isn't
    of another one in the same phase set. The second ends of junctions between contigs count too. Nearest is by the smaller difference of first and second ends,
    of equally near ones the earlier place. A pair of which a member is in another pair of the contig is complex_inv. Of others, with i the one that begins with direction 1:
    inv_tra between contigs; INV or reciprocal_inv_del if they interlock; dup_inv_segment, Templated_ins_inv or complex_inv by the order of the directions.
    """
    by = rows.where("pos_b is not null and dir_a is not null and dir_b is not null and supp is not null").groupBy("junction_key", "chr_a", "pos_a", "dir_a", "chr_b", "pos_b", "dir_b").agg(
        F.sum("supp").alias("supp"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("genome_id")), ",").alias("genomes"),
        F.min(F.coalesce("hp1", F.lit(0))).alias("hp1"), F.min(F.coalesce("hp2", F.lit(0))).alias("hp2"), F.min("phaseset1").alias("ps1"), F.min("phaseset2").alias("ps2"),
    )
    inter = F.col("chr_a") != F.col("chr_b")
    side = lambda e, i: F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.col(f"dir_{e}").alias("dir"), F.col(f"hp{i}").alias("hp"), F.col(f"ps{i}").alias("ps"))
    # Distances between contigs are taken at the first end only.
    ends = cut(by.select("junction_key", "genomes", "supp", "n", "chr_a", "pos_a", "dir_a", "chr_b", "pos_b", "dir_b", F.when(inter, F.col("pos_a")).otherwise(F.col("pos_b")).alias("far"), F.inline(F.when(inter, F.array(side("a", 1), side("b", 2))).otherwise(F.array(side("a", 1))))))
    key = ["genomes", "chr"]
    named = lambda s: ends.select(*key, *[F.col(c).alias(f"{s}_{c}") for c in ends.columns if c not in key])
    met = ranges.near_pairs(named("i"), named("j"), key, "i_pos", "j_pos", within)
    later = (F.col("j_pos") > F.col("i_pos")) | ((F.col("j_pos") == F.col("i_pos")) & (F.col("j_dir") < F.col("i_dir")))
    balanced = F.abs(F.col("i_supp") - F.col("j_supp")) <= F.least(F.greatest(0.5 * F.col("i_supp"), F.lit(4.0)), F.lit(10.0))
    apart = (F.col("i_n") == 1) & (F.col("i_hp") != 0) & F.coalesce(F.col("i_ps") == F.col("j_ps"), F.lit(False)) & (F.col("j_hp") != 0) & (F.col("j_hp") != F.col("i_hp"))
    fits = met.where((F.col("i_dir") == -F.col("j_dir")) & (F.col("i_junction_key") != F.col("j_junction_key")) & later & balanced & ~apart)
    distance = F.least(F.abs(F.col("i_pos_a") - F.col("j_pos_a")), F.abs(F.col("i_far") - F.col("j_far")))
    mine = ["i_junction_key", "i_pos", "i_dir", "i_chr_a", "i_pos_a", "i_dir_a", "i_chr_b", "i_pos_b", "i_dir_b"]
    other = [f"j_{c}" for c in ("junction_key", "chr_a", "pos_a", "dir_a", "chr_b", "pos_b", "dir_b")]
    best = fits.groupBy(*key, *mine).agg(F.min(F.struct(distance.alias("distance"), "j_pos", *other)).alias("b"))
    pairs = cut(best.select(*key, *mine, *[F.col(f"b.{c}").alias(c) for c in other]))
    members = pairs.select(*key, F.least("i_junction_key", "j_junction_key").alias("x"), F.greatest("i_junction_key", "j_junction_key").alias("y")).distinct().select(*key, F.explode(F.array("x", "y")).alias("member"))
    busy = members.groupBy(*key, "member").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*key, "member")
    for s in "ij":
        pairs = pairs.join(busy.select(*key, F.col("member").alias(f"{s}_junction_key"), F.lit(True).alias(f"{s}_busy")), [*key, f"{s}_junction_key"], "left")

    first = F.col("i_dir_a") == 1
    pick = lambda c, one: F.when(first, F.col(f"i_{c}" if one else f"j_{c}")).otherwise(F.col(f"j_{c}" if one else f"i_{c}"))
    a1, b1, a2, b2 = pick("pos_a", True), pick("pos_b", True), pick("pos_a", False), pick("pos_b", False)
    interlock = (a1 - min_size < a2) & (a2 < b1) & (b1 < b2 + min_size)
    len1, len2 = b1 - a2, b2 - a1
    turns = F.transform(F.array_sort(F.array(*[F.struct(p.alias("p"), d.alias("d")) for p, d in ((a1, pick("dir_a", True)), (b1, pick("dir_b", True)), (a2, pick("dir_a", False)), (b2, pick("dir_b", False)))])), lambda t: t["d"])
    text = F.array_join(F.transform(turns, lambda t: F.when(t > 0, "+").otherwise("-")), "")
    what = (
        F.when(F.coalesce("i_busy", F.lit(False)) | F.coalesce("j_busy", F.lit(False)), "complex_inv").when((F.col("i_chr_a") != F.col("i_chr_b")) | (F.col("j_chr_a") != F.col("j_chr_b")), "inv_tra")
        .when(interlock & (len1 > alike * len2) & (F.abs(len2 - len1) < slack), "INV").when(interlock, "reciprocal_inv_del").when((a2 - min_size < a1) & (a1 < b2 + min_size), "dup_inv_segment")
        .when(text.isin("--++", "-++-"), "dup_inv_segment").when(text == "+--+", "Templated_ins_inv").otherwise("complex_inv")
    )
    return pairs.select(F.col("i_junction_key").alias("key_i"), F.col("j_junction_key").alias("key_j"), "chr", what.alias("what")).distinct()


# The graph of genomic segments.


def segment_ends(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """(genome_id, junction_key, chr, dir, pos, node) of the ends of junctions, node being the genomic segment there (neighbours) as contig:start:end."""
    found = neighbours(rows, contigs)
    return cut(found.select("genome_id", "junction_key", "chr", "dir", "pos", F.concat_ws(":", "chr", F.least("pos", "other"), F.greatest("pos", "other")).alias("node")))


def segment_edges(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Junctions as edges between the segments at their two ends: (src, dst, genome_id, junction_key, supp)."""
    own = rows.where("dir_a is not null and dir_b is not null").groupBy("genome_id", "junction_key", *[f"{c}_{e}" for e in "ab" for c in ("chr", "dir", "pos")]).agg(F.coalesce(F.sum("supp"), F.lit(0)).alias("supp"))
    for e, n in (("a", "src"), ("b", "dst")):
        own = own.join(ends.select("genome_id", "junction_key", *[F.col(c).alias(f"{c}_{e}") for c in ("chr", "dir", "pos")], F.col("node").alias(n)), ["genome_id", "junction_key", *[f"{c}_{e}" for c in ("chr", "dir", "pos")]])
    return own.select("src", "dst", "genome_id", "junction_key", "supp")


def segment_links(ends: DataFrame, adjacent: DataFrame, shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst) links of segments that no junction makes: those that end and begin at a reference adjacency (genome_id, chr, plus_pos, minus_pos), those of junctions
    that share an end in balance (genome_id, chr, pos, key_x, key_y), and those of junctions of a group (junction_key, gr_id), each linked with the group's smallest."""
    at = lambda d, n, p: ends.where(F.col("dir") == d).select("genome_id", "chr", F.col("pos").alias(p), F.col("node").alias(n)).distinct()
    one = adjacent.join(at(1, "src", "plus_pos"), ["genome_id", "chr", "plus_pos"]).join(at(-1, "dst", "minus_pos"), ["genome_id", "chr", "minus_pos"]).select("src", "dst")
    of = lambda k, n: ends.select("genome_id", "chr", "pos", F.col("junction_key").alias(k), F.col("node").alias(n)).distinct()
    two = shared.join(of("key_x", "src"), ["genome_id", "chr", "pos", "key_x"]).join(of("key_y", "dst"), ["genome_id", "chr", "pos", "key_y"]).select("src", "dst")
    held = groups.where("gr_id is not null").distinct().join(ends.select("junction_key", F.col("node").alias("src")).distinct(), "junction_key")
    three = held.join(held.groupBy("gr_id").agg(F.min("src").alias("dst")), "gr_id").select("src", "dst")
    return one.unionByName(two).unionByName(three).distinct()


def component_sizes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, n_nodes, n_junctions) of components with more than one junction."""
    of = edges.join(parts.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count_distinct("junction_key").alias("n_junctions")).where("n_junctions > 1")
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).join(of, "component")


def cluster_table(edges: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per junction of a component with more than one, in the columns of a cluster file: supports and genotypes by genome, greatest share, kinds, direction, contigs and phase sets of heterozygous ones."""
    of = edges.join(parts.withColumnRenamed("node", "src"), "src").select("junction_key", "component").distinct()
    several = of.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component")
    by = rows.groupBy("junction_key", "genome_id").agg(F.coalesce(F.sum("supp"), F.lit(0)).alias("supp"), F.max("genotype").alias("genotype"), F.max("vaf").alias("vaf"), *[F.max(c).alias(c) for c in ("vcf_sv_type", "sv_type", "chr_a", "chr_b", "dir_a", "dir_b", "phaseset1", "phaseset2")])
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("genome_id", F.coalesce(F.col(c).cast("string"), F.lit("")).alias("x")))), lambda t: t["x"]), ",")
    all_of = by.groupBy("junction_key").agg(
        listed("supp").alias("read_support"), listed("genotype").alias("genotypes"), F.round(F.max("vaf"), 6).alias("vaf"), F.array_join(F.array_sort(F.collect_set("genome_id")), ",").alias("genome_ids"), F.max("genotype").alias("_g"),
        *[F.max(c).alias(c) for c in ("vcf_sv_type", "sv_type", "chr_a", "chr_b", "dir_a", "dir_b", "phaseset1", "phaseset2")],
    )
    direction = F.when(F.col("dir_a") == F.col("dir_b"), "HH/TT").when(F.col("dir_a") == 1, "HT").otherwise("TH")
    phase = F.when(F.col("_g") == "het", F.concat_ws(",", "phaseset1", "phaseset2")).otherwise("")
    return of.join(several, "component", "left_semi").join(all_of, "junction_key").select(
        "component", "junction_key", "read_support", "vaf", "genotypes", "vcf_sv_type", "sv_type", direction.alias("direction"), F.when(F.col("chr_a") == F.col("chr_b"), "intra").otherwise("inter").alias("contigs"), phase.alias("phaseblock"), "genome_ids"
    )
