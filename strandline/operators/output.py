"""Rows of result files: pivots, read lists and VCF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names


def support_table(rows: DataFrame) -> DataFrame:
    """One row per junction with label and support of each genome that occurs; '' and 0 where a genome lacks it."""
    wide = rows.groupBy("junction_key").pivot("genome_id").agg(F.max("is_pass").alias("label"), F.sum("supp").alias("support"))
    genomes = genomes_of(wide)
    return wide.fillna("", [f"{g}_label" for g in genomes]).fillna(0, [f"{g}_support" for g in genomes])


def genomes_of(table: DataFrame) -> list[str]:
    """The genomes of a support table."""
    return [c.removesuffix("_label") for c in table.columns if c.endswith("_label")]


def support_rows(table: DataFrame) -> DataFrame:
    """A support table as one row per junction and genome."""
    cells = [F.struct(F.lit(g).alias("genome_id"), F.col(f"{g}_label").alias("label"), F.col(f"{g}_support").alias("support")) for g in genomes_of(table)]
    if not cells:
        return table.select("junction_key", F.lit("").alias("genome_id"), F.lit("").alias("label"), F.lit(0).cast("long").alias("support")).limit(0)
    return table.select("junction_key", F.inline(F.array(*cells)))


def read_lists(rows: DataFrame) -> DataFrame:
    """The distinct supporting reads of each junction and genome, joined by '; '."""
    reads = rows.select("junction_key", "genome_id", F.explode("supp_read_ids").alias("read")).distinct()
    return reads.groupBy("junction_key", "genome_id").agg(F.array_join(F.array_sort(F.collect_list("read")), "; ").alias("reads"))


def breakend_alt(own_dir: Column, mate_dir: Column, mate_chr: Column, mate_pos: Column) -> Column:
    """The four bracket forms: the base comes first if this end's left side is kept, the bracket opens towards the mate's kept side."""
    at = F.concat(mate_chr, F.lit(":"), mate_pos)
    bracket = F.when(mate_dir > 0, "]").otherwise("[")
    return F.when(own_dir > 0, F.concat(F.lit("N"), bracket, at, bracket)).otherwise(F.concat(bracket, at, bracket, F.lit("N")))


def _field(name: str, value: Column, where: Column | None = None) -> Column:
    """name=value, null if the value is or where doesn't hold."""
    text = F.concat(F.lit(f"{name}="), value.cast("string"))
    return text if where is None else F.when(where, text)


def vcf_rows(rows: DataFrame, *more: str) -> DataFrame:
    """VCF records of junctions with ends: two mates for a breakend, one record otherwise; positions stay zero-based.

    A one-sided end says by the dot on which side its unknown rest lies. An inversion with known bounds is one record over these, from its first of the two
    junctions. A breakend's mates name each other; haplotype and phase set come together or not at all. more names further columns to keep.
    """
    kind, single = F.col("vcf_sv_type"), F.coalesce("is_single", F.lit(False))
    is_bnd = (kind == "BND") & ~single & F.col("pos_b").isNotNull()
    is_inv = (kind == "INV") & ~single & F.col("inv_bounds").isNotNull()
    reported = F.when(single, "sBND").otherwise(kind)
    low, high = F.array_min("inv_bounds"), F.array_max("inv_bounds")
    same_phase = F.col("phaseset1") == F.coalesce("phaseset2", "phaseset1")
    phase = F.when(same_phase, F.col("phaseset1").cast("string")).otherwise(F.concat_ws("|", "phaseset1", "phaseset2"))
    end = F.when(is_inv, high).otherwise(F.col("pos_b"))
    length = F.when(is_inv, high - low).otherwise(F.col("length"))
    phased = (F.col("hp1") > 0) & F.col("phaseset1").isNotNull()

    def info(mate: Column) -> Column:
        return F.concat_ws(
            ";", F.when(F.col("prec") == 1, "PRECISE").otherwise("IMPRECISE"), _field("SVTYPE", reported), _field("SVLEN", length, length > 0), _field("END", end, kind.isin("DEL", "DUP", "INV") & ~single),
            _field("MATE_ID", mate), _field("ALIGNED_POS", F.col("tra_pos")), _field("STRANDS", F.concat(names.sign(F.col("dir_a")), names.sign(F.col("dir_b"))), F.col("dir_a").isNotNull() & F.col("dir_b").isNotNull()),
            F.when(F.col("vntr").isNotNull(), "INSIDE_VNTR=TRUE"), _field("DETAILED_TYPE", F.when(is_inv, "reciprocal_inversion").otherwise(F.col("sv_type"))), _field("MAPQ", F.round("vcf_qual", 1)),
            _field("PHASESETID", phase, phased), _field("HP", F.col("hp1"), phased), _field("CLUSTERID", F.col("cluster_id")),
        )

    def record(chrom: str, pos: Column, suffix: str, alt: Column, mate: str | None) -> Column:
        of_mate = F.concat("vcf_id", F.lit(mate)) if mate else F.lit(None).cast("string")
        return F.struct(F.col(chrom).alias("chrom"), pos.alias("pos"), F.concat("vcf_id", F.lit(suffix)).alias("id"), alt.alias("alt"), info(of_mate).alias("info"))

    first = record("chr_a", F.col("pos_a"), "_1", breakend_alt(F.col("dir_a"), F.col("dir_b"), F.col("chr_b"), F.col("pos_b")), "_2")
    second = record("chr_b", F.col("pos_b"), "_2", breakend_alt(F.col("dir_b"), F.col("dir_a"), F.col("chr_a"), F.col("pos_a")), "_1")
    alt = F.when(single, F.when(F.col("dir_a") == -1, ".N").otherwise("N.")).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    one = record("chr_a", F.when(is_inv, low).otherwise(F.col("pos_a")), "", alt, None)
    kept = rows.where("vcf_id is not null and vcf_sv_type is not null and pos_a is not null").where(~F.coalesce(is_inv & (F.col("dir_a") == -1), F.lit(False)))
    return kept.select(F.inline(F.when(is_bnd, F.array(first, second)).otherwise(F.array(one))), F.round("vcf_qual", 1).alias("qual"), F.col("is_pass").alias("filter"), "genome_id", *more)


def vcf_samples(rows: DataFrame) -> DataFrame:
    """(junction_key, genome_id, sample): genotype, share, its three shares by haplotype, reference reads and support; without support only the reference reads."""
    by = rows.groupBy("junction_key", "genome_id").agg(
        F.coalesce(F.sum("supp"), F.lit(0)).alias("dv"), F.coalesce(F.max("dr"), F.lit(0)).alias("dr"), F.max("vaf").alias("vaf"),
        *[F.coalesce(F.max(F.when(F.coalesce("hp1", F.lit(0)) == h, F.col("hvaf"))), F.lit(0.0)).alias(f"h{h}") for h in range(3)],
    )
    two = lambda c: F.format_string("%.2f", F.round(F.coalesce(c, F.lit(0.0)), 2))
    some = F.concat_ws(":", F.lit("0/1"), two(F.col("vaf")), F.concat_ws(",", *[two(F.col(f"h{h}")) for h in range(3)]), F.col("dr"), F.col("dv"))
    return by.select("junction_key", "genome_id", F.when(F.col("dv") == 0, F.concat(F.lit("./.:0:0,0,0:"), F.col("dr"), F.lit(":0"))).otherwise(some).alias("sample"))


def vcf_table(rows: DataFrame, genomes: list[str]) -> DataFrame:
    """One record per junction, or two for a breakend, from its row with most support, with samples, an array of a text for each of genomes; a genome without the junction has ./.:0:0,0,0:0:0."""
    best = Window.partitionBy("junction_key").orderBy(F.desc_nulls_last("supp"), "genome_id", F.asc_nulls_first("hp1"), F.asc_nulls_first("hp2"))
    records = vcf_rows(rows.where("vcf_id is not null").withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"), "junction_key").drop("genome_id")
    held = vcf_samples(rows).groupBy("junction_key").agg(F.map_from_entries(F.collect_list(F.struct("genome_id", "sample"))).alias("_s"))
    samples = F.transform(F.array(*[F.lit(g) for g in genomes]), lambda g: F.coalesce(F.try_element_at("_s", g), F.lit("./.:0:0,0,0:0:0")))
    return records.join(held, "junction_key").withColumn("samples", samples).drop("_s")
