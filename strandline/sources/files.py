"""Readers of text formats: SAM alignments, BED intervals, panel files and VCF records. Compressed files are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.cigar import parse


def _fields(df: DataFrame, sep: str = r"\t") -> Column:
    return F.split(df["value"], sep)


def sam(spark: SparkSession, path: str, genome_id: str) -> DataFrame:
    """Alignments of a SAM text file; header lines and lines with fewer than eleven fields are left out. Positions become zero-based."""
    lines = spark.read.text(path)
    f = _fields(lines)
    rows = lines.where(~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= 11)
    flag = F.get("f", F.lit(1)).try_cast("int")

    def tag(name: str) -> Column:
        return F.regexp_extract(F.array_join(F.slice("f", F.lit(12), F.size("f")), "\t"), rf"(?:^|\t){name}:i:(-?[0-9]+)", 1).try_cast("int")

    bit = lambda b: flag.bitwiseAND(b) != 0
    return rows.select(
        F.lit(genome_id).alias("genome_id"), F.get("f", F.lit(0)).alias("read_id"), F.when(F.get("f", F.lit(2)) != "*", F.get("f", F.lit(2))).alias("ref_id"), (F.get("f", F.lit(3)).try_cast("long") - 1).alias("reference_start"),
        parse(F.get("f", F.lit(5))).alias("cigar"), bit(16).alias("is_reverse"), bit(2048).alias("is_supplementary"), bit(256).alias("is_secondary"), bit(4).alias("is_unmapped"),
        F.get("f", F.lit(4)).try_cast("int").alias("mapping_quality"), F.coalesce(tag("NM"), F.lit(0)).alias("nm"), tag("HP").alias("hp"), F.when(F.get("f", F.lit(9)) != "*", F.get("f", F.lit(9))).alias("query_sequence"),
    )


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs and lengths of a SAM header."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("ref_id"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).try_cast("long").alias("length"))


def _bed_lines(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.col("value").rlike(r"\A(#|track\s|browser\s)"))
    return lines, F.split(F.trim("value"), r"\s+")


def _bed_reason(f: Column) -> Column:
    """The first reason why a line is no interval, null if it is one."""
    start, end = (F.get(f, F.lit(i)).try_cast("long") for i in (1, 2))
    return F.when(F.size(f) < 3, "columns").when(start.isNull() | end.isNull(), "number").when(end < start, "order")


def bed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a BED file that are no interval, with the reason: columns, number or order. Blank, comment, track and browser lines are none."""
    lines, f = _bed_lines(spark, path)
    return lines.select("value", _bed_reason(f).alias("reason")).where("reason is not null")


def bed(spark: SparkSession, path: str, pad: int = 25) -> DataFrame:
    """Intervals of a BED file with both ends padded; other lines are in bed_rejects."""
    lines, f = _bed_lines(spark, path)
    rows = lines.where(_bed_reason(f).isNull()).select(f[0].alias("ref_id"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end")).dropna()
    return rows.withColumns({"pad_start": F.col("start") - pad, "pad_end": F.col("end") + pad})


def panel(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """A panel file of eight comma-separated columns, for known contigs: the end of an insertion is its place plus its length, records of two contigs come in either order."""
    f = F.split("value", ",")
    kinds = {"chr1": "string", "pos1": "long", "chr2": "string", "pos2": "long", "ci1": "long", "ci2": "long", "svtype": "string", "vaf": "double"}
    rows = spark.read.text(path).select(*[F.get(f, F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(kinds.items())]).where("pos1 is not null and pos2 is not null")
    for c in ("chr1", "chr2"):
        rows = rows.join(contigs.select(F.col("ref_id").alias(c)).distinct(), c, "left_semi")
    rows = rows.withColumn("pos2", F.when(F.col("svtype") == "INS", F.col("pos1") + F.col("pos2")).otherwise(F.col("pos2"))).select(*kinds)
    mirrored = rows.where("chr1 <> chr2").select(F.col("chr2").alias("chr1"), F.col("pos2").alias("pos1"), F.col("chr1").alias("chr2"), F.col("pos1").alias("pos2"), F.col("ci2").alias("ci1"), F.col("ci1").alias("ci2"), "svtype", "vaf")
    return rows.unionByName(mirrored)


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF file: chrom, pos, id, alt, filter, info as a map, format keys and samples as arrays of text."""
    f = _fields(lines := spark.read.text(path))
    pairs = F.transform(F.split(F.get(f, F.lit(7)), ";"), lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.get(F.split(x, "=", 2), F.lit(1)).alias("value")))
    # Of a key that is there twice the first value counts.
    once = F.filter(pairs, lambda x, i: F.forall(F.slice(pairs, 1, i), lambda y: y["key"] != x["key"]))
    info = F.map_from_entries(once)
    return lines.where(~F.col("value").startswith("#")).where(F.size(f) >= 8).select(
        f[0].alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.get(f, F.lit(2)).alias("id"), F.get(f, F.lit(4)).alias("alt"), F.get(f, F.lit(6)).alias("filter"), info.alias("info"),
        F.split(F.get(f, F.lit(8)), ":").alias("format"), F.transform(F.slice(f, F.lit(10), F.size(f)), lambda s: F.split(s, ":")).alias("samples"),
    )


def phase_blocks(records: DataFrame) -> DataFrame:
    """(ref_id, ps, min_pos, max_pos) of the first sample's phase sets."""
    at = F.array_position("format", "PS")
    ps = F.when(at > 0, F.get(F.get("samples", F.lit(0)), (at - 1).cast("int"))).try_cast("long")
    return records.select(F.col("chrom").alias("ref_id"), ps.alias("ps"), "pos").where("ps is not null").groupBy("ref_id", "ps").agg(F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"))


def carriers(records: DataFrame, samples: int | None = None) -> DataFrame:
    """Panel rows of a VCF with many samples: the share of samples (of all, or of the number given) with a called genotype, and an end by kind."""
    called = F.size(F.filter("samples", lambda s: ~F.get(s, F.lit(0)).isin("./.", ".|.", ".")))
    number = lambda k: F.try_element_at("info", F.lit(k)).try_cast("long")
    text = lambda k: F.try_element_at("info", F.lit(k))
    total = F.lit(samples) if samples else F.size("samples")
    kind = text("SVTYPE")
    return records.select(
        F.col("chrom").alias("chr1"), F.col("pos").alias("pos1"), F.when(kind == "BND", F.coalesce(text("CHR2"), "chrom")).otherwise(F.col("chrom")).alias("chr2"),
        F.when(kind == "INS", F.abs(number("SVLEN"))).otherwise(F.coalesce(number("END"), F.col("pos"))).alias("pos2"), kind.alias("svtype"), (called / total).alias("vaf"),
    )
