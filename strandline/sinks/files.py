"""Writers of result files. Each writes a folder of part files, by place where order matters, so no result passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import output

# Lines of the VCF header.
VCF_HEADER = [
    "##fileformat=VCFv4.2",
    '##INFO=<ID=PRECISE,Number=0,Type=Flag,Description="Breakpoints are exact">',
    '##INFO=<ID=IMPRECISE,Number=0,Type=Flag,Description="Breakpoints are approximate">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Kind of rearrangement">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="Second position">',
    '##INFO=<ID=STRANDS,Number=1,Type=String,Description="Directions of both ends">',
    '##ALT=<ID=DEL,Description="Deletion">',
    '##ALT=<ID=INS,Description="Insertion">',
    '##ALT=<ID=DUP,Description="Duplication">',
    '##ALT=<ID=INV,Description="Inversion">',
    '##ALT=<ID=BND,Description="Breakend">',
    '##INFO=<ID=MATE_ID,Number=1,Type=String,Description="The other end of a breakend">',
    '##INFO=<ID=ALIGNED_POS,Number=1,Type=String,Description="Where inserted sequence aligns">',
    '##INFO=<ID=DETAILED_TYPE,Number=1,Type=String,Description="Finer kind">',
    '##INFO=<ID=MAPQ,Number=1,Type=Float,Description="Median mapping quality">',
    '##INFO=<ID=PHASESETID,Number=1,Type=String,Description="Phase set of both ends">',
    '##INFO=<ID=HP,Number=1,Type=Integer,Description="Haplotype">',
    '##INFO=<ID=INSIDE_VNTR,Number=1,Type=String,Description="Inside a tandem repeat">',
    '##INFO=<ID=CLUSTERID,Number=1,Type=String,Description="Component of the breakpoint graph">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=VAF,Number=1,Type=Float,Description="Share of supporting reads">',
    '##FORMAT=<ID=hVAF,Number=3,Type=Float,Description="Share by haplotype">',
    '##FORMAT=<ID=DR,Number=1,Type=Integer,Description="Reference reads">',
    '##FORMAT=<ID=DV,Number=1,Type=Integer,Description="Supporting reads">',
]


def write_vcf(records: DataFrame, contigs: DataFrame, path: str, genomes: list[str]) -> None:
    """Records of output.vcf_table as VCF lines with a column per genome, range-partitioned by contig order and place; the header is a part file of its own that sorts first.

    contigs: (ref_id, length, ord), a table of the reference's contigs. Records of unknown contigs come last. The header names the filters that occur.
    """
    known = contigs.select(F.col("ref_id").alias("chrom"), F.coalesce("ord", F.lit(2**31 - 1)).alias("ord"))
    lines = records.join(known, "chrom", "left").withColumn("ord", F.coalesce("ord", F.lit(2**31 - 1)))
    text = F.concat_ws("\t", "chrom", "pos", "id", F.lit("N"), "alt", F.coalesce(F.col("qual").cast("string"), F.lit(".")), "filter", "info", F.lit("GT:VAF:hVAF:DR:DV"), F.array_join("samples", "\t"))
    body = lines.repartitionByRange("ord", "chrom", "pos").sortWithinPartitions("ord", "chrom", "pos", "id").select(text.alias("value"))
    names = F.concat(F.lit("##contig=<ID="), "ref_id", F.lit(",length="), "length", F.lit(">"))
    spark = records.sparkSession
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *genomes])
    head = spark.createDataFrame([(0, i, x) for i, x in enumerate(VCF_HEADER)] + [(3, 0, columns)], "part int, k int, value string")
    head = head.unionByName(contigs.select(F.lit(1).alias("part"), F.col("ord").cast("int").alias("k"), names.alias("value")))
    filters = records.where("filter <> 'PASS'").select("filter").distinct()
    head = head.unionByName(filters.select(F.lit(2).alias("part"), F.lit(0).alias("k"), F.concat(F.lit("##FILTER=<ID="), "filter", F.lit(',Description="Failed a check">')).alias("value")))
    head.coalesce(1).sortWithinPartitions("part", "k", "value").select("value").write.text(f"{path}/header")
    body.write.text(f"{path}/records")


def write_vcf_pair(rows: DataFrame, contigs: DataFrame, path: str, genomes: list[str]) -> None:
    """Two VCF files of junction rows: all of them in path/all, and the somatic ones in path/somatic."""
    write_vcf(output.vcf_table(rows, genomes), contigs, f"{path}/all", genomes)
    write_vcf(output.vcf_table(rows.where("mut_type = 'somatic'"), genomes), contigs, f"{path}/somatic", genomes)


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """Rows as text with a separator; arrays are joined by commas."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(path, sep=sep, header=header, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_bed(df: DataFrame, path: str, chrom: str = "ref_id", start: str = "start_pos", end: str = "end_pos", more: tuple[str, ...] = ()) -> None:
    """Intervals as BED, ordered by place within range partitions."""
    rows = df.select(chrom, start, end, *more).repartitionByRange(chrom, start).sortWithinPartitions(chrom, start)
    rows.write.csv(path, sep="\t", header=False)
