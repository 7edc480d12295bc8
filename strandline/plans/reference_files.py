"""Queries that write result files to the shared folder and read them again, with the SQL of what has to come back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.lineage import shared_dir
from strandline.operators import output
from strandline.plans.reference import BACKGROUND, JUN, MASK, SEG, _islands, _jun, collapsed_regions
from strandline.sinks import files as sinks
from strandline.sources import files as sources
from strandline.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"""with {SEG}, {BACKGROUND}, {MASK}{_islands("masked", "ref_id", "bin", 1, "c", "mc")}
select ref_id, c * 1000 "start", (max(bin) + 1) * 1000 "end", c * 1000 - 25 pad_start, (max(bin) + 1) * 1000 + 25 pad_end from mc group by ref_id, c""")
def bed_file(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed regions written as BED and read as padded intervals."""
    path = _folder(spark, "regions")
    sinks.write_bed(collapsed_regions(spark, d), path)
    return sources.bed(spark, path)


@query("""with p as (select chrom, pos, case when upper(svtype) = 'INS' then chrom else coalesce(chr2, chrom) end chr2, case when upper(svtype) = 'INS' then abs(svlen) else stop_pos end q, coalesce(list_max(cipos), 0)::bigint a,
  coalesce(list_max(ciend), 0)::bigint b, upper(svtype) t from panel_records where pos is not null and svtype is not null),
r as (select chrom chr1, pos pos1, chr2, case when t = 'INS' then pos + q else q end pos2, a ci1, b ci2, t svtype from p where q is not null and chrom in (select ref_id from contigs) and chr2 in (select ref_id from contigs))
select * from r union all select chr2, pos2, chr1, pos1, ci2, ci1, svtype from r where chr1 <> chr2""")
def panel_file(spark: SparkSession, d: str) -> DataFrame:
    """Panel records written as a panel file and read for the known contigs."""
    path = _folder(spark, "panel")
    is_ins = F.upper("svtype") == "INS"
    most = lambda c: F.coalesce(F.array_max(c), F.lit(0))
    rows = load(spark, d, "panel_records").where("pos is not null and svtype is not null").select(
        "chrom", "pos", F.when(is_ins, F.col("chrom")).otherwise(F.coalesce("chr2", "chrom")).alias("chr2"), F.when(is_ins, F.abs("svlen")).otherwise(F.col("stop_pos")).alias("q"), most("cipos").alias("a"), most("ciend").alias("b"), F.upper("svtype").alias("t"), F.lit(0.0).alias("vaf")
    )
    sinks.write_table(rows, path, sep=",", header=False)
    return sources.panel(spark, path, load(spark, d, "contigs")).drop("vaf")


@query(f"""with {JUN}, g as (select count(distinct genome_id) n from jun), b as (select * from jun where vcf_id is not null qualify row_number() over (partition by junction_key order by supp desc nulls last, genome_id, hp1 nulls first, hp2 nulls first) = 1),
h as (select junction_key, count(*) k from (select junction_key, genome_id from jun group by all having coalesce(sum(supp), 0) > 0) group by all),
x as (select *, coalesce(is_single, false) one, vcf_sv_type = 'INV' and not coalesce(is_single, false) and inv_bounds is not null inv from b where vcf_sv_type is not null and pos_a is not null),
y as (select *, vcf_sv_type = 'BND' and not one and pos_b is not null bnd from x where not coalesce(inv and dir_a = -1, false)), m as (select *, unnest(case when bnd then [1, 2] else [0] end) mate from y)
select case mate when 2 then chr_b else chr_a end chrom, case when mate = 2 then pos_b when inv then list_min(inv_bounds) else pos_a end pos, vcf_id || case mate when 0 then '' else '_' || mate end id, is_pass as "filter",
  round(coalesce(k, 0) / n, 6) carriers from m left join h using (junction_key), g""")
def vcf_file(spark: SparkSession, d: str) -> DataFrame:
    """Junctions written as a VCF with a column for each genome, and read with the share of genomes that carry each."""
    path, j = _folder(spark, "vcf"), _jun(spark, d)
    genomes = sorted(r[0] for r in j.select("genome_id").distinct().collect())  # as many as the file has columns
    sinks.write_vcf(output.vcf_table(j, genomes), load(spark, d, "contigs"), path, genomes)
    records = sources.vcf(spark, f"{path}/records")
    called = F.size(F.filter("samples", lambda s: ~F.get(s, F.lit(0)).isin("./.", ".|.", ".")))
    return records.select("chrom", "pos", "id", "filter", F.round(called / F.size("samples"), 6).alias("carriers"))
