"""Queries of the junction operators over the junctions and insertions that the segments themselves show, with their SQL.

The ends of the exported junctions lie where no segment is, and rarely near each other; those of the segments' own connections meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import calls, evidence, graph, junctions, ranges, rearrangements, segments
from strandline.plans import reference, reference_calls, reference_joins, reference_rearranged
from strandline.plans.reference import JUN, SEG, _islands, _seg
from strandline.plans.reference_evidence import _DET
from strandline.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The common table expressions of _DET after those of the segments, and jun in the columns of the exported one.
_FOUND = _DET.removeprefix(SEG) + """,
fi as (select genome_id, read_id, haplotype, ref_id, ref_end, segment_length l, coalesce(is_pass = 'PASS', false) passed from seg where is_insertion and segment_length is not null)""" + _islands("fi", "ref_id", "ref_end", 1000, "cluster", "fc") + """,
fv as (select distinct ref_id, cluster, l from fc), fw as (select *, coalesce(l - lag(l) over w > greatest(50, 0.25 * lag(l) over w), true)::int nw from fv window w as (partition by ref_id, cluster order by l)),
fl as (select ref_id, cluster, l, sum(nw) over (partition by ref_id, cluster order by l) as level from fw), fz as (select * from fc join fl using (ref_id, cluster, l)),
fp as (select ref_id, cluster, level, floor(median(ref_end))::bigint pos_a, floor(median(l))::bigint length from fz where passed group by all),
ft as (select genome_id, bo.a.hp hp1, bo.b.hp hp2, read_id, x.chr chr_a, x.position pos_a, x.dir dir_a, y.chr chr_b, y.position pos_b, y.dir dir_b from bo join spot x on x.node = node_a join spot y on y.node = node_b where (node_a, node_b) in (select (node_a, node_b) from bo where passed)),
fk as (select *, chr_a || ':' || pos_a t, chr_b || ':' || pos_b u, case when dir_a > 0 then '+' else '-' end s, case when dir_b > 0 then '+' else '-' end v from ft),
fe as (select case when t <= u then s || t || '|' || v || u else v || u || '|' || s || t end junction_key, genome_id, hp1, hp2, read_id, case when chr_a <> chr_b then 'BND' when dir_a = dir_b then 'INV' when dir_a = 1 then 'DEL' else 'DUP' end vcf_sv_type,
    case when chr_a = chr_b then abs(pos_b - pos_a) end length, chr_a, pos_a, dir_a, chr_b, pos_b, dir_b from fk
  union all select ref_id || ':' || pos_a || '|INS:' || length, genome_id, haplotype, haplotype, read_id, 'INS', length, ref_id, pos_a, null, null, null, null from fz join fp using (ref_id, cluster, level)),
jun as (select * exclude (read_id), count(distinct read_id) supp, list_sort(list_distinct(list(read_id))) supp_read_ids, null sv_type, null::bigint phaseset1, null::bigint phaseset2, null::struct(vntr_start bigint, vntr_end bigint) vntr, null gr_id,
    'PASS' is_pass, false is_single, vcf_sv_type = 'DUP' is_dup from (from fe) group by all)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return evidence.as_junctions(_seg(spark, d))


def on_found(plans, name: str):
    """Registers a query over the found junctions, with the SQL of the one of this name over the exported ones."""

    def register(f):
        sql = plans.SQL[name]
        with_seg = SEG.strip() in sql
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.replace(JUN.strip(), (_FOUND.lstrip(", \n") if with_seg else SEG.strip() + _FOUND))
        return f

    return register


@on_found(reference, "indel_clusters")
def found_indel_clusters(spark: SparkSession, d: str) -> DataFrame:
    return junctions.indel_clusters(_found(spark, d))


@on_found(reference, "similar_deletions")
def found_similar_deletions(spark: SparkSession, d: str) -> DataFrame:
    return junctions.similar_deletions(_found(spark, d).select("junction_key", "chr_a", "pos_a", "pos_b", "length", "vcf_sv_type"))


@on_found(reference_joins, "position_coverage")
def found_position_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Segments that span each end of a found junction, by genome and haplotype."""
    return junctions.position_coverage(reference_joins._positions(_found(spark, d)), _seg(spark, d))


@on_found(reference_joins, "nearest_clips")
def found_nearest_clips(spark: SparkSession, d: str) -> DataFrame:
    """The nearest cluster of clips within 250 of a found insertion, and within its length."""
    ins = _found(spark, d).where("vcf_sv_type = 'INS' and length is not null").select("junction_key", "genome_id", "chr_a", "pos_a", "length")
    clips = junctions.clip_clusters(_seg(spark, d)).select(F.col("ref_id").alias("chr_a"), F.col("position").alias("at"))
    return ranges.nearest(ins, clips, ["chr_a"], ["junction_key", "genome_id"], "pos_a", "at", 250, F.col("distance") <= F.col("length"), "clip")


@on_found(reference_calls, "coverage_calls")
def found_coverage_calls(spark: SparkSession, d: str) -> DataFrame:
    return calls.coverage_calls(_found(spark, d), segments.coverage_histogram(_seg(spark, d)))


@on_found(reference_calls, "inconsistent_junctions")
def found_inconsistent_junctions(spark: SparkSession, d: str) -> DataFrame:
    other = _seg(spark, d).where(segments.IS_SPLIT).where("not coalesce(is_primary, false)")
    return calls.inconsistent(_found(spark, d), other.select("ref_id", F.explode(F.array("ref_start", "ref_end")).alias("position")))


@on_found(reference_calls, "spanning_share")
def found_spanning_share(spark: SparkSession, d: str) -> DataFrame:
    j = _found(spark, d)
    return calls.spanning_share(j, junctions.position_coverage(reference_joins._positions(j), _seg(spark, d))).withColumn("vaf", F.round("vaf", 6))


@on_found(reference_calls, "shared_ends")
def found_shared_ends(spark: SparkSession, d: str) -> DataFrame:
    return calls.shared_ends(_found(spark, d))


@on_found(reference_rearranged, "neighbours")
def found_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.neighbours(_found(spark, d), load(spark, d, "contigs"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    j = _found(spark, d)
    edges = reference_joins.edges_of(j)
    return j, edges, graph.components(edges, "src", "dst")


@on_found(reference_joins, "component_types")
def found_component_types(spark: SparkSession, d: str) -> DataFrame:
    _, edges, parts = _graph(spark, d)
    return reference_joins.types_of(edges, parts)


@on_found(reference_calls, "component_table")
def found_component_table(spark: SparkSession, d: str) -> DataFrame:
    _, edges, parts = _graph(spark, d)
    return calls.component_table(edges, parts)


@on_found(reference_calls, "cluster_rows")
def found_cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    j, edges, parts = _graph(spark, d)
    return calls.cluster_rows(edges, parts, j)


@on_found(reference_rearranged, "component_orientations")
def found_component_orientations(spark: SparkSession, d: str) -> DataFrame:
    j, edges, parts = _graph(spark, d)
    return rearrangements.component_orientations(edges, parts, j)
