"""Queries of the range joins, filters, types, graphs and result rows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators import calls, graph, islands, junctions, output, ranges, segments
from strandline.plans.reference import CONTROL, JUN, SEG, _COV, _islands, _jun, _seg
from strandline.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


REPEATS = "rep as (select distinct chr_a, vntr.vntr_start - 25 low, vntr.vntr_end + 25 high from jun where vntr is not null)"


def _repeats(j: DataFrame) -> DataFrame:
    return j.where("vntr is not null").select("chr_a", (F.col("vntr.vntr_start") - 25).alias("low"), (F.col("vntr.vntr_end") + 25).alias("high")).distinct()


@query(f"""with {JUN}, {REPEATS}, m as (select junction_key, genome_id, pos_a, low, high from jun join rep using (chr_a) where pos_a between low and high)
select * from m qualify count(*) over (partition by junction_key, genome_id) = 1""")
def in_one_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Junctions whose first end lies in exactly one padded repeat."""
    j = _jun(spark, d)
    points = j.select("junction_key", "genome_id", "chr_a", "pos_a")
    return ranges.in_exactly_one(points, _repeats(j), ["chr_a"], ["junction_key", "genome_id"], "pos_a", "low", "high", 1000).drop("chr_a")


_POINTS = "pts as (select distinct chr_a ref_id, pos_a as position from jun where pos_a is not null union select chr_b, pos_b from jun where pos_b is not null)"


def _positions(j: DataFrame) -> DataFrame:
    return j.select(F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("ref_id"), F.col(f"pos_{e}").alias("position")) for e in "ab"])))


@query(f"""with {SEG}, {JUN}, {_POINTS}
select ref_id, position, genome_id, count(*) filter (coalesce(haplotype, 0) = 0) h0, count(*) filter (haplotype = 1) h1, count(*) filter (haplotype = 2) h2
from pts join split using (ref_id) where position > ref_start and position < ref_end and mapq > 10 group by all""")
def position_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Segments that span each junction end, by genome and haplotype."""
    return junctions.position_coverage(_positions(_jun(spark, d)), _seg(spark, d))


@query(f"""with {SEG}, {JUN}, {_POINTS},
cov as (select ref_id, position, count(*) n from pts join split using (ref_id) where position > ref_start and position < ref_end and mapq > 10 and genome_id like 'N%' group by all),
carried as (select junction_key from jun where genome_id like 'N%')
select junction_key, genome_id from jun j left join cov a on a.ref_id = chr_a and a.position = pos_a left join cov b on b.ref_id = chr_b and b.position = pos_b
where genome_id not like 'N%' and not is_single and pos_b is not null and junction_key not in (from carried) and coalesce(a.n, 0) <= 3 and coalesce(b.n, 0) <= 3""")
def low_control_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Two-ended junctions that no control carries and of which at most three control segments span either end."""
    j = _jun(spark, d)
    cov = junctions.position_coverage(_positions(j), _seg(spark, d).where(CONTROL)).groupBy("ref_id", "position").agg(F.sum(F.col("h0") + F.col("h1") + F.col("h2")).alias("n"))
    own = j.where(f"not ({CONTROL}) and not is_single and pos_b is not null").join(j.where(CONTROL).select("junction_key"), "junction_key", "left_anti")
    for e in "ab":
        side = cov.select(F.col("ref_id").alias(f"chr_{e}"), F.col("position").alias(f"pos_{e}"), F.col("n").alias(f"n_{e}"))
        own = own.join(side, [f"chr_{e}", f"pos_{e}"], "left")
    return own.where("coalesce(n_a, 0) <= 3 and coalesce(n_b, 0) <= 3").select("junction_key", "genome_id")


@query(f"""with {JUN} select i.junction_key, u.junction_key dup_key from jun i join jun u on u.chr_a = i.chr_a and i.pos_a >= u.pos_a and i.pos_a < u.pos_b
where i.vcf_sv_type = 'INS' and u.vcf_sv_type = 'DUP' and u.pos_b - u.pos_a <= 1.2 * i.length""")
def insertions_in_duplications(spark: SparkSession, d: str) -> DataFrame:
    return junctions.inside_duplications(_jun(spark, d))


@query(f"""with {JUN}, e as (select chr_a c, pos_a p, junction_key from jun where chr_a <> chr_b union all select chr_b, pos_b, junction_key from jun where chr_a <> chr_b)
select distinct i.junction_key, e.junction_key tra_key from jun i join e on i.chr_a = c where i.vcf_sv_type = 'INS' and abs(i.pos_a - p) <= 2000 and i.length + 50 >= abs(i.pos_a - p)""")
def insertions_near_translocations(spark: SparkSession, d: str) -> DataFrame:
    return junctions.insertions_near_translocations(_jun(spark, d))


@query(f"""with {SEG}, r as (select ref_id, ref_end, seg_id, ins_seq,
    case when length(ins_seq) > 6 then list_distinct([substr(ins_seq, i, 6) for i in range(1, length(ins_seq) - 5)]) else [] end k
  from seg where is_insertion and is_pass = 'PASS' and ins_seq is not null),
b as (select seg_id, k, ref_end, lag(seg_id) over w before, lag(k) over w kb, lag(ref_end) over w pe from r window w as (partition by ref_id order by ref_end, seg_id))
select seg_id, before, len(list_intersect(k, kb))::int shared from b where before is not null and ref_end - pe < 2000 and len(list_intersect(k, kb)) > 0 and len(list_intersect(k, kb)) >= 0.7 * least(len(k), len(kb))""")
def similar_insertions(spark: SparkSession, d: str) -> DataFrame:
    return junctions.similar_neighbours(_seg(spark, d))


@query(f"""with {SEG}, {JUN}, c as (select * from seg where is_clipped){_islands("c", "ref_id", "ref_end", 50, "cluster", "cc")},
k as (select ref_id, cluster, floor(median(ref_end_ori))::bigint place from cc group by ref_id, cluster),
m as (select junction_key, genome_id, place, abs(pos_a - place) distance from jun join k on ref_id = chr_a where vcf_sv_type = 'INS' and length is not null and abs(pos_a - place) <= least(250, length))
select junction_key, genome_id, place clip, distance from m qualify row_number() over (partition by junction_key, genome_id order by distance, place) = 1""")
def nearest_clips(spark: SparkSession, d: str) -> DataFrame:
    """The nearest cluster of clips within 250 of an insertion, and within its length."""
    ins = _jun(spark, d).where("vcf_sv_type = 'INS' and length is not null").select("junction_key", "genome_id", "chr_a", "pos_a", "length")
    clips = junctions.clip_clusters(_seg(spark, d)).select(F.col("ref_id").alias("chr_a"), F.col("position").alias("at"))
    allowed = F.col("distance") <= F.col("length")
    return ranges.nearest(ins, clips, ["chr_a"], ["junction_key", "genome_id"], "pos_a", "at", 250, allowed, "clip")


_PS = "ps as (select distinct chr_a chr, phaseset1 ps from jun where phaseset1 is not null)"


@query(f"""with {JUN}, {_PS} select junction_key, genome_id, (select max(ps) from ps where chr = chr_a and ps <= pos_a) ps from jun""")
def phase_sets(spark: SparkSession, d: str) -> DataFrame:
    """The last phase block that begins at or before each junction's first end."""
    j = _jun(spark, d)
    blocks = j.where("phaseset1 is not null").select("chr_a", F.col("phaseset1").alias("at"), F.col("phaseset1").alias("ps"))
    return ranges.last_before(j.select("junction_key", "genome_id", "chr_a", "pos_a"), blocks, ["chr_a"], "pos_a", "at", "ps").select("junction_key", "genome_id", "ps")


_NAME = """case when regexp_matches({t}, '^(scaffold|scaff|scf)[ _.-]*[0-9]+$') then 's' || regexp_extract({t}, '[ _.-]*0*([0-9]+)$', 1)
  when regexp_matches({t}, '^(chromosome|chrom|chr)?[ _.-]*[0-9]+$') then regexp_extract({t}, '^(?:chromosome|chrom|chr)?[ _.-]*0*([0-9]+)$', 1)
  else nullif(regexp_replace({t}, '^(chromosome|chrom|chr)[ _.-]*', ''), '') end"""


@query(f"""with {JUN}, pon as (select {_NAME.replace('{t}', 'lower(trim(chrom))')} c, pos p, {_NAME.replace('{t}', 'lower(trim(chr2))')} c2, stop_pos q, list_max([abs(x) for x in cipos]) ci from panel_records where cipos is not null),
m as (select c, p, coalesce(c2, c) c2, q, ci from pon union select c2, q, c, p, ci from pon where c2 <> c)
select distinct junction_key from jun join m on {_NAME.replace('{t}', 'lower(trim(chr_a))')} = c and {_NAME.replace('{t}', 'lower(trim(coalesce(chr_b, chr_a)))')} = c2
where abs(pos_a - p) <= 2000 and abs(pos_a - p) + abs(coalesce(pos_b, pos_a) - q) <= ci + 150""")
def panel_matches(spark: SparkSession, d: str) -> DataFrame:
    """Junctions near a panel record at both ends, records of two contigs in either order."""
    panel = load(spark, d, "panel_records").where("cipos is not null").select(
        names.contig(F.col("chrom")).alias("c"), F.col("pos").alias("p"), names.contig(F.col("chr2")).alias("c2"), F.col("stop_pos").alias("q"), F.array_max(F.transform("cipos", lambda x: F.abs(x))).alias("ci")
    )
    both = panel.withColumn("c2", F.coalesce("c2", "c")).union(panel.where("c2 <> c").select("c2", "q", "c", "p", "ci")).distinct()
    j = _jun(spark, d).select("junction_key", names.contig(F.col("chr_a")).alias("c"), names.contig(F.coalesce("chr_b", "chr_a")).alias("c2"), "pos_a", F.coalesce("pos_b", "pos_a").alias("pos_b"))
    met = ranges.near_pairs(j, both, ["c", "c2"], "pos_a", "p", 2000)
    return met.where(F.abs(F.col("pos_a") - F.col("p")) + F.abs(F.col("pos_b") - F.col("q")) <= F.col("ci") + 150).select("junction_key").distinct()


@query(f"""with {JUN}, pon as (select {_NAME.replace('{t}', 'lower(trim(chrom))')} c, pos p, {_NAME.replace('{t}', 'lower(trim(chr2))')} c2, stop_pos q, abs(svlen) len, coalesce(upper(svtype) in ('INS', '<INS>') or upper(svtype) like 'INS:%', false) ins,
  greatest(coalesce(list_max([abs(x) for x in cipos]), 0), coalesce(list_max([abs(x) for x in ciend]), 0)) ci from panel_records),
u as (select c, p, case when ins then c else coalesce(c2, c) end c2, case when ins then p + len else q end q, ci from pon),
m as (select * from u union select c2, q, c, p, ci from u where c2 <> c),
j as (select junction_key, {_NAME.replace('{t}', 'lower(trim(chr_a))')} c, {_NAME.replace('{t}', 'lower(trim(coalesce(chr_b, chr_a)))')} c2, pos_a, pos_b, coalesce(length, abs(pos_b - pos_a)) l, vntr from jun),
x as (select junction_key, vntr, abs(p - pos_a) d, case when j.c = j.c2 then abs(q - p - l) else abs(q - pos_b) end o, ci from j join m on j.c = m.c and j.c2 = m.c2
  where case when vntr is null then abs(p - pos_a) <= 2000 else p between vntr.vntr_start - 25 and vntr.vntr_end + 25 end)
select distinct junction_key from x where (o <= 50 and d + o <= 1000) or d + o <= ci + case when vntr is null then 150 else 1000 end""")
def panel_germline(spark: SparkSession, d: str) -> DataFrame:
    """Junctions that a panel record matches by place and length, with the wider bounds of repeats and insertions by their length."""
    wide = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: F.abs(x))), F.lit(0))
    is_ins = F.coalesce(F.split(F.regexp_replace(F.upper("svtype"), "[<>]", ""), ":")[0] == "INS", F.lit(False))
    panel = load(spark, d, "panel_records").select(
        names.contig(F.col("chrom")).alias("c"), F.col("pos").alias("p"), names.contig(F.when(is_ins, F.col("chrom")).otherwise(F.coalesce("chr2", "chrom"))).alias("named"),
        F.when(is_ins, F.col("pos") + F.abs("svlen")).otherwise(F.col("stop_pos")).alias("q"), F.greatest(wide("cipos"), wide("ciend")).alias("ci"),
    ).withColumn("c2", F.coalesce("named", "c")).drop("named")
    j = _jun(spark, d).select(
        "junction_key", names.contig(F.col("chr_a")).alias("c"), names.contig(F.coalesce("chr_b", "chr_a")).alias("c2"), "pos_a", "pos_b", F.coalesce("length", F.abs(F.col("pos_b") - F.col("pos_a"))).alias("length"),
        F.col("vntr.vntr_start").alias("rep_low"), F.col("vntr.vntr_end").alias("rep_high"),
    )
    return junctions.in_panel(j, panel)


@query(f"""with {JUN}, i as (select * from jun where chr_a = chr_b and dir_a = dir_b)
select p.junction_key key_p, m.junction_key key_m from i p join i m on p.chr_a = m.chr_a and p.dir_a = 1 and m.dir_a = -1
where abs(p.pos_a - m.pos_a) <= 200 and abs(p.pos_b - m.pos_b) <= 200 and abs((p.pos_b - p.pos_a) - (m.pos_b - m.pos_a)) < 200
  and least(p.pos_b - p.pos_a, m.pos_b - m.pos_a) > 0.95 * greatest(p.pos_b - p.pos_a, m.pos_b - m.pos_a)""")
def reciprocal_inversions(spark: SparkSession, d: str) -> DataFrame:
    return junctions.reciprocal_inversions(_jun(spark, d))


@query(f"""with {JUN}, i as (select * from jun where chr_a = chr_b and dir_a = dir_b and pos_b >= pos_a)
select s.junction_key, s.dir_a dir from i s where s.pos_b - s.pos_a <= 50000 and not exists (select 1 from i o where o.chr_a = s.chr_a and o.dir_a = -s.dir_a and o.pos_a between s.pos_a and s.pos_b)""")
def foldbacks(spark: SparkSession, d: str) -> DataFrame:
    return junctions.foldbacks(_jun(spark, d))


@query(f"""with {JUN}, t as (select * from jun where chr_a <> chr_b and supp is not null)
select x.junction_key key_x, y.junction_key key_y, coalesce(list_has_any(x.supp_read_ids, y.supp_read_ids), false) shared from t x join t y on x.chr_a = y.chr_a and x.chr_b = y.chr_b and x.junction_key < y.junction_key
where abs(x.pos_a - y.pos_a) <= 1000000 and abs(x.pos_b - y.pos_b) <= 1000000 and x.dir_a = -y.dir_a and x.dir_b = -y.dir_b and abs(x.supp - y.supp) <= least(greatest(4, 0.5 * x.supp), 10)""")
def translocation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return junctions.translocation_pairs(_jun(spark, d))


@query(f"""with {JUN}, s as (select junction_key, genome_id, sum(supp)::bigint dv, max(dr) dr from jun where is_pass <> 'FAIL_MERGED_HP' group by all)
select *, round(case when dv + dr > 0 then dv / (dv + dr) end, 6) vaf from s""")
def variant_share(spark: SparkSession, d: str) -> DataFrame:
    return junctions.vaf(_jun(spark, d)).withColumn("vaf", F.round("vaf", 6))


@query(f"""with {JUN}, s as (select junction_key, genome_id, sum(supp) dv, max(dr) dr from jun where is_pass <> 'FAIL_MERGED_HP' group by all),
v as (select *, case when dv + dr > 0 then dv / (dv + dr) end vaf, genome_id like 'N%' ctl from s),
g as (select junction_key, max(vaf) mv, max(dv) md, coalesce(max(vaf) filter (ctl), 0) cv, bool_or(ctl) c from v group by all),
h as (select junction_key, sum(distinct hp1) h1, sum(distinct hp2) h2 from jun group by all)
select junction_key, case when h1 in (0, 3) and h2 in (0, 3) then 'hom' else 'het' end genotype, case when not c or cv <= 0.01 then 'somatic' else 'germline' end mut_type,
  case when mv >= 0.05 and md >= 3 then 'PASS' else 'FAIL' end vaf_pass from h join g using (junction_key)""")
def genotypes(spark: SparkSession, d: str) -> DataFrame:
    return junctions.genotype(_jun(spark, d), F.expr(CONTROL))


@query(f"""with {JUN} select case when is_single or sv_type is null and not coalesce(dir_a = 1 and dir_b = -1 and chr_a = chr_b, false) then case when not is_single and chr_a = chr_b or is_single or chr_b is null or chr_a <> chr_b then 'BND' end
  when sv_type = 'tandem_duplication' then 'DUP' when sv_type = 'INS' then 'INS' when chr_a <> chr_b then 'BND' when sv_type = 'DEL' then 'DEL'
  when sv_type is null then 'DEL' else sv_type end reported, vcf_sv_type, count(*) n from jun group by all""")
def reported_types(spark: SparkSession, d: str) -> DataFrame:
    """The kind that each junction is reported as, against the one it has."""
    kind = junctions.sv_type(F.col("is_single"), F.col("sv_type"), F.lit(""), F.col("chr_a"), F.col("chr_b"), F.col("dir_a"), F.col("dir_b"))
    return _jun(spark, d).groupBy(kind.alias("reported"), "vcf_sv_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {JUN} select junction_key from jun group by junction_key having bool_or(is_pass = 'PASS') and min(supp) < 2""")
def weak_members(spark: SparkSession, d: str) -> DataFrame:
    """Junctions of which some row passed and some, passed or not, has fewer than two supporting reads."""
    by = _jun(spark, d).groupBy("junction_key").agg(F.min("supp").alias("least"), F.max(F.col("is_pass") == "PASS").alias("passed"))
    return by.where("passed and least < 2").select("junction_key")


@query(f"""with {_COV}, {JUN}, x as (select distinct junction_key, genome_id, chr_a ref_id, unnest(generate_series(pos_a // 1000, pos_b // 1000)) bin from jun where vcf_sv_type = 'DEL' and chr_a = chr_b and pos_b >= pos_a),
f as (select x.junction_key, genome_id, h.haplotype, coalesce(n, 0) n from x cross join (values (0), (1), (2)) h(haplotype) left join cov using (genome_id, ref_id, bin, haplotype))
select junction_key, genome_id, haplotype, floor(median(n))::bigint coverage from f group by all""")
def deletion_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whole median coverage inside each deletion, of any length, by haplotype; bins without segments count as 0."""
    j = _jun(spark, d).where("vcf_sv_type = 'DEL' and chr_a = chr_b and pos_b >= pos_a")
    wanted = j.select("junction_key", "genome_id", F.col("chr_a").alias("ref_id"), F.floor(F.col("pos_a") / 1000).alias("low"), F.floor(F.col("pos_b") / 1000).alias("high")).distinct()
    wanted = wanted.withColumn("haplotype", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return calls.median_depth(wanted, segments.coverage_histogram(_seg(spark, d)), ["junction_key", "genome_id", "haplotype"]).withColumnRenamed("depth", "coverage")


# The breakpoint graph: an end belongs to the place of ends at most 1000 apart, a junction joins the places of its two ends.

_GRAPH = f"""{JUN}, e as (select junction_key, hp1, hp2, chr_a chr, pos_a pos, 1 side, supp, genome_id, vcf_sv_type from jun where chr_b is not null and is_pass = 'PASS'
  union all select junction_key, hp1, hp2, chr_b, pos_b, 2, supp, genome_id, vcf_sv_type from jun where chr_b is not null and is_pass = 'PASS'){_islands("e", "chr", "pos", 1000, "c", "ec")},
edges as (select x.chr || ':' || x.c src, y.chr || ':' || y.c dst, x.genome_id, x.junction_key, x.supp, x.vcf_sv_type from ec x join ec y on x.junction_key = y.junction_key and x.genome_id = y.genome_id and x.hp1 is not distinct from y.hp1 and x.hp2 is not distinct from y.hp2 and x.side = 1 and y.side = 2)"""


def edges_of(rows: DataFrame) -> DataFrame:
    """Passed junctions with two ends as edges between the places of their ends."""
    j = rows.where("chr_b is not null and is_pass = 'PASS'")
    side = lambda e, n: F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos"), F.lit(n).alias("side"))
    ends = j.select("junction_key", "genome_id", "hp1", "hp2", "supp", "vcf_sv_type", F.inline(F.array(side("a", 1), side("b", 2))))
    placed = islands.gap_clusters(ends, ["chr"], "pos", 1000, "c").withColumn("node", F.concat_ws(":", "chr", "c"))
    key = ["junction_key", "genome_id", "hp1", "hp2", "supp", "vcf_sv_type"]
    return placed.groupBy(*key).agg(F.max(F.when(F.col("side") == 1, F.col("node"))).alias("src"), F.max(F.when(F.col("side") == 2, F.col("node"))).alias("dst"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(_jun(spark, d))


def types_of(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Junctions by kind of each component that has more than one junction."""
    of = edges.join(parts.withColumnRenamed("node", "src"), "src")
    several = of.groupBy("component").agg(F.count_distinct("junction_key").alias("k")).where("k > 1").select("component")
    return of.groupBy("component", "vcf_sv_type").agg(F.count_distinct("junction_key").alias("n_junctions")).join(several, "component", "left_semi")


@query(f"with {_GRAPH} select src, dst, genome_id, count(*) n, sum(supp)::bigint support from edges group by all")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("src", "dst", "genome_id").agg(F.count(F.lit(1)).alias("n"), F.sum("supp").alias("support"))


_REACH = f"""with recursive {_GRAPH}, u as (select distinct src a, dst b from edges union select dst, src from edges),
reach(a, b) as (select a, b from u union select reach.a, u.b from reach join u on reach.b = u.a),
comp as (select a node, least(a, min(b)) component from reach group by a)"""


@query(f"{_REACH} select component, count(*) n_nodes from comp group by all")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d), "src", "dst").groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""{_REACH} select component, vcf_sv_type, count(distinct junction_key) n_junctions from edges join comp on node = src
where component in (select component from edges join comp on node = src group by all having count(distinct junction_key) > 1) group by all""")
def component_types(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return types_of(edges, graph.components(edges, "src", "dst"))


# Result rows.

#: Fixed value: the people in the panel.
PANEL_SIZE = 1019


@query(f"""with {JUN}, k as (select distinct junction_key from jun), g as (select distinct genome_id from jun),
s as (select junction_key, genome_id, max(is_pass) l, sum(supp)::bigint s from jun group by all)
select junction_key, genome_id, coalesce(l, '') "label", coalesce(s, 0) support from k cross join g left join s using (junction_key, genome_id)""")
def support_table(spark: SparkSession, d: str) -> DataFrame:
    """Label and support of every junction in every genome, from the table with a pair of columns for each genome."""
    return output.support_rows(output.support_table(_jun(spark, d)))


@query(f"""with {JUN}, r as (select distinct junction_key, genome_id, unnest(supp_read_ids) read from jun) select junction_key, genome_id, string_agg(read, '; ' order by read) reads from r where read is not null group by all""")
def read_lists(spark: SparkSession, d: str) -> DataFrame:
    return output.read_lists(_jun(spark, d))


@query(f"""with {JUN}, k as (select *, coalesce(is_single, false) one, list_min(inv_bounds) lo, list_max(inv_bounds) hi, vcf_sv_type = 'INV' and not coalesce(is_single, false) and inv_bounds is not null inv,
    case when dir_a > 0 then '+' when dir_a is not null then '-' end || case when dir_b > 0 then '+' when dir_b is not null then '-' end strands from jun where vcf_id is not null and vcf_sv_type is not null and pos_a is not null),
x as (select *, vcf_sv_type = 'BND' and not one and pos_b is not null bnd, case when inv then hi - lo else length end len, coalesce(hp1 > 0 and phaseset1 is not null, false) phased from k where not coalesce(inv and dir_a = -1, false)),
m as (select *, unnest(case when bnd then [1, 2] else [0] end) mate from x),
y as (select *, case when dir_a > 0 then ['N', ''] else ['', 'N'] end na, case when dir_b > 0 then ['N', ''] else ['', 'N'] end nb, case when dir_a > 0 then ']' else '[' end ba, case when dir_b > 0 then ']' else '[' end bb from m)
select case mate when 2 then chr_b else chr_a end chrom, case when mate = 2 then pos_b when inv then lo else pos_a end pos, vcf_id || case mate when 0 then '' else '_' || mate end id,
  case when mate = 1 then na[1] || bb || chr_b || ':' || pos_b || bb || na[2] when mate = 2 then nb[1] || ba || chr_a || ':' || pos_a || ba || nb[2]
    when one then case when dir_a = -1 then '.N' else 'N.' end else '<' || vcf_sv_type || '>' end alt,
  round(vcf_qual, 1) qual, is_pass as "filter", genome_id,
  concat_ws(';', case when prec = 1 then 'PRECISE' else 'IMPRECISE' end, 'SVTYPE=' || case when one then 'sBND' else vcf_sv_type end, case when len > 0 then 'SVLEN=' || len end,
    case when vcf_sv_type in ('DEL', 'DUP', 'INV') and not one then 'END=' || case when inv then hi else pos_b end end, case when mate > 0 then 'MATE_ID=' || vcf_id || '_' || (3 - mate) end, 'ALIGNED_POS=' || tra_pos,
    'STRANDS=' || strands, case when vntr is not null then 'INSIDE_VNTR=TRUE' end, 'DETAILED_TYPE=' || case when inv then 'reciprocal_inversion' else sv_type end, 'MAPQ=' || round(vcf_qual, 1),
    case when phased then 'PHASESETID=' || case when phaseset1 = coalesce(phaseset2, phaseset1) then phaseset1::varchar else phaseset1 || '|' || phaseset2 end end, case when phased then 'HP=' || hp1 end, 'CLUSTERID=' || cluster_id) info from y""")
def vcf_rows(spark: SparkSession, d: str) -> DataFrame:
    return output.vcf_rows(_jun(spark, d))


@query(f"""with {JUN}, s as (select junction_key, genome_id, coalesce(sum(supp), 0)::bigint dv, coalesce(max(dr), 0) dr, coalesce(max(vaf), 0.0) v, coalesce(max(hvaf) filter (coalesce(hp1, 0) = 0), 0.0) a,
  coalesce(max(hvaf) filter (hp1 = 1), 0.0) b, coalesce(max(hvaf) filter (hp1 = 2), 0.0) c from jun group by all)
select junction_key, genome_id, case when dv = 0 then './.:0:0,0,0:' || dr || ':0' else format('0/1:{{:.2f}}:{{:.2f}},{{:.2f}},{{:.2f}}:{{}}:{{}}', round(v::varchar::decimal(18, 9), 2)::double, round(a::varchar::decimal(18, 9), 2)::double, round(b::varchar::decimal(18, 9), 2)::double, round(c::varchar::decimal(18, 9), 2)::double, dr, dv) end "sample" from s""")
def vcf_samples(spark: SparkSession, d: str) -> DataFrame:
    return output.vcf_samples(_jun(spark, d))


@query(f"""select panel_id, chrom chr1, pos pos1, case upper(svtype) when 'INS' then chrom else coalesce(chr2, chrom) end chr2, case upper(svtype) when 'INS' then abs(svlen) else stop_pos end pos2, svtype, round(carriers / {PANEL_SIZE}, 6) vaf from panel_records""")
def panel_rows(spark: SparkSession, d: str) -> DataFrame:
    """Panel records in the columns of a panel file: the length in place of an insertion's end, and the carriers' share."""
    is_ins = F.coalesce(F.upper("svtype") == "INS", F.lit(False))
    return load(spark, d, "panel_records").select(
        "panel_id", F.col("chrom").alias("chr1"), F.col("pos").alias("pos1"), F.when(is_ins, F.col("chrom")).otherwise(F.coalesce("chr2", "chrom")).alias("chr2"),
        F.when(is_ins, F.abs("svlen")).otherwise(F.col("stop_pos")).alias("pos2"), "svtype", F.round(F.col("carriers") / PANEL_SIZE, 6).alias("vaf"),
    )


_PAF = """a as (select * from paf where mapq >= 10 and qry_end - qry_start > 50 and coalesce(type_tag not like '%S', true) and qry_id is not null and ref_id is not null
  qualify row_number() over (partition by aln_id order by loaded_at nulls last, mapq desc) = 1)"""


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    """Alignments that count, the first delivery of each that does."""
    kept = "mapq >= 10 and qry_end - qry_start > 50 and not coalesce(endswith(type_tag, 'S'), false) and qry_id is not null and ref_id is not null"
    first = Window.partitionBy("aln_id").orderBy(F.asc_nulls_last("loaded_at"), F.desc("mapq"))
    return load(spark, d, "paf").where(kept).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


@query(f"""with {_PAF}, v as (select qry_id from a where ref_id like 'NC%' or ref_id like 'K%')
select qry_id, count(*) n_alignments, count(*) filter (ref_id like 'NC%' or ref_id like 'K%') n_viral, sum(qry_end - qry_start)::bigint aligned from a where qry_id in (from v) group by all""")
def viral_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with at least one alignment to a viral contig."""
    viral = "ref_id like 'NC%' or ref_id like 'K%'"
    by = _alignments(spark, d).groupBy("qry_id").agg(F.count(F.lit(1)).alias("n_alignments"), F.count_if(F.expr(viral)).alias("n_viral"), F.sum(F.col("qry_end") - F.col("qry_start")).alias("aligned"))
    return by.where("n_viral > 0")


@query(f"""with {_PAF} select ref_id, ref_start // 50 * 50 left_place, ref_end // 50 * 50 right_place, count(*) n from a where ref_start is not null and ref_end is not null group by all having count(*) >= 2""")
def fragment_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Fragments, by start and end in steps of 50, that occur at least twice."""
    step = lambda c: (F.floor(F.col(c) / 50) * 50)
    rows = _alignments(spark, d).where("ref_start is not null and ref_end is not null")
    return rows.groupBy("ref_id", step("ref_start").alias("left_place"), step("ref_end").alias("right_place")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
