"""Queries of the relations between junctions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.lineage import cut
from strandline.operators import calls, cigar, evidence, graph, rearrangements, segments
from strandline.plans.reference import _COV, JUN, SEG, _islands, _jun, _seg
from strandline.plans.reference_evidence import _DET
from strandline.plans.reference_joins import _REACH, _edges
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


@query(f"""with {JUN}, i as (select distinct junction_key, chr_a, pos_a, pos_b, dir_a from jun where chr_a = chr_b and dir_a = dir_b and pos_b >= pos_a),
s as (select *, (select min((o.pos_a, o.pos_b)) from i o where o.chr_a = i.chr_a and o.dir_a = -i.dir_a and o.pos_a >= i.pos_b) n, exists (select 1 from i o where o.chr_a = i.chr_a and o.dir_a = -i.dir_a and o.pos_a < i.pos_a - 5000) e
  from i where pos_b - pos_a <= 50000 and not exists (select 1 from i o where o.chr_a = i.chr_a and o.dir_a = -i.dir_a and o.pos_a >= i.pos_a - 5000 and o.pos_a < i.pos_b))
select junction_key, dir_a dir from s where n is null or not e or abs(n[2] - pos_b) >= 50000""")
def lone_foldbacks(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.lone_foldbacks(_jun(spark, d))


_ENDS = """e as (select genome_id, junction_key, supp, supp_read_ids, chr_a chr, pos_a pos, dir_a dir, hp1 hp, phaseset1 ps, -dir_a * pos_a x from jun where dir_a is not null
  union all select genome_id, junction_key, supp, supp_read_ids, chr_b, pos_b, dir_b, hp2, phaseset2, -dir_b * pos_b from jun where dir_b is not null)"""


_NEAR = f"""{_ENDS}, m as (select l.*, -l.dir * r.pos y, r.hp rh, r.ps rp, r.supp rs, r.supp_read_ids rr from e l join e r on l.genome_id = r.genome_id and l.chr = r.chr and r.dir = -l.dir and -l.dir * r.pos between l.x + 1 and l.x + 2000000),
one as (select genome_id, junction_key, chr, dir, pos, min(y) y1 from m where list_has_any(supp_read_ids, rr) group by all),
two as (select genome_id, junction_key, chr, dir, pos, min(y) y2 from m where not coalesce(ps = rp and hp > 0 and rh > 0 and hp <> rh, false) and abs(supp - rs) < least(supp, rs) group by all),
o as (select distinct genome_id, junction_key, chr, dir, pos, x from e),
nbr as (select genome_id, junction_key, chr, dir, pos, -dir * coalesce(y1, y2, greatest(case when dir = -1 then least(x + 2000000, length - 10000) else least(x + 2000000, -10000) end, x)) other,
    (case when y1 is not null then 1 when y2 is not null then 2 else 3 end)::int as level
  from o left join one using (genome_id, junction_key, chr, dir, pos) left join two using (genome_id, junction_key, chr, dir, pos) join contigs on ref_id = chr)"""


@query(f"with {JUN}, {_NEAR} select * from nbr")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Where the genomic segment at each end of a junction ends, for ends of either direction."""
    return rearrangements.neighbours(_jun(spark, d), load(spark, d, "contigs"))


_ROUTES = f"""{SEG}, {JUN.strip()},
rd as (select distinct junction_key, unnest(supp_read_ids) read_id from jun),
q as (select junction_key, ref_id chr, quantile_cont(segment_length, 0.9) q90 from rd join split using (read_id) where segment_length is not null group by all),
i as (select junction_key, chr_a chr, max(pos_a) p, max(regexp_extract(junction_key, 'INS:([0-9]+)$', 1)::bigint) z from jun where pos_b is null and regexp_matches(junction_key, 'INS:[0-9]+$') group by all),
o as (select junction_key target, chr_a, pos_a, dir_a, chr_b, pos_b, dir_b, max(length) length, max(coalesce(is_dup, false)) known from jun where pos_b is not null group by all),
t as (select * from o where not coalesce(chr_a = chr_b and dir_a = dir_b, false) and not coalesce(chr_a = chr_b and dir_a > 0 and dir_b < 0 and pos_b - pos_a < 100000, false)),
ra as (select i.junction_key, target from t join i on chr = chr_a left join q on q.junction_key = target and q.chr = chr_b where not known and p >= pos_a - 2000 and p < pos_a + 2000 and z + 50 >= abs(p - pos_a) and z + 50 >= coalesce(q90, 0)),
rb as (select i.junction_key, target from t join i on chr = chr_b left join q on q.junction_key = target and q.chr = chr_a where not known and p >= pos_b - 2000 and p < pos_b + 2000 and z + 50 >= abs(p - pos_b) and z + 50 >= coalesce(q90, 0) and target not in (select target from ra)),
routes as (select i.junction_key, target, 'dup' route from t join i on chr = chr_a where known and p >= pos_a and p < pos_b and length <= 1.2 * z union select junction_key, target, 'a' from ra union select junction_key, target, 'b' from rb)"""


def routes_of(j: DataFrame, seg: DataFrame) -> DataFrame:
    split = seg.where(segments.IS_SPLIT).select("read_id", "ref_id", "segment_length").where("segment_length is not null")
    reads = j.select("junction_key", F.explode("supp_read_ids").alias("read_id")).distinct()
    lengths = reads.join(split, "read_id").groupBy("junction_key", F.col("ref_id").alias("chr")).agg(F.percentile("segment_length", 0.9).alias("q90"))
    return rearrangements.long_insertions(j, lengths)


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = _jun(spark, d)
    return j, routes_of(j, _seg(spark, d))


@query(f"with {_ROUTES} select * from routes")
def long_insertions(spark: SparkSession, d: str) -> DataFrame:
    """Insertions that belong to a duplication or to another junction nearby, and by which end."""
    return _routes(spark, d)[1]


@query(f"""with {_ROUTES}, m as (select junction_key, genome_id, hp1, unnest(supp_read_ids) read, 1 from jun where junction_key in (select target from routes)
  union all select target, genome_id, hp1, unnest(supp_read_ids), 1 from (select distinct junction_key, target from routes) r join jun using (junction_key)),
k as (select junction_key, genome_id, hp1 from jun where junction_key in (select target from routes) union select target, genome_id, hp1 from routes join jun using (junction_key))
select k.*, count(distinct read) supp, coalesce(string_agg(distinct read, ',' order by read), '') reads from k left join m on m.junction_key = k.junction_key and m.genome_id = k.genome_id and m.hp1 is not distinct from k.hp1 group by all""")
def moved_support(spark: SparkSession, d: str) -> DataFrame:
    """Support of junctions that take insertions, with the reads that come with these."""
    return rearrangements.moved_support(*_routes(spark, d))


@query(f"""with {JUN}, e as (select junction_key, supp_read_ids, 'a' side, chr_a chr, dir_a dir, pos_a pos from jun where dir_a is not null union all select junction_key, supp_read_ids, 'b', chr_b, dir_b, pos_b from jun where dir_b is not null)
{_islands("e", "chr, dir", "pos", 50, "cluster", "ec")}, mx as (select chr, dir, cluster from ec group by all having min(side) <> max(side)),
r as (select chr, dir, cluster, count(distinct read) n from (select chr, dir, cluster, unnest(supp_read_ids) read from ec) group by all)
select distinct junction_key, side, coalesce(n, 0) n_reads from ec join mx using (chr, dir, cluster) left join r using (chr, dir, cluster)""")
def shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.shared_evidence(_jun(spark, d))


@query(f"""{_REACH}, k as (select distinct junction_key, component from edges join comp on node = src), big as (select component from k group by all having count(*) > 1),
t as (select distinct junction_key, case when chr_a <> chr_b then 'Interchr' else case when dir_a > 0 then 'H' else 'T' end || case when dir_b > 0 then 'H' else 'T' end end what from jun)
select component, what, count(distinct junction_key) n_junctions from k join big using (component) join t using (junction_key) group by all""")
def component_orientations(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return rearrangements.component_orientations(edges, graph.components(edges, "src", "dst"), _jun(spark, d))


@query(f"""with {JUN}, k as (select junction_key, chr_a, pos_a, dir_a, chr_b, pos_b, dir_b, sum(supp)::bigint supp, count(*) n, string_agg(distinct genome_id, ',' order by genome_id) genomes, min(coalesce(hp1, 0)) hp1, min(coalesce(hp2, 0)) hp2,
    min(phaseset1) ps1, min(phaseset2) ps2 from jun where pos_b is not null and dir_a is not null and dir_b is not null and supp is not null group by all),
v as (select *, case when chr_a <> chr_b then pos_a else pos_b end far, chr_a chr, pos_a pos, dir_a dir, hp1 hp, ps1 ps from k union all select *, pos_a, chr_b, pos_b, dir_b, hp2, ps2 from k where chr_a <> chr_b),
f as (select i.genomes, i.chr, i, j, least(abs(i.pos_a - j.pos_a), abs(i.far - j.far)) w from v i join v j on i.genomes = j.genomes and i.chr = j.chr and i.dir = -j.dir and i.junction_key <> j.junction_key
  and abs(i.pos - j.pos) <= 2000000 and (j.pos > i.pos or j.pos = i.pos and j.dir < i.dir) and abs(i.supp - j.supp) <= least(greatest(0.5 * i.supp, 4), 10)
  and not (i.n = 1 and i.hp <> 0 and coalesce(i.ps = j.ps, false) and j.hp <> 0 and j.hp <> i.hp)),
p as (select * from f qualify row_number() over (partition by genomes, chr, i.junction_key, i.pos, i.dir order by w, j.pos, j.junction_key) = 1),
u as (select distinct genomes, chr, least(i.junction_key, j.junction_key) x, greatest(i.junction_key, j.junction_key) y from p),
busy as (select genomes, chr, m from (select genomes, chr, unnest([x, y]) m from u) group by all having count(*) > 1),
q as (select *, case when i.dir_a = 1 then i else j end a, case when i.dir_a = 1 then j else i end b, (genomes, chr, i.junction_key) in (select (genomes, chr, m) from busy) or (genomes, chr, j.junction_key) in (select (genomes, chr, m) from busy) many from p),
r as (select *, a.pos_a - 50 < b.pos_a and b.pos_a < a.pos_b and a.pos_b < b.pos_b + 50 lock, array_to_string(list_transform(list_sort([struct_pack(p := a.pos_a, d := a.dir_a), struct_pack(p := a.pos_b, d := a.dir_b), struct_pack(p := b.pos_a, d := b.dir_a),
  struct_pack(p := b.pos_b, d := b.dir_b)]), lambda t: case when t.d > 0 then '+' else '-' end), '') t from q)
select distinct i.junction_key key_i, j.junction_key key_j, chr, case when many then 'complex_inv' when a.chr_a <> a.chr_b or b.chr_a <> b.chr_b then 'inv_tra'
  when lock and a.pos_b - b.pos_a > 0.95 * (b.pos_b - a.pos_a) and abs((b.pos_b - a.pos_a) - (a.pos_b - b.pos_a)) < 200 then 'INV' when lock then 'reciprocal_inv_del' when b.pos_a - 50 < a.pos_a and a.pos_a < b.pos_b + 50 then 'dup_inv_segment'
  when t in ('--++', '-++-') then 'dup_inv_segment' when t = '+--+' then 'Templated_ins_inv' else 'complex_inv' end what from r""")
def paired_inversions(spark: SparkSession, d: str) -> DataFrame:
    """Junctions of the same genomes whose ends face each other, and what each two make."""
    return rearrangements.paired_inversions(_jun(spark, d))


# The graph of junctions that the connections of reads make: its nodes are the places where connections end.


@query(f"""with recursive {_DET}, x as (select distinct node_a src, node_b dst from det), u as (select src a, dst b from x union select dst, src from x),
reach(a, b) as (select a, b from u union select reach.a, u.b from reach join u on reach.b = u.a), comp as (select a node, least(a, min(b)) component from reach group by a)
select component, count(distinct node) n_nodes, count(distinct (src, dst)) n_junctions from comp join x on src = node or dst = node group by all""")
def detected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the places that detected junctions link, with their places and junctions."""
    conns = evidence.connections(_seg(spark, d))
    found = evidence.detected(conns, evidence.places(conns)).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst")).distinct()
    parts = graph.components(found, "src", "dst")
    links = found.join(parts.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("n_junctions"))
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).join(links, "component")


@query(f"""with {JUN}, k as (select junction_key, concat_ws('_', genome_id, coalesce(hp1, 0), coalesce(hp2, 0)) genome_hp, max(is_pass) l, sum(supp)::bigint s, max(vaf) v from jun group by all),
j as (select distinct junction_key from k), g as (select distinct genome_hp from k)
select junction_key, genome_hp, coalesce(l, '') "label", coalesce(s, 0) support, coalesce(v, 0) vaf from j cross join g left join k using (junction_key, genome_hp)""")
def support_by_haplotype(spark: SparkSession, d: str) -> DataFrame:
    """The table with columns for each genome and pair of haplotypes, as rows."""
    return rearrangements.support_rows(rearrangements.support_by_haplotype(_jun(spark, d)))


@query(f"""with {JUN}, e as (select distinct junction_key, 'a' side, chr_a || ':' || pos_a t, dir_a dir from jun where dir_a is not null union select junction_key, 'b', chr_b || ':' || pos_b, dir_b from jun where dir_b is not null)
select junction_key, side, case when dir > 0 then '+' else '-' end || t "name", case when dir > 0 then '-' else '+' end || t turned, case when dir = 1 then t else '' end left_of, case when dir = -1 then t else '' end right_of from e""")
def end_names(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.end_names(_jun(spark, d))


# The graph whose nodes are genomic segments, with the links of reference adjacencies, shared ends and groups.

_SEGMENTS = f"""{JUN}, {_NEAR}, se as (select genome_id, junction_key, chr, dir, pos, chr || ':' || least(pos, other) || ':' || greatest(pos, other) node from nbr),
sx as (select genome_id, junction_key, chr_a, dir_a, pos_a, chr_b, dir_b, pos_b, coalesce(sum(supp), 0)::bigint supp from jun where dir_a is not null and dir_b is not null group by all),
edges as (select a.node src, b.node dst, sx.genome_id, sx.junction_key, sx.supp from sx join se a on a.genome_id = sx.genome_id and a.junction_key = sx.junction_key and (a.chr, a.dir, a.pos) = (chr_a, dir_a, pos_a)
  join se b on b.genome_id = sx.genome_id and b.junction_key = sx.junction_key and (b.chr, b.dir, b.pos) = (chr_b, dir_b, pos_b)),
ap as (select genome_id, chr, pos, dir, sum(supp)::bigint s from e where supp is not null group by all),
aq as (select n.genome_id, n.chr, n.pos, n.s, (select max((q.pos, q.s)) from ap q where q.genome_id = n.genome_id and q.chr = n.chr and q.dir = 1 and q.pos < n.pos) q from ap n where n.dir = -1),
adj as (select genome_id, chr, q[1] plus_pos, pos minus_pos from aq where abs(q[2] - s) <= least(q[2], s) and pos - q[1] <= 1000000),
sh as (select *, lead(struct_pack(k := junction_key, s := supp)) over (partition by genome_id, chr, pos, dir order by junction_key, supp) y from (select distinct genome_id, chr, pos, dir, junction_key, supp from e where supp is not null)),
gr as (select distinct junction_key, gr_id from jun where gr_id is not null), gn as (select distinct gr_id, node from gr join se using (junction_key)),
links as (select p.node src, q.node dst from adj join se p on p.genome_id = adj.genome_id and p.chr = adj.chr and p.dir = 1 and p.pos = plus_pos join se q on q.genome_id = adj.genome_id and q.chr = adj.chr and q.dir = -1 and q.pos = minus_pos
  union select p.node, q.node from sh join se p on p.genome_id = sh.genome_id and p.chr = sh.chr and p.pos = sh.pos and p.junction_key = sh.junction_key join se q on q.genome_id = sh.genome_id and q.chr = sh.chr and q.pos = sh.pos and q.junction_key = sh.y.k
    where abs(sh.supp - sh.y.s) < least(sh.supp, sh.y.s)
  union select node, min(node) over (partition by gr_id) from gn),
sl as (select src a, dst b from edges union select dst, src from edges union select src, dst from links union select dst, src from links),
reach(a, b) as (select a, b from sl union select reach.a, sl.b from reach join sl on reach.b = sl.a), comp as (select a node, least(a, min(b)) component from reach group by a)"""


def _segment_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    j = _jun(spark, d)
    ends = rearrangements.segment_ends(j, load(spark, d, "contigs"))
    edges = cut(rearrangements.segment_edges(j, ends))
    links = rearrangements.segment_links(ends, calls.reference_adjacent(j), calls.shared_ends(j), j.select("junction_key", "gr_id"))
    return j, edges, graph.components(edges.select("src", "dst").unionByName(links), "src", "dst")


@query(f"with {_SEGMENTS.split('adj as')[0].rsplit('ap as', 1)[0].rstrip().rstrip(',')} select src, dst, genome_id, count(*) n, sum(supp)::bigint support from edges group by all")
def segment_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between genomic segments, with their junctions and support in each genome."""
    j = _jun(spark, d)
    edges = rearrangements.segment_edges(j, rearrangements.segment_ends(j, load(spark, d, "contigs")))
    return edges.groupBy("src", "dst", "genome_id").agg(F.count(F.lit(1)).alias("n"), F.sum("supp").alias("support"))


@query(f"""with recursive {_SEGMENTS}, k as (select component, count(distinct junction_key) n_junctions from edges join comp on node = src group by all having count(distinct junction_key) > 1)
select component, count(*) n_nodes, n_junctions from comp join k using (component) group by all""")
def segment_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of genomic segments with more than one junction."""
    _, edges, parts = _segment_graph(spark, d)
    return rearrangements.component_sizes(edges, parts)


@query(f"""with recursive {_SEGMENTS}, k as (select distinct junction_key, component from edges join comp on node = src), big as (select component from k group by all having count(*) > 1),
g as (select junction_key, genome_id, coalesce(sum(supp), 0)::bigint s, max(genotype) g, max(vaf) v, max(vcf_sv_type) t, max(sv_type) u, max(chr_a) ca, max(chr_b) cb, max(dir_a) da, max(dir_b) db, max(phaseset1) p1, max(phaseset2) p2 from jun group by all),
a as (select junction_key, string_agg(s::varchar, ',' order by genome_id) read_support, round(max(v), 6) vaf, string_agg(coalesce(g, ''), ',' order by genome_id) genotypes, string_agg(genome_id, ',' order by genome_id) genome_ids, max(g) gt, max(t) vcf_sv_type, max(u) sv_type,
  max(ca) ca, max(cb) cb, max(da) da, max(db) db, max(p1) p1, max(p2) p2 from g group by all)
select component, junction_key, read_support, vaf, genotypes, vcf_sv_type, sv_type, case when da = db then 'HH/TT' when da = 1 then 'HT' else 'TH' end direction, case when ca = cb then 'intra' else 'inter' end contigs,
  case when gt = 'het' then concat_ws(',', p1, p2) else '' end phaseblock, genome_ids from k join big using (component) join a using (junction_key)""")
def cluster_table(spark: SparkSession, d: str) -> DataFrame:
    """Junctions of components of genomic segments, in the columns of a cluster file."""
    j, edges, parts = _segment_graph(spark, d)
    return rearrangements.cluster_table(edges, parts, j)


@query(f"""with {JUN}, {_NEAR}, {_COV.replace(SEG, '').lstrip(", ")}, g as (select distinct genome_id, chr ref_id, least(pos, other) s, greatest(pos, other) t from nbr),
b as (select genome_id, ref_id, s, t, unnest(generate_series(s // 1000, t // 1000)) bin from g),
f as (select b.*, h.haplotype, coalesce(n, 0) n from b cross join (values (0), (1), (2)) h(haplotype) left join cov using (genome_id, ref_id, bin, haplotype))
select genome_id, ref_id, s start_pos, t end_pos, haplotype, floor(median(n))::bigint coverage from f group by all""".replace(f"with {JUN}", f"with {SEG.strip()}, {JUN.strip()}"))
def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whole median coverage of each genomic segment by haplotype; bins without segments count as 0."""
    found = rearrangements.neighbours(_jun(spark, d), load(spark, d, "contigs"))
    spans = found.select("genome_id", F.col("chr").alias("ref_id"), F.least("pos", "other").alias("start_pos"), F.greatest("pos", "other").alias("end_pos")).distinct()
    wanted = spans.withColumns({"low": F.floor(F.col("start_pos") / 1000), "high": F.floor(F.col("end_pos") / 1000)})
    return calls.median_depth(cut(wanted), segments.coverage_histogram(_seg(spark, d)), ["genome_id", "ref_id", "start_pos", "end_pos", "haplotype"], (0, 1, 2)).withColumnRenamed("depth", "coverage")


# Alignments written as CIGAR from the segments, and cut into segments again.


@query(f"""with {SEG}, a as (select seg_id, ref_start s, ref_end e, ref_end - ref_start n, abs(coalesce(read_start, 0)) h, case when strand = 1 then 700 else 30 end t from split where ref_end > ref_start + 100)
select seg_id, 'split' kind, s ref_start, e + 60 ref_end, n + 45 segment_length from a union all select seg_id, 'insertion', s + 100, s + 100, 45 from a
union all select seg_id, 'clip', s, s, h from a where h > 500 union all select seg_id, 'clip', e + 60, e + 60, t from a where t > 500""")
def cigar_segments(spark: SparkSession, d: str) -> DataFrame:
    """Split segments written as alignments with clips, an insertion of 45 and three deletions of 20, and cut into pieces again: the deletions are absorbed."""
    own = _seg(spark, d).where(segments.IS_SPLIT).where("ref_end > ref_start + 100")
    size, head, tail = F.col("ref_end") - F.col("ref_start"), F.abs(F.coalesce("read_start", F.lit(0))), F.when(F.col("strand") == 1, 700).otherwise(30)
    text = F.concat(F.when(head > 0, F.concat(head, F.lit("S"))).otherwise(""), F.lit("100M45I"), size - 100, F.lit("M20D20D20D"), tail, F.lit("S"))
    aligned = own.select(
        F.col("seg_id").cast("string").alias("read_id"), "genome_id", "ref_id", F.col("ref_start").alias("reference_start"), cigar.parse(text).alias("cigar"), (F.col("strand") != 1).alias("is_reverse"), F.lit(False).alias("is_secondary"),
        F.lit(False).alias("is_unmapped"), F.lit(60).alias("mapping_quality"), F.lit(0).alias("nm"), F.lit(0).alias("hp"), F.lit(None).cast("string").alias("query_sequence"),
    )
    return cigar.segments(aligned).select(F.col("read_id").cast("long").alias("seg_id"), "kind", "ref_start", "ref_end", "segment_length")
