"""Queries of the further call operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import calls, graph, islands, junctions, segments
from strandline.plans.reference import JUN, PAIRS, SEG, _COV, _islands, _jun, _seg
from strandline.plans.reference_joins import _GRAPH, _REACH, REPEATS, _edges, _positions, _repeats, types_of
from strandline.plans.reference_joins import SQL as joined
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


_ENDS = f"""{PAIRS}, ends as (select genome_id, read_id, seg_id, chr_a chr, dir_a dir, pos_a pos from pairs union all select genome_id, read_id, seg_id, chr_b, dir_b, pos_b from pairs){_islands("ends", "chr, dir", "pos", 50, "cluster", "ec")}"""


@query(f"""with {_ENDS}, l as (select * from ec qualify count(*) over (partition by chr, dir, cluster) >= 2)
select genome_id, read_id, seg_id, count(*) n_ends from l group by all""")
def matched_ends(spark: SparkSession, d: str) -> DataFrame:
    return calls.matched_ends(segments.adjacent_pairs(_seg(spark, d)))


@query(f"""with {PAIRS}{_islands("pairs", "chr_a, dir_a", "pos_a", 50, "cluster_a", "pa")}{_islands("pa", "chr_b, dir_b", "pos_b", 50, "cluster_b", "pb")},
j as (select chr_a, dir_a, cluster_a, chr_b, dir_b, cluster_b, count(*) m from pb group by all),
s as (select chr_a chr, dir_a dir, cluster_a "cluster", m from j union all select chr_b, dir_b, cluster_b, m from j)
select chr, dir, "cluster", sum(m)::bigint n, coalesce(sum(m) filter (m >= 2), 0)::bigint n_paired, count(*) filter (m >= 2) partners from s group by all
having sum(m) >= 2 and (count(*) filter (m >= 2) = 0 or sum(m) - coalesce(sum(m) filter (m >= 2), 0) > 0.67 * sum(m) or count(*) filter (m >= 2) > 7)""")
def single_ends(spark: SparkSession, d: str) -> DataFrame:
    return calls.single_ends(segments.adjacent_pairs(_seg(spark, d)))


@query(f"""with {JUN}, e as (select junction_key, chr_a chr, dir_a dir, pos_a pos, 'a' side from jun where dir_a is not null union all select junction_key, chr_b, dir_b, pos_b, 'b' from jun where dir_b is not null)
{_islands("e", "chr, dir", "pos", 50, "cluster", "ec")} select chr, dir, cluster, count(distinct junction_key) n_junctions from ec group by chr, dir, cluster having min(side) <> max(side)""")
def breakend_groups(spark: SparkSession, d: str) -> DataFrame:
    return calls.breakend_groups(_jun(spark, d))


def _fold(source: str, side: str, to: str) -> str:
    other = "hp2" if side == "hp1" else "hp1"
    return f""",
{to}_s as (select junction_key, genome_id, {side}, sum(supp) s from {source} group by all),
{to}_t as (select *, max(case when {side} > 0 then struct_pack(s := s, m := -{side}) end) over (partition by junction_key, genome_id) t from {to}_s),
{to}_m as (select junction_key, genome_id, {side}, case when t is not null and ({side} = 0 or t.s * 0.66 > s) then -t.m else {side} end v from {to}_t),
{to} as (select junction_key, genome_id, v::int {side}, {other}, supp from {source} join {to}_m using (junction_key, genome_id, {side}))"""


@query(f"""with {JUN}, a as (select * from jun where supp is not null and hp1 is not null and hp2 is not null){_fold("a", "hp1", "f")}{_fold("f", "hp2", "g")}
select junction_key, genome_id, hp1, hp2, sum(supp)::bigint supp from g group by all""")
def merged_haplotypes(spark: SparkSession, d: str) -> DataFrame:
    return calls.merged_haplotypes(_jun(spark, d).where("supp is not null and hp1 is not null and hp2 is not null").select("junction_key", "genome_id", "hp1", "hp2", "supp"))


_KMERS = "case when length({0}) > 6 then list_distinct([substr({0}, i, 6) for i in range(1, length({0}) - 5)]) else [] end"


@query(f"""with {SEG}, i as (select seg_id, ref_id, ref_end, segment_length l, ins_seq from seg where is_insertion and is_pass = 'PASS' and segment_length is not null and ins_seq is not null)
{_islands("i", "ref_id", "ref_end", 1000, "cluster", "ic")},
v as (select distinct ref_id, cluster, l from ic),
n as (select *, coalesce(l - lag(l) over w > greatest(50, 0.25 * lag(l) over w), true)::int nw from v window w as (partition by ref_id, cluster order by l)),
lv as (select ref_id, cluster, l, sum(nw) over (partition by ref_id, cluster order by l) as level from n),
z as (select * from ic join lv using (ref_id, cluster, l)),
m as (select ref_id, cluster, level, floor(median(ref_end)) mp, floor(median(l)) ml from z group by all),
f as (select ref_id, cluster, level, arg_min(struct_pack(seg_id := seg_id, ins_seq := ins_seq, l := l), (abs(ref_end - mp) + abs(l - ml), seg_id)) f from z join m using (ref_id, cluster, level) group by all),
k as (select seg_id, l, f, {_KMERS.format("ins_seq")} k, {_KMERS.format("f.ins_seq")} r from z join f using (ref_id, cluster, level))
select seg_id, f.seg_id representative from k where len(list_intersect(k, r)) > 0.7 * len(r) - greatest(abs(l - f.l), 50)""")
def insertion_consensus(spark: SparkSession, d: str) -> DataFrame:
    return calls.consensus(_seg(spark, d))


@query(f"""with {SEG}, b as (select genome_id, ref_id chr_x, read_end, mismatch_rate m, lead(struct_pack(ref_id := ref_id, read_start := read_start, m := mismatch_rate)) over (partition by genome_id, read_id order by align_start nulls first, read_start nulls first, seg_id) y
  from split where mismatch_rate is not null)
select genome_id, chr_x, y.ref_id chr_y, floor(median(read_end - y.read_start))::bigint "overlap", case when median(m) > median(y.m) then 'x' else 'y' end side from b where y is not null and read_end - y.read_start >= 50 group by all""")
def overlap_shifts(spark: SparkSession, d: str) -> DataFrame:
    return calls.overlap_shift(_seg(spark, d))


@query(f"""with {_COV}, {JUN}, o as (select junction_key, genome_id, coalesce(hp1, 0) haplotype, chr_a ref_id, pos_a // 1000 lo, pos_b // 1000 hi, vcf_sv_type, max(supp) supp from jun
  where vcf_sv_type in ('DUP', 'DEL') and chr_a = chr_b and pos_b > pos_a and supp is not null group by all),
k as (select distinct junction_key, genome_id, haplotype, ref_id, lo, hi from o),
ib as (select junction_key, genome_id, haplotype, ref_id, unnest(generate_series(lo, hi)) bin from k),
ob as (select junction_key, genome_id, haplotype, ref_id, unnest(generate_series(lo - 5, lo - 1) || generate_series(hi + 1, hi + 5)) bin from k),
i as (select junction_key, genome_id, haplotype, floor(median(coalesce(n, 0))) d from ib left join cov using (genome_id, haplotype, ref_id, bin) group by all),
f as (select junction_key, genome_id, haplotype, floor(median(coalesce(n, 0))) d from ob left join cov using (genome_id, haplotype, ref_id, bin) group by all)
select junction_key, genome_id, haplotype, case vcf_sv_type when 'DUP' then 'tandem_duplication' else 'DEL' end call
from o join i using (junction_key, genome_id, haplotype) join f using (junction_key, genome_id, haplotype)
where vcf_sv_type = 'DUP' and i.d > f.d + 0.5 * supp or vcf_sv_type = 'DEL' and i.d < f.d - 1.5 * supp""")
def coverage_calls(spark: SparkSession, d: str) -> DataFrame:
    return calls.coverage_calls(_jun(spark, d), segments.coverage_histogram(_seg(spark, d)))


@query(f"""with {_COV}, {JUN}, p as (select *, coalesce(hp1, 0) h, coalesce(hp2, 0) h2, coalesce(is_dup, false) known from jun where is_pass = 'PASS' and pos_b is not null),
e as (select chr_a c, pos_a x from p where length <= 5000 union select chr_b, pos_b from p where length <= 5000),
o as (select junction_key, genome_id, h, h2, chr_a, pos_a, pos_b, supp, known, coalesce(dir_a = 1 and dir_b = -1, false) del, coalesce(dir_a = -1 and dir_b = 1, false) dup,
  not exists (select 1 from e where c = chr_a and x > pos_a and x < pos_b) alone from p where chr_a = chr_b and pos_b >= pos_a),
k as (select distinct junction_key, genome_id, h, h2, chr_a ref_id, pos_a // 1000 lo, pos_b // 1000 hi, coalesce(g.length // 1000, pos_b // 1000 + 5) top from o left join contigs g on g.ref_id = chr_a),
ib as (select junction_key, genome_id, h, h2, ref_id, h haplotype, unnest(generate_series(lo, least(hi, top))) bin from k),
ob as (select junction_key, genome_id, h, h2, ref_id, h haplotype, unnest(generate_series(greatest(lo - 5, 0), lo - 1)) bin from k
  union all select junction_key, genome_id, h, h2, ref_id, h2, unnest(generate_series(hi, least(hi + 4, top))) from k),
i as (select junction_key, genome_id, h, h2, floor(median(coalesce(n, 0))) d from ib left join cov using (genome_id, haplotype, ref_id, bin) group by all),
f as (select junction_key, genome_id, h, h2, floor(median(coalesce(n, 0))) d from ob left join cov using (genome_id, haplotype, ref_id, bin) group by all),
b as (select o.*, i.d inner_d, f.d outer_d from o left join i using (junction_key, genome_id, h, h2) left join f using (junction_key, genome_id, h, h2)),
t as (select junction_key, genome_id, h haplotype, case when del and (alone or pos_b - pos_a <= 10000 or inner_d < outer_d - 1.5 * supp) then 'DEL'
  when known or dup and (alone or inner_d > outer_d + 0.5 * supp) then 'tandem_duplication' end call from b)
select distinct * from t where call is not null""")
def typed_by_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All duplications and deletions: short or lone ones as they are, the rest if median coverage bears them out."""
    return calls.typed_by_coverage(_jun(spark, d), segments.coverage_histogram(_seg(spark, d)), load(spark, d, "contigs"))


@query(f"""with {JUN}, i as (select * from jun where chr_a = chr_b and dir_a = dir_b and supp is not null and pos_b >= pos_a),
m as (select p.junction_key key_p, struct_pack(d := abs(p.pos_a - m.pos_a) + abs(p.pos_b - m.pos_b), k := m.junction_key, pa := p.pos_a, pb := p.pos_b, ma := m.pos_a, mb := m.pos_b) x
  from i p join i m on p.chr_a = m.chr_a and p.dir_a = 1 and m.dir_a = -1 and abs(p.pos_a - m.pos_a) <= 2000000 and abs(p.supp - m.supp) <= least(greatest(0.5 * p.supp, 4), 10)),
b as (select key_p, min(x) b from m group by all),
c as (select key_p, b.k key_m, b.pa, b.pb, b.ma, b.mb, b.pa - 50 < b.ma and b.ma < b.pb and b.pb < b.mb + 50 crossing from b)
select key_p, key_m, case when crossing and least(pb - pa, mb - ma) > 0.95 * greatest(pb - pa, mb - ma) and abs((pb - pa) - (mb - ma)) < 200 then 'INV' when crossing then 'reciprocal_inv_del'
  when ma - 50 < pa and pa < mb + 50 then 'dup_inv_segment' else 'complex_inv' end what from c""")
def complex_inversions(spark: SparkSession, d: str) -> DataFrame:
    return calls.complex_inversions(_jun(spark, d))


@query(f"""with {SEG}, {JUN}, sec as (select ref_id, unnest([ref_start, ref_end]) p from split where not coalesce(is_primary, false)),
e as (select junction_key, genome_id, hp1, hp2, supp, chr_a c, pos_a x, 1 side from jun where supp is not null union all select junction_key, genome_id, hp1, hp2, supp, chr_b, pos_b, 2 from jun where supp is not null)
select distinct junction_key, genome_id from (select junction_key, genome_id, hp1, hp2, supp, side from e join sec on c = ref_id and abs(x - p) <= 50 group by all having count(*) >= greatest(0.3 * supp, 2))""")
def inconsistent_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Junctions within 50 of whose ends too many segments begin or end that aren't primary."""
    other = _seg(spark, d).where(segments.IS_SPLIT).where("not coalesce(is_primary, false)")
    return calls.inconsistent(_jun(spark, d), other.select("ref_id", F.explode(F.array("ref_start", "ref_end")).alias("position")))


@query(f"""with {SEG}, {JUN}, {REPEATS},
i as (select genome_id, read_id, seg_id, ref_id, ref_end x, ref_end y, segment_length c from seg where is_insertion and segment_length is not null),
s as (select *, lead(struct_pack(ref_id := ref_id, strand := strand, ref_start := ref_start, ref_end := ref_end, read_start := read_start)) over (partition by genome_id, read_id order by align_start nulls first, read_start nulls first, seg_id) n from split where read_end is not null),
g as (select genome_id, read_id, seg_id, ref_id, case when strand = 1 then ref_end else n.ref_end end a, case when strand = 1 then n.ref_start else ref_start end b, n.read_start - read_end r from s where n.ref_id = ref_id and n.strand = strand),
e as (select * from i union all select genome_id, read_id, seg_id, ref_id, least(a, b), greatest(a, b), r - (b - a) from g),
m as (select e.*, low, high from e join rep on chr_a = ref_id and x between low and high qualify count(*) over (partition by genome_id, read_id, seg_id) = 1)
select genome_id, read_id, ref_id, low, high, sum(c)::bigint net from m where y <= high group by all""")
def repeat_lengths(spark: SparkSession, d: str) -> DataFrame:
    return calls.repeat_lengths(_seg(spark, d), _repeats(_jun(spark, d)).withColumnRenamed("chr_a", "ref_id"))


@query(f"""with {JUN}, {REPEATS}, m as (select distinct junction_key, chr_a, pos_a, low, high from jun join rep using (chr_a) where pos_a between low and high)
select junction_key, low, high from m semi join (select chr_a, low, high from m group by all having count(distinct junction_key) > 3) using (chr_a, low, high)""")
def crowded_repeats(spark: SparkSession, d: str) -> DataFrame:
    j = _jun(spark, d)
    return calls.crowded_repeats(j, _repeats(j))


_DIRS = "e as (select genome_id, junction_key, supp, chr_a chr, pos_a pos, dir_a dir from jun where dir_a is not null union all select genome_id, junction_key, supp, chr_b, pos_b, dir_b from jun where dir_b is not null)"


@query(f"""with {JUN}, {_DIRS},
x as (select l.genome_id, l.chr, l.pos start_pos, l.junction_key key_l, (select min((r.pos, r.junction_key)) from e r where r.genome_id = l.genome_id and r.chr = l.chr and r.dir = 1 and r.pos > l.pos) r from e l where l.dir = -1)
select genome_id, chr, start_pos, r[1] end_pos, key_l, r[2] key_r from x where r[1] - start_pos <= 2000000""")
def genomic_segments(spark: SparkSession, d: str) -> DataFrame:
    return calls.facing_ends(_jun(spark, d))


@query(f"""with {JUN}, {_DIRS}, p as (select genome_id, chr, pos, dir, sum(supp)::bigint s from e where supp is not null group by all),
x as (select m.genome_id, m.chr, m.pos, m.s, (select max((q.pos, q.s)) from p q where q.genome_id = m.genome_id and q.chr = m.chr and q.dir = 1 and q.pos < m.pos) q from p m where m.dir = -1)
select genome_id, chr, q[1] plus_pos, pos minus_pos from x where abs(q[2] - s) <= least(q[2], s) and pos - q[1] <= 1000000""")
def reference_adjacencies(spark: SparkSession, d: str) -> DataFrame:
    return calls.reference_adjacent(_jun(spark, d))


@query(f"""{_REACH}, s as (select component, count(distinct junction_key) n_junctions, count(*) n_rows, string_agg(distinct genome_id, ',' order by genome_id) genomes, count(*) filter (not coalesce(vcf_sv_type in ('DEL', 'INS', 'INV'), false)) other
  from edges join comp on node = src group by all), n as (select component, count(*) n_nodes from comp group by all)
select component, n_junctions, n_nodes, genomes, case when other = 0 and n_rows <= 1.5 * n_nodes then 'simple' else 'complex' end kind, case when other = 0 and n_rows <= 1.5 * n_nodes then 4 else n_rows + 2 end rank
from s join n using (component) where n_junctions > 1""")
def component_table(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return calls.component_table(edges, graph.components(edges, "src", "dst"))


_FACE = """e as (select genome_id, junction_key, supp, supp_read_ids, chr_a chr, pos_a pos, dir_a dir, hp1 hp, phaseset1 ps from jun where dir_a is not null
  union all select genome_id, junction_key, supp, supp_read_ids, chr_b, pos_b, dir_b, hp2, phaseset2 from jun where dir_b is not null),
l as (select * from e where dir = -1), r as (select * from e where dir = 1)"""


@query(f"""with {JUN}, {_FACE},
one as (select l.genome_id, l.junction_key, l.chr, l.pos, min(r.pos) e from l join r on l.genome_id = r.genome_id and l.chr = r.chr and r.pos > l.pos and r.pos - l.pos <= 2000000 where list_has_any(l.supp_read_ids, r.supp_read_ids) group by all),
two as (select l.genome_id, l.junction_key, l.chr, l.pos, min(r.pos) e from l join r on l.genome_id = r.genome_id and l.chr = r.chr and r.pos > l.pos and r.pos - l.pos <= 2000000
  where not coalesce(l.ps = r.ps and l.hp > 0 and r.hp > 0 and l.hp <> r.hp, false) and abs(l.supp - r.supp) < least(l.supp, r.supp) group by all),
o as (select distinct genome_id, junction_key, chr, pos from l)
select genome_id, junction_key, chr, pos start_pos, coalesce(one.e, two.e, greatest(least(pos + 2000000, length - 10000), pos)) end_pos, (case when one.e is not null then 1 when two.e is not null then 2 else 3 end)::int as level
from o left join one using (genome_id, junction_key, chr, pos) left join two using (genome_id, junction_key, chr, pos) join contigs on ref_id = chr""")
def neighbour_segments(spark: SparkSession, d: str) -> DataFrame:
    return calls.neighbour_segments(_jun(spark, d), load(spark, d, "contigs"))


@query(f"""with {SEG}, {JUN}, pts as (select distinct chr_a ref_id, pos_a as position from jun where pos_a is not null union select chr_b, pos_b from jun where pos_b is not null),
cov as (select ref_id, position, genome_id, count(*) n from pts join split using (ref_id) where position > ref_start and position < ref_end and mapq > 10 group by all),
v as (select junction_key, genome_id, chr_a, pos_a, chr_b, pos_b, coalesce(sum(supp), 0)::bigint dv from jun where is_pass <> 'FAIL_MERGED_HP' group by all),
x as (select v.*, coalesce(a.n, 0) na, coalesce(b.n, 0) nb from v left join cov a on a.ref_id = chr_a and a.position = pos_a and a.genome_id = v.genome_id left join cov b on b.ref_id = chr_b and b.position = pos_b and b.genome_id = v.genome_id),
y as (select junction_key, genome_id, dv, case when pos_b is null then greatest(na - dv, 0) else (na + nb) // 2 end dr from x)
select *, round(case when dv + dr > 0 then dv / (dv + dr) end, 6) vaf from y""")
def spanning_share(spark: SparkSession, d: str) -> DataFrame:
    j = _jun(spark, d)
    return calls.spanning_share(j, junctions.position_coverage(_positions(j), _seg(spark, d))).withColumn("vaf", F.round("vaf", 6))


@query(f"""with {JUN}, {PAIRS.strip()}, ends as (select chr_a chr, dir_a dir, pos_a pos, passed from pairs union all select chr_b, dir_b, pos_b, passed from pairs){_islands("ends", "chr, dir", "pos", 50, "cluster", "ec")},
c as (select chr, dir, cluster, floor(coalesce(median(pos) filter (passed), median(pos)))::bigint as position, count(*) n from ec group by chr, dir, cluster having count(*) >= 2),
k as (select chr_a c, pos_a p from jun where dir_a is not null union select chr_b, pos_b from jun where dir_b is not null)
select chr, dir, position, n from c where not exists (select 1 from k where k.c = chr and abs(p - position) < 100)""")
def lone_end_clusters(spark: SparkSession, d: str) -> DataFrame:
    found = junctions.end_clusters(junctions.end_positions(segments.adjacent_pairs(_seg(spark, d)))).select("chr", "dir", "position", "n")
    return calls.lone_clusters(found, _jun(spark, d))


@query(f"""with {JUN}, e as (select distinct genome_id, chr, pos, dir, junction_key, supp from (select genome_id, chr_a chr, pos_a pos, dir_a dir, junction_key, supp from jun union all select genome_id, chr_b, pos_b, dir_b, junction_key, supp from jun) where dir is not null and supp is not null),
b as (select *, lead(struct_pack(k := junction_key, s := supp)) over (partition by genome_id, chr, pos, dir order by junction_key, supp) y from e)
select genome_id, chr, pos, junction_key key_x, y.k key_y from b where y is not null and abs(supp - y.s) < least(supp, y.s)""")
def shared_ends(spark: SparkSession, d: str) -> DataFrame:
    return calls.shared_ends(_jun(spark, d))


@query(f"""with {JUN}, g as (select * from jun where is_pass = 'PASS' and vcf_qual > 0 and ((not is_single and vaf_pass = 'PASS') or (is_single and vaf >= 0.25 and vcf_qual > 55)))
select junction_key, genome_id, 'all' "set" from g union all select junction_key, genome_id, 'somatic' from g where mut_type = 'somatic'""")
def final_calls(spark: SparkSession, d: str) -> DataFrame:
    return calls.final_calls(_jun(spark, d))


@query(f"""with {JUN}, s as (select junction_key, string_agg(distinct genome_id, ',' order by genome_id) genomes from jun group by all) select genomes, count(*) n_junctions from s group by all""")
def genome_sets(spark: SparkSession, d: str) -> DataFrame:
    return calls.genome_sets(_jun(spark, d))


@query(f"""{_REACH}, k as (select distinct junction_key, component from edges join comp on node = src),
j as (select junction_key, max(chr_a) ca, max(chr_b) cb, max(dir_a) da, max(dir_b) db, sum(supp)::bigint supp, string_agg(distinct genome_id, ',' order by genome_id) genomes from jun group by all)
select component, junction_key, case when ca <> cb then 'Interchr' else case when da > 0 then 'H' else 'T' end || case when db > 0 then 'H' else 'T' end end orientation, supp, genomes
from k join j using (junction_key) where component in (select component from k group by all having count(*) > 1)""")
def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return calls.cluster_rows(edges, graph.components(edges, "src", "dst"), _jun(spark, d))


# Components of the graph with the links that are no junctions.

_LINKS = f"""with recursive {_GRAPH}, pj as (select * from jun where chr_b is not null and is_pass = 'PASS'),
le as (select genome_id, supp, chr_a chr, pos_a pos, dir_a dir from pj union all select genome_id, supp, chr_b, pos_b, dir_b from pj),
lp as (select genome_id, chr, pos, dir, sum(supp)::bigint s from le where dir is not null and supp is not null group by all),
lq as (select m.genome_id, m.chr, m.pos, m.s, (select max((q.pos, q.s)) from lp q where q.genome_id = m.genome_id and q.chr = m.chr and q.dir = 1 and q.pos < m.pos) q from lp m where m.dir = -1),
la as (select distinct chr, q[1] pp, pos mp from lq where abs(q[2] - s) <= least(q[2], s) and pos - q[1] <= 1000000),
pl as (select distinct chr, pos, chr || ':' || c node from ec), ek as (select distinct junction_key, unnest([src, dst]) node from edges),
gj as (select distinct gr_id, node from (select distinct junction_key, gr_id from pj where gr_id is not null) join ek using (junction_key)),
links as (select p.node src, q.node dst from la join pl p on p.chr = la.chr and p.pos = pp join pl q on q.chr = la.chr and q.pos = mp union select node, min(node) over (partition by gr_id) from gj),
u as (select src a, dst b from edges union select dst, src from edges union select src, dst from links union select dst, src from links),
reach(a, b) as (select a, b from u union select reach.a, u.b from reach join u on reach.b = u.a), comp as (select a node, least(a, min(b)) component from reach group by a)"""


def _over_links(name: str) -> str:
    """The SQL of the query of this name over the linked components."""
    return (SQL.get(name) or joined[name]).replace(_REACH, _LINKS)


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Junction edges, and the components of their nodes when reference adjacencies and groups of junctions (gr_id) link nodes too.

    A shared end needs no link: it is one place and so one node. The nodes of a group are linked to its smallest one.
    """
    edges = _edges(spark, d)
    j = _jun(spark, d).where("chr_b is not null and is_pass = 'PASS'")
    ends = j.select("junction_key", F.inline(F.array(*[F.struct(F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos")) for e in "ab"])))
    placed = islands.gap_clusters(ends, ["chr"], "pos", 1000, "c").select("chr", "pos", F.concat_ws(":", "chr", "c").alias("node")).distinct()
    at = lambda n: placed.select("chr", F.col("pos").alias(f"{n}_pos"), F.col("node").alias(n))
    links = calls.reference_adjacent(j).select("chr", "plus_pos", "minus_pos").distinct().join(at("plus"), ["chr", "plus_pos"]).join(at("minus"), ["chr", "minus_pos"]).select(F.col("plus").alias("src"), F.col("minus").alias("dst"))
    if "gr_id" in j.columns:
        grouped = j.where("gr_id is not null").select("junction_key", "gr_id").distinct().join(edges.select("junction_key", F.explode(F.array("src", "dst")).alias("src")).distinct(), "junction_key")
        least = grouped.groupBy("gr_id").agg(F.min("src").alias("dst"))
        links = links.unionByName(grouped.join(least, "gr_id").select("src", "dst").distinct())
    return edges, graph.components(edges.select("src", "dst").unionByName(links), "src", "dst")


@query(f"{_LINKS} select component, count(*) n_nodes from comp group by all")
def linked_components(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d)[1].groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(_over_links("component_types"))
def linked_component_types(spark: SparkSession, d: str) -> DataFrame:
    """Junctions by kind of each linked component that has more than one junction."""
    return types_of(*_linked(spark, d))


@query(_over_links("component_table"))
def linked_component_table(spark: SparkSession, d: str) -> DataFrame:
    return calls.component_table(*_linked(spark, d))


@query(_over_links("cluster_rows"))
def linked_cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    return calls.cluster_rows(*_linked(spark, d), _jun(spark, d))
