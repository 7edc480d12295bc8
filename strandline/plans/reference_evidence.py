"""Queries of the evidence operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import evidence, segments
from strandline.plans.reference import _COV, BACKGROUND, CONTROL, JUN, MASK, SEG, _islands, _jun, _seg, collapsed_regions
from strandline.plans.reference_joins import _PAF, _alignments
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


_CONN = SEG + """,
cn as (select genome_id, read_id, seg_id, ref_id, ref_start, ref_end, strand, read_start, read_end, haplotype, is_pass, mapq, mismatch_rate,
    lead(struct_pack(ref_id := ref_id, ref_start := ref_start, ref_end := ref_end, strand := strand, read_start := read_start, haplotype := haplotype, is_pass := is_pass, mapq := mapq, mismatch_rate := mismatch_rate))
      over (partition by genome_id, read_id order by align_start nulls first, read_start nulls first, seg_id) y
  from split where is_pass = 'PASS' or segment_length >= 1000),
cq as (select genome_id, read_id, seg_id, y.read_start - read_end gap,
    struct_pack(chr := ref_id, pos := case when (strand = 1) = (y.read_start > read_start) then ref_end else ref_start end, dir := case when (strand = 1) = (y.read_start > read_start) then 1 else -1 end,
      hp := haplotype, passed := coalesce(is_pass = 'PASS', false), mapq := mapq, mm := mismatch_rate) p,
    struct_pack(chr := y.ref_id, pos := case when (y.strand = 1) = (y.read_start > read_start) then y.ref_start else y.ref_end end, dir := case when (y.strand = 1) = (y.read_start > read_start) then -1 else 1 end,
      hp := y.haplotype, passed := coalesce(y.is_pass = 'PASS', false), mapq := y.mapq, mm := y.mismatch_rate) q
  from cn where y is not null and y.read_start - read_end < 1000),
co as (select genome_id, read_id, seg_id, gap, case when p.pos <= q.pos then p else q end a, case when p.pos <= q.pos then q else p end b from cq),
ce as (select seg_id, a.chr chr, a.dir dir, a.pos pos, 'a' side from co union all select seg_id, b.chr, b.dir, b.pos, 'b' from co)""" + _islands("ce", "chr, dir", "pos", 50, "cluster", "ck") + """,
cw as (select seg_id, max(chr || ':' || dir || ':' || cluster) filter (side = 'a') node_a, max(chr || ':' || dir || ':' || cluster) filter (side = 'b') node_b from ck group by seg_id),
conn as (select *, a.passed and b.passed passed from co join cw using (seg_id) where node_a is not null and node_b is not null),
en as (select node_a node, a e, a.chr fc from conn union all select node_b, b, a.chr from conn),
spot as (select node, e.chr chr, e.dir dir, floor(median(e.pos) filter (e.passed))::bigint as position, floor(median(e.mapq) filter (e.passed))::bigint qual, count(*) n, count(*) filter (e.passed) n_passed,
  count(distinct fc) filter (e.passed) first_contigs from en group by all having count(*) >= 2 and count(*) filter (e.passed) > 0)"""

_DET = _CONN + """,
bo as (select * from conn where node_a in (select node from spot) and node_b in (select node from spot) and node_a <> node_b),
det as (select node_a, node_b, genome_id, a.hp hp_a, b.hp hp_b, count(distinct read_id) supp from bo where (node_a, node_b) in (select (node_a, node_b) from bo where passed) group by all)"""


def _slots(points: str) -> str:
    """CTE slots: segments at the points (ref_id, position)."""
    return f""",
pt as (select distinct ref_id, position from ({points}) where ref_id is not null and position is not null),
slots as (select pt.ref_id, position, genome_id, {", ".join(f"count(*) filter (prime and position > ref_start and position < ref_end and hp = {h}) h{h}" for h in range(3))},
  count(*) filter (not prime and position - ref_start > 50 and ref_end - position <= 50) "ends", count(*) filter (not prime and position - ref_start <= 50) starts, count(*) filter (not prime) others
  from pt join (select *, coalesce(is_primary, false) prime, coalesce(haplotype, 0) hp from split) s on s.ref_id = pt.ref_id and position between ref_start and ref_end where not prime or mapq > 10 group by all)"""


_SPOT_SLOTS = _CONN + _slots("select chr ref_id, position from spot")


@query(f"with {_CONN} select node, chr, dir, position, qual, n, n_passed, first_contigs from spot")
def breakpoint_places(spark: SparkSession, d: str) -> DataFrame:
    """Places where connections end, with their quality."""
    return evidence.places(evidence.connections(_seg(spark, d)))


@query(f"with {_SPOT_SLOTS} select * from slots")
def spanning_slots(spark: SparkSession, d: str) -> DataFrame:
    """Segments that span, begin or end at the places where connections end."""
    spots = evidence.places(evidence.connections(_seg(spark, d))).select(F.col("chr").alias("ref_id"), "position")
    return evidence.spanning_slots(spots, _seg(spark, d))


@query(f"with {_DET} select * from det")
def detected_junctions(spark: SparkSession, d: str) -> DataFrame:
    conns = evidence.connections(_seg(spark, d))
    return evidence.detected(conns, evidence.places(conns))


def _control(side: str) -> str:
    terms = " + ".join(f"case when list_contains(haps_{side}, {h}) or list_max(haps_{side}) = 0 then coalesce(c{side}.h{h}, 0) else 0 end" for h in range(3))
    return f"({terms})::bigint control_{side}"


def _fails(side: str) -> str:
    return f"""case when chr_a = chr_b and position_a > position_b then 'FAIL_MAP_CONS' when coalesce(sec_{side}, 0) >= greatest(0.3 * supp, 2) then 'FAIL_SEC_CONS'
    when n_passed_{side} < 0.5 * n_{side} or (qual_a + qual_b) / 2 < 30 then 'FAIL_MAP_CONS' when supp < 0.3 * n_passed_{side} or first_contigs_{side} > 2 then 'FAIL_CONN_CONS' end fail_{side}"""


_CHECKS = _DET + _slots("select chr ref_id, position from spot") + f""",
jk as (select node_a, node_b, sum(supp)::bigint supp, bool_or({CONTROL}) in_control, list_distinct(list(genome_id)) genomes, list_sort(list_distinct(list(coalesce(hp_a, 0)))) haps_a, list_sort(list_distinct(list(coalesce(hp_b, 0)))) haps_b from det group by all),
jj as (select jk.*, """ + ", ".join(f"{e}.{c} {c}_{e}" for e in "ab" for c in ("chr", "dir", "position", "qual", "n", "n_passed", "first_contigs")) + f""" from jk join spot a on a.node = node_a join spot b on b.node = node_b),
""" + ",\n".join(f"s{e} as (select node_a, node_b, sum(case when dir_{e} = 1 then \"ends\" else starts end)::bigint sec_{e} from (select *, unnest(genomes) genome_id from jj) j join slots on ref_id = chr_{e} and position = position_{e} and slots.genome_id = j.genome_id group by all)" for e in "ab") + f""",
gp as (select node_a, node_b, floor(median(gap))::bigint inserted, stddev_pop(gap) varies from bo where passed group by all),
cc as (select ref_id, position, sum(h0) h0, sum(h1) h1, sum(h2) h2 from slots where {CONTROL} group by all),
ch as (select jj.*, inserted, varies, {_fails("a")}, {_fails("b")}, {_control("a")}, {_control("b")} from jj left join sa using (node_a, node_b) left join sb using (node_a, node_b) left join gp using (node_a, node_b)
  left join cc ca on ca.ref_id = chr_a and ca.position = position_a left join cc cb on cb.ref_id = chr_b and cb.position = position_b),
cs as (select *, case when fail_a is null and fail_b is not null or fail_a = 'FAIL_CONN_CONS' and qual_a >= 55 and fail_b is not null then 'a' else '' end
  || case when fail_b is null and fail_a is not null or fail_b = 'FAIL_CONN_CONS' and qual_b >= 55 and fail_a is not null then 'b' else '' end single from ch),
checks as (select *, case when single = '' and not in_control and control_a <= 3 and control_b <= 3 then 'FAIL_LOWCOV_NORMAL'
  when fail_a is not null and fail_b is not null and not (fail_b = 'FAIL_CONN_CONS' and qual_b >= 55) then fail_a else 'PASS' end "label" from cs)"""


@query(f"""with {_CHECKS} select chr_a, dir_a, position_a, chr_b, dir_b, position_b, supp, fail_a, fail_b, single,
  case when fail_a is null and fail_b is null and inserted >= 50 and varies < 25 then inserted end inserted, "label" from checks""")
def junction_checks(spark: SparkSession, d: str) -> DataFrame:
    """Detected junctions with what either side fails by and what becomes of them."""
    seg = _seg(spark, d)
    return evidence.junction_checks(evidence.connections(seg), seg, F.expr(CONTROL)).drop("in_control", "haps_a", "haps_b", "control_a", "control_b", "qual_a", "qual_b")


@query(f"""with {_CHECKS} select chr_a chr, dir_a dir, position_a as position, case when dir_b > 0 then '+' else '-' end || chr_b || ':' || position_b other, supp,
  case when not in_control and control_a <= 3 then 'FAIL_LOWCOV_NORMAL' else 'PASS' end "label" from checks where single like '%a%'
union all select chr_b, dir_b, position_b, case when dir_a > 0 then '+' else '-' end || chr_a || ':' || position_a, supp, case when not in_control and control_b <= 3 then 'FAIL_LOWCOV_NORMAL' else 'PASS' end from checks where single like '%b%'""")
def one_sided_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Good ends of junctions whose other side failed, with the control's test."""
    seg = _seg(spark, d)
    return evidence.one_sided(evidence.junction_checks(evidence.connections(seg), seg, F.expr(CONTROL)))


_INS = SEG + """,
ii as (select genome_id, read_id, haplotype, ref_id, ref_end, segment_length l, mapq, coalesce(is_pass = 'PASS', false) passed from seg where is_insertion and segment_length is not null)""" + _islands("ii", "ref_id", "ref_end", 1000, "cluster", "ic") + f""",
iv as (select distinct ref_id, cluster, l from ic),
iw as (select *, coalesce(l - lag(l) over w > greatest(50, 0.25 * lag(l) over w), true)::int nw from iv window w as (partition by ref_id, cluster order by l)),
il as (select ref_id, cluster, l, sum(nw) over (partition by ref_id, cluster order by l) as level from iw),
iz as (select * from ic join il using (ref_id, cluster, l)),
ik as (select ref_id, cluster, level, floor(median(ref_end) filter (passed))::bigint as position, floor(median(l) filter (passed))::bigint length, count(distinct (genome_id, read_id)) filter (passed) supp, count(*) n, count(*) filter (passed) n_passed,
  median(mapq) filter (passed) quality, list_distinct(list(genome_id)) genomes, bool_or({CONTROL}) in_control, list_sort(list_distinct(list(coalesce(haplotype, 0)))) haps_a from iz group by all having count(*) filter (passed) > 0)""" + _slots("select ref_id, position from ik") + f""",
im as (select k.ref_id, cluster, level, sum(others) sec, sum(h0 + h1) prime from (select *, unnest(genomes) genome_id from ik) k join slots using (ref_id, position, genome_id) group by all),
ca as (select ref_id, position, sum(h0) h0, sum(h1) h1, sum(h2) h2 from slots where {CONTROL} group by all),
ix as (select ik.*, coalesce(sec, 0) sec, coalesce(prime, 0) prime, {_control("a")} from ik left join im using (ref_id, cluster, level) left join ca using (ref_id, position))"""


@query(f"""with {_INS} select ref_id, position, length, supp, case when not in_control and control_a <= 3 then 'FAIL_LOWCOV_NORMAL' when sec >= 1.5 * (prime + supp) then 'FAIL_SEC_CONS'
  when n_passed < 0.5 * n or quality < 30 then 'FAIL_MAP_CONS' else 'PASS' end "label" from ix""")
def insertion_checks(spark: SparkSession, d: str) -> DataFrame:
    return evidence.insertion_checks(_seg(spark, d), F.expr(CONTROL))


_SIMPLE = f"""{SEG}, {BACKGROUND.strip()},
rn as (select genome_id, read_id, count(*) filter (not is_insertion and not is_clipped) n, count(*) filter (is_insertion) i from seg group by all having count(*) filter (not is_insertion and not is_clipped) = 1 and count(*) filter (is_insertion) = 0),
simple as (select genome_id, read_id, haplotype, ref_id, ref_start, ref_end, read_length, align_len, mapq, mismatch_rate from split semi join rn using (genome_id, read_id) where is_primary),
rl as (select genome_id, read_id, max(read_length) l from seg where read_length > 0 group by all),
ro as (select genome_id, l, sum(l) over (partition by genome_id order by l, read_id rows unbounded preceding) c, sum(l) over (partition by genome_id) t from rl),
n90 as (select genome_id, min(l) n90 from ro where c >= ceil(t * 0.1) group by all),
good as (select s.*, coalesce(mapq > 10 and mismatch_rate < background and read_length > n90 and abs(read_length - align_len) < align_len, false) good from simple s left join bg using (genome_id) left join n90 using (genome_id))"""


@query(f"with {_SIMPLE} select * from simple")
def simple_reads(spark: SparkSession, d: str) -> DataFrame:
    return evidence.simple_reads(_seg(spark, d))


def _good(spark: SparkSession, d: str) -> DataFrame:
    seg = _seg(spark, d)
    reads = seg.where("read_length > 0").groupBy("genome_id", "read_id").agg(F.max("read_length").alias("l"))
    return evidence.good_simple_reads(evidence.simple_reads(seg), segments.background(seg), evidence.length_nx(reads, "genome_id", "l", ["0.1"]))


@query(f"with {_SIMPLE}, b as (select genome_id, haplotype, ref_id, unnest(generate_series(ref_start // 1000, ref_end // 1000)) bin from good where good) select genome_id, haplotype, ref_id, bin, count(*) n from b group by all")
def simple_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by good simple reads, both end bins included."""
    return evidence.simple_coverage(_good(spark, d))


@query(f"""with {_SIMPLE} select case when good then 'PASS' else 'FAIL' end "label", count(*) n, sum(align_len)::bigint total_length from good group by all""")
def simple_read_quality(spark: SparkSession, d: str) -> DataFrame:
    return _good(spark, d).groupBy(F.when(F.col("good"), "PASS").otherwise("FAIL").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("align_len").alias("total_length"))


def _nx(name: str, source: str) -> str:
    return f"""{name}_o as (select genome_id, l, sum(l) over (partition by genome_id order by l, u rows unbounded preceding) c, sum(l) over (partition by genome_id) t from {source}),
{name} as (select genome_id, min(l) filter (c >= ceil(t * 0.5)) n50, min(l) filter (c >= ceil(t * 0.1)) n90 from {name}_o group by all)"""


@query(f"""with {SEG}, rl as (select genome_id, read_id u, max(read_length) l from seg where read_length > 0 group by all), al as (select genome_id, seg_id u, segment_length l from split where segment_length > 0),
{_nx("rx", "rl")}, {_nx("ax", "al")}, rs as (select genome_id, count(*) n_reads, sum(l)::bigint bases from rl group by all),
q as (select genome_id, sum(segment_length)::bigint aligned, """ + ", ".join(f"round(quantile_cont({c}, {i / 4}) filter ({c} between 0 and 999), 6) {n}_q{i}" for c, n in (("error_rate", "error"), ("mismatch_rate", "mismatch")) for i in (1, 2, 3)) + """ from split group by all)
select genome_id, n_reads, bases, rx.n50 read_n50, rx.n90 read_n90, ax.n50 alignment_n50, ax.n90 alignment_n90, q.* exclude (genome_id) from rs join rx using (genome_id) join ax using (genome_id) join q using (genome_id)""")
def read_statistics(spark: SparkSession, d: str) -> DataFrame:
    return evidence.read_statistics(_seg(spark, d))


# The test tables have no file of repeats; the collapsed regions are intervals that segments lie in.
_REGIONS = f"""{SEG}, {BACKGROUND}, {MASK}{_islands("masked", "ref_id", "bin", 1, "c", "mc")},
reg as (select ref_id, c * 1000 low, (max(bin) + 1) * 1000 high from mc group by ref_id, c)"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return collapsed_regions(spark, d).withColumnsRenamed({"start_pos": "low", "end_pos": "high"})


@query(f"""with {_REGIONS}, m as (select seg_id, low, high, ref_end, segment_length from split join reg using (ref_id) where ref_start between low - 25 and high + 25 qualify count(*) over (partition by seg_id) = 1)
select seg_id, low, high from m where ref_end <= high + 25 and segment_length > 0.95 * (high - low)""")
def in_repeat_only(spark: SparkSession, d: str) -> DataFrame:
    return evidence.in_repeat_only(_seg(spark, d), _regions(spark, d))


@query(f"""with {_REGIONS} select reg.ref_id, low, high, count(distinct (genome_id, read_id)) filter (read_id is not null) n_reads from reg left join seg s on s.ref_id = reg.ref_id and not is_clipped and ref_start < low - 500 and ref_end > high + 500 group by all""")
def spanned_repeats(spark: SparkSession, d: str) -> DataFrame:
    return evidence.spanned_repeats(_seg(spark, d), _regions(spark, d))


_STANDARD = f"""{_PAF}, e as (select ref_id, ref_start p from a where ref_start is not null and ref_end is not null union all select ref_id, ref_end from a where ref_start is not null and ref_end is not null),
p as (select ref_id, p, count(*) n from e group by all),
s(ref_id, p) as (select ref_id, min(p) from p group by ref_id union all select s.ref_id, (select min(p.p) from p where p.ref_id = s.ref_id and p.p >= s.p + 50) from s where s.p is not null),
c as (select distinct s.ref_id, floor(sum(p.p * p.n) / sum(p.n))::bigint center from s join p on p.ref_id = s.ref_id and p.p >= s.p and p.p < s.p + 50 group by s.ref_id, s.p),
t as (select p.ref_id, p.p, coalesce(min(center), p.p) std from p left join c on c.ref_id = p.ref_id and abs(p.p - center) <= 50 group by p.ref_id, p.p)"""


@query(f"""with recursive {_STANDARD}, f as (select a.ref_id, x.std left_place, y.std right_place, count(*) n from a join t x on x.ref_id = a.ref_id and x.p = ref_start join t y on y.ref_id = a.ref_id and y.p = ref_end group by all)
select *, rank() over (order by n desc) number from f where n >= 2""")
def named_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments between standard places that occur at least twice, numbered by how often."""
    return evidence.named_fragments(_alignments(spark, d), 2)


@query(f"""with {_DET}, jm as (select node_a, node_b, count(*) m from conn group by all), js as (select node_a node, node_b other, m from jm union all select node_b, node_a, m from jm),
jt as (select node, sum(m) n, coalesce(sum(m) filter (m >= 2 and other in (select node from spot)), 0) p, count(*) filter (m >= 2 and other in (select node from spot)) k from js group by all),
jr as (select node, max(r) supp from (select node, genome_id, count(distinct read_id) r from (select node_a node, genome_id, read_id, a.passed ok from conn union all select node_b, genome_id, read_id, b.passed from conn) where ok group by all) group by all),
tk as (select chr, position tp from spot where node in (select node_a from det union select node_b from det) union select ref_id, unnest([10000, length - 10000]) from contigs)
select chr, dir, position, spot.n, n_passed, supp from spot join jt using (node) join jr using (node) where (k = 0 or jt.n - p > 0.67 * jt.n or k > 7) and spot.n >= 3 and n_passed >= greatest(3, 0.4 * spot.n) and supp >= 3
  and not exists (select 1 from tk where tk.chr = spot.chr and abs(tp - position) < 100)""")
def lone_ends(spark: SparkSession, d: str) -> DataFrame:
    """Places where reads end without another one to lead to."""
    return evidence.lone_ends(evidence.connections(_seg(spark, d)), load(spark, d, "contigs"))


@query(f"""with {SEG}, {JUN.strip()}, rp as (select distinct chr_a chr, vntr.vntr_start - 25 low, vntr.vntr_end + 25 high from jun where vntr is not null),
rm as (select rp.*, junction_key, supp_read_ids from rp join jun on chr_a = chr and pos_a between low and high), rr as (select distinct chr, low, high, unnest(supp_read_ids) read from rm),
rc as (select chr, low, high, count(*) n_reads from rr where read in (select read_id from split where is_pass is distinct from 'vntr_only') group by all),
rk as (select chr, low, high, count(distinct junction_key) n_junctions from rm group by all)
select chr, low, high, n_junctions, coalesce(n_reads, 0) n_reads, case when coalesce(n_reads, 0) < 2 then 'FAIL_VNTR' when n_junctions > 3 then 'FAIL_COMPLEX_VNTR' when n_junctions > 1 then 'MERGE' else 'PASS' end "label" from rk left join rc using (chr, low, high)""")
def repeat_labels(spark: SparkSession, d: str) -> DataFrame:
    """Repeats with what becomes of the junctions in them."""
    return evidence.repeat_labels(_jun(spark, d), _seg(spark, d))


@query(f"""with {_DET}, mo as (select node_a, node_b, floor(median(-gap) filter (gap < 0))::bigint o, median(a.mm) ma, median(b.mm) mb from bo where (node_a, node_b) in (select (node_a, node_b) from det) group by all having floor(median(-gap) filter (gap < 0)) >= 50),
mv as (select x.chr chr_a, x.dir dir_a, x.position pa, y.chr chr_b, y.dir dir_b, y.position pb, o, coalesce(ma > mb, false) f from mo join spot x on x.node = node_a join spot y on y.node = node_b)
select chr_a, dir_a, pa + case when not f then 0 when dir_a = -1 then o else -o end position_a, chr_b, dir_b, pb + case when f then 0 when dir_b = -1 then o else -o end position_b, o "overlap" from mv""")
def moved_ends(spark: SparkSession, d: str) -> DataFrame:
    """Junctions whose segments overlap in the read, with the end moved that fits worse."""
    return evidence.moved_ends(evidence.connections(_seg(spark, d)))


@query(f"""with {_COV}, hp as (select genome_id, ref_id, bin, coalesce(sum(n) filter (haplotype = 1), 0) a, coalesce(sum(n) filter (haplotype = 2), 0) b from cov group by all),
ts as (select ref_id, bin from hp where genome_id = (select min(genome_id) from cov where {CONTROL}) and a <= 3 and b > 3),
lost as (select genome_id, ref_id, bin, case when a <= 3 then 1 else 2 end haplotype from hp where not {CONTROL} and (a <= 3) <> (b <= 3) and (ref_id, bin) not in (select (ref_id, bin) from ts)){_islands("lost", "genome_id, ref_id, haplotype", "bin", 3, "c", "lc")}
select genome_id, ref_id, haplotype, c * 1000 start_pos, (max(bin) + 1) * 1000 end_pos from lc group by genome_id, ref_id, haplotype, c having max(bin) + 1 - c >= 2""")
def loss_regions(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of at least 2000 in which one haplotype is lost, tested against a control."""
    return evidence.loss_regions(segments.coverage_histogram(_seg(spark, d)), F.expr(CONTROL), least=2000)
