"""Queries of the segment and junction operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators import hotkeys, islands, junctions, segments
from strandline.tables import load

CONTROL = "genome_id like 'N%'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _seg(spark: SparkSession, d: str) -> DataFrame:
    return segments.clean(load(spark, d, "segments"))


def _jun(spark: SparkSession, d: str) -> DataFrame:
    return junctions.with_ends(load(spark, d, "junctions"))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


SEG = """
first_rows as (select * from segments qualify row_number() over (partition by seg_id order by loaded_at nulls last) = 1),
seg as (select * from first_rows where ref_id is not null and read_id is not null and ref_start <= ref_end),
split as (select * from seg where not is_insertion and not is_clipped)"""
JUN = """
jun as (select * exclude (x, y), regexp_extract(x, '^([+-]?)(.*):([0-9]+)$', 2) chr_a, regexp_extract(x, ':([0-9]+)$', 1)::bigint pos_a,
    case x[1] when '+' then 1 when '-' then -1 end dir_a, case when y not like 'INS:%' then regexp_extract(y, '^([+-]?)(.*):([0-9]+)$', 2) end chr_b,
    case when y not like 'INS:%' then regexp_extract(y, ':([0-9]+)$', 1)::bigint end pos_b,
    case when y not like 'INS:%' then case y[1] when '+' then 1 when '-' then -1 end end dir_b
  from (select *, split_part(junction_key, '|', 1) x, split_part(junction_key, '|', 2) y from junctions where junction_key is not null and genome_id is not null
    qualify row_number() over (partition by junction_key, genome_id, hp1, hp2 order by supp desc nulls last, dv desc nulls last, vcf_id nulls first, is_pass nulls first) = 1))"""
PAIRS = SEG + """,
nb as (select genome_id, read_id, seg_id, ref_id, ref_start, ref_end, strand, read_start, read_end, haplotype, is_pass,
    lead(struct_pack(ref_id := ref_id, ref_start := ref_start, ref_end := ref_end, strand := strand, read_start := read_start, haplotype := haplotype, is_pass := is_pass))
      over (partition by genome_id, read_id order by align_start nulls first, read_start nulls first, seg_id) y
  from split where is_pass = 'PASS' or segment_length >= 1000),
pq as (select genome_id, read_id, seg_id, coalesce(is_pass = 'PASS', false) and coalesce(y.is_pass = 'PASS', false) passed, y.read_start > read_start fwd,
    struct_pack(chr := ref_id, pos := case when (strand = 1) = (y.read_start > read_start) then ref_end else ref_start end,
      dir := case when (strand = 1) = (y.read_start > read_start) then 1 else -1 end, hp := haplotype) p,
    struct_pack(chr := y.ref_id, pos := case when (y.strand = 1) = (y.read_start > read_start) then y.ref_start else y.ref_end end,
      dir := case when (y.strand = 1) = (y.read_start > read_start) then -1 else 1 end, hp := y.haplotype) q
  from nb where y is not null and y.read_start - read_end < 1000),
ab as (select genome_id, read_id, seg_id, passed, case when p.pos <= q.pos then p else q end a, case when p.pos <= q.pos then q else p end b from pq),
pairs as (select genome_id, read_id, seg_id, passed, a.chr chr_a, a.pos pos_a, a.dir dir_a, a.hp hp_a, b.chr chr_b, b.pos pos_b, b.dir dir_b, b.hp hp_b from ab)"""


def _islands(source: str, keys: str, pos: str, gap: int, to: str, frm: str) -> str:
    """CTEs that add column `to`, the first position of each row's gap cluster."""
    return f""",
{frm}_m as (select *, case when coalesce({pos} - lag({pos}) over w > {gap}, true) then {pos} end opens from {source} window w as (partition by {keys} order by {pos})),
{frm} as (select * exclude (opens), max(opens) over (partition by {keys} order by {pos} range between unbounded preceding and current row) {to} from {frm}_m)"""


# Segments.


@query(f"with {SEG} select genome_id, read_id, seg_id, loaded_at from first_rows")
def first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return segments.keep_first(load(spark, d, "segments"), ["seg_id"], ["loaded_at"]).select("genome_id", "read_id", "seg_id", "loaded_at")


@query(f"""with {SEG}, s as (select * from split qualify row_number() over (partition by genome_id, read_id, read_start order by align_start nulls first, seg_id) = 1)
select seg_id, read_start from s union all select seg_id, read_start from seg where is_insertion or is_clipped""")
def distinct_starts(spark: SparkSession, d: str) -> DataFrame:
    return segments.distinct_starts(_seg(spark, d)).select("seg_id", "read_start")


@query(f"""with {SEG},
r as (select genome_id, read_id, count(*) filter (not is_insertion and not is_clipped) n, count(*) filter (is_insertion) i,
  count(*) filter (is_clipped and coalesce(is_pass, 'PASS') = 'PASS') c from seg group by all)
select genome_id, count(*) filter (n > 1) n_split_reads, sum(i)::bigint n_insertions, sum(c)::bigint n_clipped from r group by all""")
def routed_reads(spark: SparkSession, d: str) -> DataFrame:
    return segments.route(_seg(spark, d))


@query(f"""with {SEG},
p as (select * from split where is_pass = 'PASS' and read_start is not null),
h as (select genome_id, read_id, 'head' side, ref_id, case when strand = 1 then ref_start else ref_end end as position, read_start length from p
  qualify row_number() over (partition by genome_id, read_id order by read_start, seg_id) = 1),
t as (select genome_id, read_id, 'tail' side, ref_id, case when strand = 1 then ref_end else ref_start end as position, read_length - read_end length from p
  qualify row_number() over (partition by genome_id, read_id order by read_end desc nulls last, seg_id desc) = 1)
select * from h where length > 500 union all select * from t where length > 500""")
def read_clips(spark: SparkSession, d: str) -> DataFrame:
    return segments.clips(_seg(spark, d))


PAIR_COLUMNS = ["genome_id", "read_id", "seg_id", "chr_a", "pos_a", "dir_a", "hp_a", "chr_b", "pos_b", "dir_b", "hp_b", "passed"]


@query(f"with {PAIRS} select {', '.join(PAIR_COLUMNS)} from pairs")
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return segments.adjacent_pairs(_seg(spark, d)).select(*PAIR_COLUMNS)


@query(f"""with {PAIRS},
k as (select *, chr_a || ':' || pos_a x, chr_b || ':' || pos_b y, case when dir_a > 0 then '+' else '-' end s, case when dir_b > 0 then '+' else '-' end t from pairs)
select case when x <= y then s || x || '|' || t || y else t || y || '|' || s || x end junction_key, count(distinct genome_id || '/' || read_id) n_reads from k group by all""")
def junction_keys(spark: SparkSession, d: str) -> DataFrame:
    p = segments.adjacent_pairs(_seg(spark, d))
    key = names.junction_key(*[F.col(f"{c}_{e}") for e in "ab" for c in ("chr", "pos", "dir")])
    return p.groupBy(key.alias("junction_key")).agg(F.count_distinct(F.concat_ws("/", "genome_id", "read_id")).alias("n_reads"))


@query(f"""with {SEG}, b as (select genome_id, haplotype, ref_id, unnest(generate_series(ref_start // 1000 + 1, ref_end // 1000 - 1)) bin from split where is_pass = 'PASS')
select genome_id, haplotype, ref_id, bin, count(*) n from b group by all""")
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return segments.coverage_histogram(_seg(spark, d))


BACKGROUND = """
w as (select genome_id, mismatch_rate m, unnest(range((ref_end - ref_start) // 2000 + 1)) from split where mismatch_rate is not null),
bg as (select genome_id, quantile_cont(m, 0.95) background from w group by all)"""


@query(f"with {SEG}, {BACKGROUND} select genome_id, round(background, 6) background from bg")
def mismatch_background(spark: SparkSession, d: str) -> DataFrame:
    return segments.background(_seg(spark, d)).select("genome_id", F.round("background", 6).alias("background"))


MASK = """
mb as (select ref_id, unnest(generate_series(ref_start // 1000, ref_end // 1000)) bin, mismatch_rate m from split where mismatch_rate is not null),
lim as (select median(background) v from bg),
masked as (select ref_id, bin from mb, lim group by ref_id, bin, v
  having count(*) >= 5 and count(*) filter (m >= v) >= 4 and count(*) filter (m > v) >= 1 and count(*) filter (m < v) >= greatest(5, least(count(*) // 10, 15)))"""


def _mask(seg: DataFrame) -> tuple[DataFrame, F.Column]:
    limit = segments.background(seg).agg(F.median("background").alias("v")).scalar()
    return segments.high_mismatch_bins(seg, limit), limit


@query(f"with {SEG}, {BACKGROUND}, {MASK} select ref_id, bin from masked")
def high_mismatch_bins(spark: SparkSession, d: str) -> DataFrame:
    return _mask(_seg(spark, d))[0]


@query(f"""with {SEG}, {BACKGROUND}, {MASK}{_islands("masked", "ref_id", "bin", 1, "c", "mc")}
select ref_id, c * 1000 start_pos, (max(bin) + 1) * 1000 end_pos from mc group by ref_id, c""")
def collapsed_regions(spark: SparkSession, d: str) -> DataFrame:
    runs = islands.cluster_counts(_mask(_seg(spark, d))[0], ["ref_id"], "bin", 1)
    return runs.select("ref_id", (F.col("start_pos") * 1000).alias("start_pos"), ((F.col("end_pos") + 1) * 1000).alias("end_pos"))


@query(f"""with {SEG}, {BACKGROUND}, {MASK},
hi as (select distinct seg_id from (select seg_id, ref_id, unnest(generate_series(coalesce(ref_start_ori, ref_start) // 1000, coalesce(ref_end_ori, ref_end) // 1000)) bin from seg, lim where mismatch_rate >= v) semi join masked using (ref_id, bin)),
l as (select seg_id, is_clipped, is_insertion, segment_length, mapq, sum(read_end - read_start) filter (not is_clipped) over (partition by genome_id, read_id) al,
  first_value(read_length) over (partition by genome_id, read_id order by align_start nulls first, read_start nulls first, seg_id) rl from seg),
lab as (select *, case when mapq < 10 then '_LOW_MAPQ' else '' end || case when seg_id in (select seg_id from hi) then '_HIGH_MM_rate' else '' end
  || case when al < 0.5 * rl or al < 2000 then '_LOW_ALIGNED_LEN' else '' end t from l)
select case when t = '' then 'PASS' else t end "label", count(*) n, sum(segment_length)::bigint total_length from lab where not is_clipped and not is_insertion group by all""")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    """Labels given anew to all segments, summed over split ones."""
    seg = _seg(spark, d)
    masked, limit = _mask(seg)
    given = segments.labels(seg, masked, limit)
    kept = seg.where(segments.IS_SPLIT).select("seg_id", "segment_length").join(given, "seg_id")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("segment_length").alias("total_length"))


@query(f"""with {SEG}, r as (select genome_id, read_id, max(read_length) l from seg where read_length > 0 group by all),
o as (select genome_id, l, sum(l) over (partition by genome_id order by l, read_id rows unbounded preceding) c, sum(l) over (partition by genome_id) t from r)
select genome_id, max(t)::bigint total_length, min(l) filter (c >= ceil(t * 0.5)) n50, min(l) filter (c >= ceil(t * 0.1)) n90 from o group by all""")
def read_length_nx(spark: SparkSession, d: str) -> DataFrame:
    """N50 and N90: the length at which the longest reads make up more than half, or nine tenths, of all bases."""
    reads = _seg(spark, d).where("read_length > 0").groupBy("genome_id", "read_id").agg(F.max("read_length").alias("l"))
    weighted = hotkeys.compress(reads, "genome_id", "l").withColumn("n", F.col("n") * F.col("value"))
    nx = hotkeys.key_percentiles(weighted, ["0.5", "0.1"]).groupBy("key").agg(
        F.max(F.when(F.col("share") > 0.3, F.col("value"))).alias("n50"), F.max(F.when(F.col("share") < 0.3, F.col("value"))).alias("n90")
    )
    total = weighted.groupBy("key").agg(F.sum("n").alias("total_length"))
    return total.join(nx, "key").select(F.col("key").alias("genome_id"), "total_length", "n50", "n90")


@query(f"""with {SEG} select genome_id, count(*) n, round(quantile_cont(error_rate, 0.25), 6) error_q1, round(quantile_cont(error_rate, 0.5), 6) error_q2, round(quantile_cont(error_rate, 0.75), 6) error_q3
from split where error_rate between 0 and 999 group by all""")
def error_quartiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _seg(spark, d).where(segments.IS_SPLIT).where("error_rate between 0 and 999")
    return rows.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("error_rate", i / 4), 6).alias(f"error_q{i}") for i in (1, 2, 3)])


# Haplotype loss: bins that only one haplotype covers.
_COV = f"""{SEG}, cb as (select genome_id, haplotype, ref_id, unnest(generate_series(ref_start // 1000 + 1, ref_end // 1000 - 1)) bin from split where is_pass = 'PASS'),
cov as (select genome_id, haplotype, ref_id, bin, count(*) n from cb group by all)"""


@query(f"""with {_COV}, hp as (select genome_id, ref_id, bin, coalesce(sum(n) filter (haplotype = 1), 0) a, coalesce(sum(n) filter (haplotype = 2), 0) b from cov group by all),
lost as (select genome_id, ref_id, bin, case when a <= 3 then 1 else 2 end haplotype from hp where (a <= 3) <> (b <= 3)){_islands("lost", "genome_id, ref_id, haplotype", "bin", 2, "c", "lc")}
select genome_id, ref_id, haplotype, c * 1000 start_pos, (max(bin) + 1) * 1000 end_pos from lc group by genome_id, ref_id, haplotype, c having max(bin) + 1 - c >= 2""")
def haplotype_loss(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of at least 2000 in which one haplotype has at most three segments and the other more; gaps up to 2000 are bridged."""
    cov = segments.coverage_histogram(_seg(spark, d))
    by = cov.groupBy("genome_id", "ref_id", "bin").agg(*[F.coalesce(F.sum(F.when(F.col("haplotype") == h, F.col("n"))), F.lit(0)).alias(f"h{h}") for h in (1, 2)])
    lost = by.where((F.col("h1") <= 3) != (F.col("h2") <= 3)).withColumn("haplotype", F.when(F.col("h1") <= 3, 1).otherwise(2))
    runs = islands.cluster_counts(lost, ["genome_id", "ref_id", "haplotype"], "bin", 2).where("end_pos + 1 - start_pos >= 2")
    return runs.select("genome_id", "ref_id", "haplotype", (F.col("start_pos") * 1000).alias("start_pos"), ((F.col("end_pos") + 1) * 1000).alias("end_pos"))


# Clusters.


@query(f"""with {PAIRS}, ends as (select chr_a chr, dir_a dir, pos_a pos, passed from pairs union all select chr_b, dir_b, pos_b, passed from pairs)
{_islands("ends", "chr, dir", "pos", 50, "cluster", "ec")}
select chr, dir, cluster, floor(coalesce(median(pos) filter (passed), median(pos)))::bigint as position, max(pos) - min(pos) spread, count(*) n from ec group by chr, dir, cluster having count(*) >= 2""")
def end_clusters(spark: SparkSession, d: str) -> DataFrame:
    return junctions.end_clusters(junctions.end_positions(segments.adjacent_pairs(_seg(spark, d))))


_SUPPORT = f"""{PAIRS}{_islands("pairs", "chr_a, dir_a", "pos_a", 50, "cluster_a", "pa")}{_islands("pa", "chr_b, dir_b", "pos_b", 50, "cluster_b", "pb")},
place as (select chr_a, dir_a, cluster_a, chr_b, dir_b, cluster_b, floor(median(pos_a))::bigint position_a, floor(median(pos_b))::bigint position_b,
  (case when max(pos_a) - min(pos_a) < 50 and max(pos_b) - min(pos_b) < 50 then 1 else 0 end)::int prec from pb group by all),
best as (select chr_a, dir_a, cluster_a, chr_b, dir_b, cluster_b, max(r) most from (select chr_a, dir_a, cluster_a, chr_b, dir_b, cluster_b, genome_id, count(distinct read_id) r from pb where passed group by all) group by all),
supp as (select chr_a, dir_a, cluster_a, chr_b, dir_b, cluster_b, genome_id, hp_a, hp_b, count(distinct read_id) supp from pb group by all)"""


@query(f"""with {_SUPPORT} select *, case when most >= 3 then 'PASS' else 'FAIL' end "label"
from supp join place using (chr_a, dir_a, cluster_a, chr_b, dir_b, cluster_b) join best using (chr_a, dir_a, cluster_a, chr_b, dir_b, cluster_b)""")
def junction_support(spark: SparkSession, d: str) -> DataFrame:
    return junctions.supported(segments.adjacent_pairs(_seg(spark, d)))


@query(f"""with {JUN}, e as (select dir_a dir, chr_a chr, pos_a pos from jun where dir_a is not null union all select dir_b, chr_b, pos_b from jun where dir_b is not null)
{_islands("e", "dir, chr", "pos", 49, "c", "ec")}
select dir, chr, c start_pos, max(pos) end_pos, count(*) n from ec group by dir, chr, c""")
def merged_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    j = _jun(spark, d)
    ends = j.select(F.inline(F.array(*[F.struct(F.col(f"dir_{e}").alias("dir"), F.col(f"chr_{e}").alias("chr"), F.col(f"pos_{e}").alias("pos")) for e in "ab"])))
    return junctions.merged_ends(ends, ["dir", "chr"], "pos")


@query(f"""with {JUN}, s as (select distinct junction_key, chr_a, pos_a, pos_b, length from jun where vcf_sv_type = 'DEL' and length <= 20000 and pos_b > pos_a),
o as (select *, coalesce(pos_a < lag(pos_b) over w and lag(pos_b) over w < pos_b and abs(length - lag(length) over w) < 50, false) same from s window w as (partition by chr_a order by pos_a, pos_b, junction_key))
select junction_key, last_value(case when not same then junction_key end ignore nulls) over (partition by chr_a order by pos_a, pos_b, junction_key rows unbounded preceding) group_key from o""")
def similar_deletions(spark: SparkSession, d: str) -> DataFrame:
    return junctions.similar_deletions(_jun(spark, d))


@query(f"""with {SEG}, i as (select genome_id, read_id, seg_id, ref_id, ref_end, segment_length l, coalesce(is_pass = 'PASS', false) passed from seg where is_insertion and segment_length is not null)
{_islands("i", "ref_id", "ref_end", 1000, "cluster", "ic")},
v as (select distinct ref_id, cluster, l from ic),
n as (select *, coalesce(l - lag(l) over w > greatest(50, 0.25 * lag(l) over w), true)::int nw from v window w as (partition by ref_id, cluster order by l)),
lv as (select ref_id, cluster, l, sum(nw) over (partition by ref_id, cluster order by l) as level from n),
z as (select * from ic join lv using (ref_id, cluster, l)),
r as (select ref_id, cluster, level, max(c) most_reads from (select ref_id, cluster, level, genome_id, count(distinct read_id) c from z where passed group by all) group by all),
s as (select ref_id, cluster, level, floor(median(l))::bigint length, floor(median(ref_end))::bigint as position, max(ref_end) - min(ref_end) spread, stddev_pop(l) / avg(l) cv, count(*) n from z where passed group by all)
select ref_id, cluster, level::bigint as level, length, position, spread, n, most_reads, (case when spread > 50 or cv > 0.2 then 0 else 1 end)::int prec
from s join r using (ref_id, cluster, level) where most_reads >= 2 and length >= 50 and length * (n + 1) >= spread""")
def insertion_clusters(spark: SparkSession, d: str) -> DataFrame:
    return junctions.insertion_clusters(_seg(spark, d))


@query(f"""with {SEG}, i as (select * from seg where is_clipped){_islands("i", "ref_id", "ref_end", 50, "cluster", "ic")}
select ref_id, cluster, floor(median(ref_end_ori))::bigint as position, arg_min(strand, (ref_end, seg_id)) strand, count(*) n from ic group by ref_id, cluster""")
def clip_clusters(spark: SparkSession, d: str) -> DataFrame:
    return junctions.clip_clusters(_seg(spark, d))


@query(f"""with {JUN}, i as (select chr_a, pos_a, length from jun where vcf_sv_type in ('DEL', 'INS')){_islands("i", "chr_a", "pos_a", 20000, "cluster", "ic")}
select chr_a, cluster, count(*) n, sum(length)::bigint total, max(pos_a) - min(pos_a) span from ic group by chr_a, cluster having count(*) > 5 and 2 * sum(length) > max(pos_a) - min(pos_a)""")
def indel_clusters(spark: SparkSession, d: str) -> DataFrame:
    return junctions.indel_clusters(_jun(spark, d))


@query(f"""with {JUN}, i as (select chr_a, vntr.vntr_start, vntr.vntr_end, vcf_sv_type, length l, supp from jun where vntr is not null and length is not null),
v as (select distinct chr_a, vntr_start, vntr_end, vcf_sv_type, l from i),
n as (select *, coalesce(l - lag(l) over w > greatest(150, 0.25 * l), true)::int nw from v window w as (partition by chr_a, vntr_start, vntr_end, vcf_sv_type order by l)),
lv as (select * exclude (nw), sum(nw) over (partition by chr_a, vntr_start, vntr_end, vcf_sv_type order by l) as level from n)
select chr_a, vntr_start, vntr_end, vcf_sv_type, level::bigint as level, count(*) n, floor(avg(l))::bigint length, sum(supp)::bigint supp
from i join lv using (chr_a, vntr_start, vntr_end, vcf_sv_type, l) group by all""")
def merged_in_repeats(spark: SparkSession, d: str) -> DataFrame:
    return junctions.merged_in_repeats(_jun(spark, d))


@query("""with recursive p as (select ref_id, ref_end e, count(*) n from paf where ref_id is not null and ref_end is not null group by all),
s(ref_id, e) as (select ref_id, min(e) from p group by ref_id
  union all select s.ref_id, (select min(p.e) from p where p.ref_id = s.ref_id and p.e >= s.e + 50) from s where s.e is not null)
select s.ref_id, s.e start_pos, floor(sum(p.e * p.n) / sum(p.n))::bigint center, sum(p.n)::bigint n from s join p on p.ref_id = s.ref_id and p.e >= s.e and p.e < s.e + 50 group by all""")
def anchored_ends(spark: SparkSession, d: str) -> DataFrame:
    return islands.anchored_clusters(load(spark, d, "paf"), ["ref_id"], "ref_end", 50)
