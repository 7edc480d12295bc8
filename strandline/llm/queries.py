"""Queries of the problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.names import KINDS
from strandline.llm import components, leakage, lookalike, matching, quantile_sketch, tokens
from strandline.operators import hotkeys
from strandline.tables import load

SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: Values that stand for "unknown": an unavailable mapq, a negative rate, a length that is not positive.
KNOWN = {"mapq": "mapq between 0 and 254", "error_rate": "error_rate >= 0", "read_length": "read_length > 0"}


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """One row per segment and known measure."""
    pairs = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.expr(f"if({known}, cast({c} as bigint), null)")) for c, known in KNOWN.items()])))
    return load(spark, d, "segments").select("genome_id", "seg_id", "run_date", pairs.alias("field", "value"))


def p1_monthly_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per genome and month, from sketches of the months."""
    keys = ["genome_id", "field", "month"]
    monthly = quantile_sketch.sketch(_measures(spark, d).withColumn("month", F.date_format("run_date", "yyyy-MM")), keys, "value")
    return quantile_sketch.percentiles(monthly, keys, SHARES)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per genome over everything, from the added sketches of the run dates."""
    keys = ["genome_id", "field"]
    daily = quantile_sketch.sketch(_measures(spark, d), [*keys, "run_date"], "value")
    return quantile_sketch.percentiles(quantile_sketch.merge(daily, keys), keys, SHARES)


def p1_without_copies(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per genome after the second deliveries of a segment were taken away from the sketch of all rows."""
    keys, rows = ["genome_id", "field"], _measures(spark, d)
    copies = rows.groupBy("seg_id", *keys, "value").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")
    surplus = quantile_sketch.negate(quantile_sketch.sketch(copies, keys, "value", weight="extra"))
    rest = quantile_sketch.merge(quantile_sketch.sketch(rows, keys, "value").unionByName(surplus), keys)
    return quantile_sketch.percentiles(rest, keys, SHARES)


def _bounds(rows: DataFrame, keys: list[str], estimates: DataFrame) -> DataFrame:
    """For each percentile the exact values whose rank is 1 % of all rows, at least 1, below and above its own, and whether the estimate lies between them.

    The estimate may be off by 2**-11 of itself besides.
    """
    weighted = hotkeys.compress(rows.select(F.struct(*keys).alias("key"), "value"), "key", "value")
    rank = lambda share, n: F.greatest(F.ceil(share * n), F.lit(1))
    allowed = lambda n: F.greatest(F.floor(n / 100), F.lit(1))
    shares = [str(s) for s in SHARES]
    low = hotkeys.key_percentiles(weighted, shares, rank=lambda s, n: F.greatest(rank(s, n) - allowed(n), F.lit(1))).withColumnRenamed("value", "low")
    high = hotkeys.key_percentiles(weighted, shares, rank=lambda s, n: F.least(rank(s, n) + allowed(n), n)).withColumnRenamed("value", "high")
    found = estimates.select(F.struct(*keys).alias("key"), F.col("share").cast("decimal(9,6)").alias("share"), "n", "estimate")
    slack = F.abs("estimate") * 2.0**-11
    inside = (F.col("estimate") >= F.col("low") - slack) & (F.col("estimate") <= F.col("high") + slack)
    return low.join(high, ["key", "share"]).join(found, ["key", "share"]).select("key.*", F.col("share").cast("double").alias("share"), "n", "low", "high", inside.alias("in_bound"))


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """p1_percentiles against the exact values at the ends of its bound."""
    return _bounds(_measures(spark, d), ["genome_id", "field"], p1_percentiles(spark, d))


def p1_months_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """p1_monthly_percentiles against the exact values at the ends of its bound."""
    rows = _measures(spark, d).withColumn("month", F.date_format("run_date", "yyyy-MM"))
    return _bounds(rows, ["genome_id", "field", "month"], p1_monthly_percentiles(spark, d))


def p1_rest_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """p1_without_copies, whose sketch had rows taken away, against the exact values at the ends of its bound."""
    rows = _measures(spark, d).groupBy("seg_id", "genome_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    return _bounds(rows, ["genome_id", "field"], p1_without_copies(spark, d))


def _counting(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "paf").where(
        "mapq >= 10 and not (ref_id like 'NC%' or ref_id like 'K%') and not coalesce(endswith(type_tag, 'S'), false)"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.nearby_groups(_counting(spark, d), "qry_id", "ref_id", "ref_end", 100).select(F.col("group").alias("group_id"), F.col("vertex").alias("qry_id"))


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_reads"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs retrieved by score that pass the exact rule."""
    pairs = matching.candidates(load(spark, d, "vcf_records"), load(spark, d, "panel_records"))
    return pairs.where("agrees").select("call_id", "panel_id").distinct()


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best panel records of each call with score, mutual-nearest test and confidence."""
    return matching.matches(load(spark, d, "vcf_records"), load(spark, d, "panel_records"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokens.encode(load(spark, d, "documents"), "doc_id", "text", path, public_tokenizers.PATTERN)


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have how many ids, in steps of powers of two."""
    n = F.size("ids")
    return p7_ids(spark, d).groupBy(F.when(n > 0, F.floor(F.log2(n))).otherwise(-1).alias("log2_ids")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(n).alias("n_ids"))


def _leaks(spark: SparkSession, d: str, slop: int) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "item_text", slop=slop)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 0)


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Twelve words of an item in order within thirteen of it and of the document, so one may be left out, put in or changed."""
    return _leaks(spark, d, 1)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike(load(spark, d, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document that looks like one of other characters, with the smallest id of its class and how many such documents there are."""
    return lookalike.classes(load(spark, d, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "form")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_percentiles, p1_monthly_percentiles, p1_without_copies, p1_within_bound, p1_months_within_bound, p1_rest_within_bound, p3_found, p3_group_sizes, p6_found, p6_matches, p7_ids, p7_lengths, p8_found, p8_near, p9_found, p9_classes, p9_forms)
}

_GROUPS = """
with recursive r as (select distinct qry_id, ref_id, ref_end from paf where qry_id is not null and ref_id is not null and ref_end is not null
    and mapq >= 10 and not (ref_id like 'NC%' or ref_id like 'K%') and coalesce(type_tag not like '%S', true)),
e as (select distinct a.qry_id a, b.qry_id b from r a join r b on a.ref_id = b.ref_id and abs(a.ref_end - b.ref_end) < 100 and a.qry_id <> b.qry_id),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
found as (select least(a, min(b)) group_id, a qry_id from reach group by a)"""

_CONTIG = r"""case when regexp_matches({t}, '^(scaffold|scaff|scf)[ _.-]*[0-9]+$') then 's' || regexp_extract({t}, '[ _.-]*0*([0-9]+)$', 1)
  when regexp_matches({t}, '^(chromosome|chrom|chr)?[ _.-]*[0-9]+$') then regexp_extract({t}, '^(?:chromosome|chrom|chr)?[ _.-]*0*([0-9]+)$', 1)
  else nullif(regexp_replace({t}, '^(chromosome|chrom|chr)[ _.-]*', ''), '') end"""


def _contig(column: str) -> str:
    return _CONTIG.replace("{t}", f"lower(trim({column}))")


def _kind(column: str) -> str:
    name = f"split_part(upper(regexp_replace({column}, '[<> ]', '', 'g')), ':', 1)"
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in KINDS.items())
    return f"case {name} {cases} else nullif({name}, '') end"


_MATCHES = f"""
with c as (select distinct call_id, {_contig("chrom")} ca, pos a, {_contig("chr2")} cb, pos2 b, {_kind("sv_type")} kind, abs(sv_len) len from vcf_records),
p as (select panel_id, {_contig("chrom")} ca, pos a, {_contig("chr2")} cb, stop_pos b, {_kind("svtype")} kind, abs(svlen) len,
    coalesce(list_max([abs(x) for x in cipos]), 200) + 15 ta, coalesce(list_max([abs(x) for x in ciend]), 200) + 15 tb from panel_records),
plain as (select call_id, panel_id, coalesce(c.kind = 'INS', false) or coalesce(p.kind = 'INS', false) ins,
    c.len cl, p.len pl, abs(c.b - c.a) cd, abs(p.b - p.a) pd
  from c join p on c.ca = p.ca and c.a between p.a - p.ta and p.a + p.ta
  where coalesce(c.kind, '') <> 'BND' and coalesce(p.kind, '') <> 'BND' and coalesce(c.kind = p.kind, true)),
sized as (select *, case when ins then cl else coalesce(cl, cd) end x, case when ins then pl else coalesce(pl, pd) end y from plain)
select call_id, panel_id from sized where coalesce(abs(x - y) <= 5 or abs(x - y) * 20 <= greatest(x, y), true)
union
select call_id, panel_id from c join p on c.ca = p.ca and c.cb = p.cb and abs(c.a - p.a) <= ta and abs(c.b - p.b) <= tb where c.kind = 'BND' and p.kind = 'BND'
union
select call_id, panel_id from c join p on c.cb = p.ca and c.ca = p.cb and abs(c.b - p.a) <= ta and abs(c.a - p.b) <= tb where c.kind = 'BND' and p.kind = 'BND'"""



def _exact(keys: str, rows: str) -> str:
    """The exact values at the ends of the bound of each percentile."""
    return f"""
with m as (select genome_id, seg_id, strftime(run_date, '%Y-%m') as month, unnest(['mapq', 'error_rate', 'read_length']) field,
    unnest([case when mapq between 0 and 254 then mapq end, case when error_rate >= 0 then error_rate end,
      case when read_length > 0 then read_length end]) v from segments),
w as (select {keys}, v, count(*) c from {rows} where v is not null group by all),
u as (select *, sum(c) over (partition by {keys} order by v) upto, (sum(c) over (partition by {keys}))::bigint n from w),
r as (select *, unnest({SHARES}::decimal(9,6)[]) share from u),
k as (select *, greatest(ceil(share * n), 1)::bigint rank, greatest(n // 100, 1) off from r)
select {keys}, share::double share, n, min(v) filter (upto >= greatest(rank - off, 1)) low, min(v) filter (upto >= least(rank + off, n)) high, true in_bound
from k group by {keys}, share, n"""


SQL: dict[str, str] = {
    "p6_found": _MATCHES,
    "p1_within_bound": _exact("genome_id, field", "m"),
    "p1_months_within_bound": _exact("genome_id, field, month", "m"),
    "p1_rest_within_bound": _exact("genome_id, field", "(select distinct seg_id, genome_id, field, v from m)"),
    "p3_found": _GROUPS + " select group_id, qry_id from found",
    "p3_group_sizes": _GROUPS + " select group_id, count(*) n_reads from found group by group_id",
}
