"""Queries of the general problems 2, 4 and 5, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import coverage, hotkeys
from strandline.sources import paf
from strandline.tables import load

SHARES = ["0.25", "0.5", "0.75", "0.95"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {
        "segments.ref_id": hotkeys.compress(load(spark, d, "segments"), "ref_id", "mapq"),
        "junctions.supp": hotkeys.compress(load(spark, d, "junctions"), "supp", "dv"),
    }
    parts = [
        hotkeys.frequent_keys(w, "0.05").select(F.lit(f).alias("field"), F.col("key").cast("string").alias("key_value"))
        for f, w in fields.items()
    ]
    return parts[0].unionByName(parts[1])


def p2_ref_profile(spark: SparkSession, d: str) -> DataFrame:
    weighted = hotkeys.compress(load(spark, d, "segments"), "ref_id", "mapq")
    return hotkeys.key_profile(weighted).withColumnRenamed("key", "ref_id").withColumns(
        {c: F.col(c).cast("long") for c in ("n", "n_values", "n_distinct", "mode_value", "min_value", "max_value", "sum_value")}
    )


def p2_ref_read_length(spark: SparkSession, d: str) -> DataFrame:
    weighted = hotkeys.compress(load(spark, d, "segments"), "ref_id", "read_length")
    return hotkeys.key_percentiles(weighted, SHARES).select(
        F.col("key").alias("ref_id"), F.col("share").cast("double").alias("share"), F.col("value").cast("long").alias("read_length")
    )


def p2_supp_profile(spark: SparkSession, d: str) -> DataFrame:
    weighted = hotkeys.compress(load(spark, d, "junctions"), "supp", "length")
    return hotkeys.key_profile(weighted).withColumnRenamed("key", "supp")


def p2_supp_length(spark: SparkSession, d: str) -> DataFrame:
    weighted = hotkeys.compress(load(spark, d, "junctions"), "supp", "length")
    return hotkeys.key_percentiles(weighted, SHARES).select(
        F.col("key").alias("supp"), F.col("share").cast("double").alias("share"), F.col("value").alias("length")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    segments = load(spark, d, "segments").where(F.col("ref_id").isNotNull())
    return coverage.covered_and_gaps(segments, ["genome_id", "ref_id"], "ref_start", "ref_end", 50_000)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return paf.bad_lines(load(spark, d, "paf_raw")).select("line_no", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    rows = paf.load(load(spark, d, "paf_raw"))
    return rows.select("line_no", "source_file", *paf.FIELDS, F.round("de", 9).alias("de"), "type_tag")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_ref_profile, p2_ref_read_length, p2_supp_profile, p2_supp_length, p4_found, p5_found, p5_loaded)
}


def _profile_sql(table: str, key: str, value: str) -> str:
    return f"""
with w as (select {key} k, {value} v, count(*) n from {table} group by all)
select k as {key}, sum(n)::bigint n, coalesce(sum(n) filter (v is not null), 0)::bigint n_values, count(v) n_distinct,
  (list(v order by n desc, v) filter (v is not null))[1]::bigint mode_value, min(v)::bigint min_value, max(v)::bigint max_value,
  sum(v * n)::bigint sum_value
from w group by k"""


def _percentile_sql(table: str, key: str, value: str, name: str) -> str:
    return f"""
with v as (select {key} k, {value} v, row_number() over (partition by {key} order by {value}) r, count(*) over (partition by {key}) n
  from {table} where {value} is not null),
s as (select unnest([{', '.join(SHARES)}]::decimal(9,6)[]) share)
select k as {key}, share::double share, v::bigint as {name} from v, s where r = greatest(ceil(share * n), 1)"""


_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_FIELDS_SQL = rf"""
split as (select line_no, source_file, coalesce(raw_line, '') line,
    regexp_full_match(coalesce(raw_line, ''), '(?s){_FIELD}(?:\t{_FIELD})*') quoted,
    [case when f like '"%' then replace(f[2:-2], '""', '"') else f end
      for f in regexp_extract_all(coalesce(raw_line, '') || chr(9), '(?s)({_FIELD})\t', 1)] fs
  from paf_raw),
tags as (select *, [t for t in fs[13:] if t like 'de:%'] de,
    [not regexp_full_match(fs[i], '[0-9]+') for i in [2, 3, 4, 7, 8, 9, 10, 11]] bad_digits from split),
judged as (select *, case when not quoted then 'quoting' when len(fs) not between 14 and 16 then 'columns'
    when not regexp_full_match(fs[12], '[0-9]+') or fs[12]::hugeint > 255 then 'mapq'
    when len(de) <> 1 or not regexp_full_match(de[1], 'de:f:[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?') or de[1][6:]::double > 1 then 'de_tag'
    when fs[5] not in ('+', '-') or fs[1] = '' or fs[6] = '' or list_contains(bad_digits, true) then 'other'
    when not (fs[3]::hugeint <= fs[4]::hugeint and fs[4]::hugeint <= fs[2]::hugeint
      and fs[8]::hugeint <= fs[9]::hugeint and fs[9]::hugeint <= fs[7]::hugeint) then 'other' end reason
  from tags)"""

SQL: dict[str, str] = {
    "p2_found": """
select 'segments.ref_id' field, ref_id key_value from segments where ref_id is not null group by ref_id
  having count(*) * 20 >= (select count(*) from segments)
union all
select 'junctions.supp', supp::varchar from junctions where supp is not null group by supp
  having count(*) * 20 >= (select count(*) from junctions)""",
    "p2_ref_profile": _profile_sql("segments", "ref_id", "mapq"),
    "p2_ref_read_length": _percentile_sql("segments", "ref_id", "read_length", "read_length"),
    "p2_supp_profile": _profile_sql("junctions", "supp", "length"),
    "p2_supp_length": _percentile_sql("junctions", "supp", "length", "length"),
    "p4_found": """
with s as (select genome_id, ref_id, ref_start a, ref_end b from segments where ref_id is not null and ref_end > ref_start),
m as (select *, max(b) over (partition by genome_id, ref_id order by a, b rows between unbounded preceding and 1 preceding) reach from s),
i as (select *, count(*) filter (reach is null or a > reach) over (partition by genome_id, ref_id order by a, b rows unbounded preceding) g from m),
c as (select genome_id, ref_id, g, min(a) a, max(b) b from i group by all),
n as (select *, lead(a) over (partition by genome_id, ref_id order by a) nxt from c)
select 'covered' kind, genome_id, ref_id, a start_pos, b end_pos from c
union all
select 'gap', genome_id, ref_id, b, nxt from n where nxt is not null and nxt - b <= 50000""",
    "p5_found": f"with {_FIELDS_SQL} select line_no, reason from judged where reason is not null",
    "p5_loaded": f"""with {_FIELDS_SQL}
select line_no, source_file, fs[1] qry_id, fs[2]::bigint qry_len, fs[3]::bigint qry_start, fs[4]::bigint qry_end, fs[5] strand, fs[6] ref_id,
  fs[7]::bigint ref_len, fs[8]::bigint ref_start, fs[9]::bigint ref_end, fs[10]::bigint n_match, fs[11]::bigint block_len, fs[12]::int mapq,
  round(de[1][6:]::double, 9) de, ([t for t in fs[13:] if t like 'tp:%'])[1] type_tag
from judged where reason is null""",
}
