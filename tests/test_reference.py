import math

import duckdb
import planted
import pytest

from strandline.plans import reference, reference_calls, reference_evidence, reference_files, reference_found, reference_joins, reference_rearranged

QUERIES = reference.QUERIES | reference_joins.QUERIES | reference_calls.QUERIES | reference_evidence.QUERIES | reference_rearranged.QUERIES | reference_found.QUERIES | reference_files.QUERIES
SQL = reference.SQL | reference_joins.SQL | reference_calls.SQL | reference_evidence.SQL | reference_rearranged.SQL | reference_found.SQL | reference_files.SQL


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    full, empty = (tmp_path_factory.mktemp(n) for n in ("full", "empty"))
    planted.write(full)
    planted.write(empty, empty=True)
    return str(full), str(empty)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folders, name):
    con = duckdb.connect()
    for t in planted.TABLES:
        con.sql(f"create view {t} as select * from '{folders[0]}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, folders[0])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted((tuple(plain(row[c]) for c in columns) for row in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(row[i]) for i in at) for row in want.fetchall()), key=repr)
    assert a == b
    assert a, "no row: the planted tables don't exercise it"


@pytest.mark.parametrize("name", ["adjacent_pairs", "junction_support", "label_summary", "insertion_clusters", "phase_sets", "graph_components", "vcf_rows", "anchored_ends", "nearest_clips", "support_table", "junction_checks", "one_sided_junctions", "insertion_checks", "simple_coverage", "named_fragments", "spanned_repeats"])
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).count() == 0
