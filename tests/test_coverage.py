import random

import pytest

from strandline.operators.coverage import covered_and_gaps

SCHEMA = "g string, ref string, s long, e long, kind string, _s long, start_pos long"


def brute(rows, max_gap):
    out = []
    by = {}
    for g, r, s, e, *_ in rows:
        if s is not None and e is not None and e > s:
            by.setdefault((g, r), []).append((s, e))
    for (g, r), spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [("covered", g, r, s, e) for s, e in merged]
        out += [("gap", g, r, a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] <= max_gap]
    return sorted(out, key=repr)


def run(spark, rows, max_gap=50, shard=64):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, covered_and_gaps(df, ["g", "ref"], "s", "e", max_gap, shard).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_random_intervals_across_shards(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.choice(["c1", "c2", None]), s := r.randrange(-300, 1500), s + r.choice([0, 1, 5, 40, 64, 200, -3])) for _ in range(150)]
    assert run(spark, rows) == brute(rows, 50)


def test_nulls_touching_nested_repeated_and_hot_place(spark):
    rows = [("a", "c", 0, 64), ("a", "c", 64, 128), ("a", "c", 10, 20), ("a", "c", None, 5), ("a", "c", 5, None), ("a", "c", 7, 7), (None, None, 1, 2)]
    rows += [("a", "c", 200, 210)] * 500
    assert run(spark, rows, 100) == sorted(
        [("covered", "a", "c", 0, 128), ("covered", "a", "c", 200, 210), ("gap", "a", "c", 128, 200), ("covered", None, None, 1, 2)], key=repr
    )


def test_gap_over_empty_shards_and_limit(spark):
    rows = [("a", "c", 0, 10), ("a", "c", 1000, 1010), ("a", "c", 1020, 1030)]
    assert ("gap", "a", "c", 10, 1000) in run(spark, rows, 1000)
    assert [x for x in run(spark, rows, 20) if x[0] == "gap"] == [("gap", "a", "c", 1010, 1020)]


def test_empty(spark):
    assert run(spark, []) == []
