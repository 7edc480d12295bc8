import random
from collections import Counter
from math import ceil

from strandline.operators import hotkeys as h

SCHEMA = "k string, v long, n int, key string, bin int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], SCHEMA)


def test_profile_and_percentiles_match_brute_force(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.choice([None, 0, -5, 3, 10**12, r.randrange(-4000, 4000)])) for _ in range(800)]
    w = h.compress(table(spark, rows), "k", "v")
    got = {x["key"]: x.asDict() for x in h.key_profile(w).collect()}
    perc = {(x["key"], float(x["share"])): x["value"] for x in h.key_percentiles(w, ["0.1", "0.5", "0.99"], bits=(3, 6)).collect()}
    assert len(got) == 4 and len(perc) == 12
    for k in ("hot", "a", "b", None):
        all_values = [v for q, v in rows if q == k]
        vs = sorted(v for v in all_values if v is not None)
        counts = Counter(vs)
        mode = min(v for v, n in counts.items() if n == max(counts.values()))
        x = got[k]
        assert (x["n"], x["n_values"], x["n_distinct"], x["mode_value"], x["min_value"], x["max_value"], x["sum_value"]) == (
            len(all_values), len(vs), len(counts), mode, vs[0], vs[-1], sum(vs),
        )
        for s in (0.1, 0.5, 0.99):
            assert perc[k, s] == vs[max(1, ceil(round(s * len(vs), 9))) - 1]


def test_keys_without_values(spark):
    w = h.compress(table(spark, [("a", None), ("a", None)]), "k", "v")
    x = h.key_profile(w).first()
    assert (x["n"], x["n_values"], x["n_distinct"], x["mode_value"], x["sum_value"]) == (2, 0, 0, None, None)
    assert h.key_percentiles(w, ["0.5"]).count() == 0


def test_frequent_keys_leave_null_out_but_count_it(spark):
    rows = [("a", 1)] * 5 + [("b", 1)] * 4 + [(None, 1)] * 91
    got = h.frequent_keys(h.compress(table(spark, rows), "k", "v"), "0.05")
    assert [x["key"] for x in got.collect()] == ["a"]


def test_empty(spark):
    w = h.compress(table(spark, []), "k", "v")
    assert h.frequent_keys(w, "0.05").count() == h.key_profile(w).count() == h.key_percentiles(w, ["0.5"]).count() == 0
