import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from strandline.llm import quantile_sketch as q

SCHEMA = "g string, day int, v long, level int, slot int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def data():
    r = random.Random(5)
    return [(r.choice(["a", "b", None]), r.randrange(3), r.choice([None, 0, r.randrange(-50, 50), int(r.lognormvariate(9, 2)), -(10**15)])) for _ in range(6000)]


def rank_error(values, share, estimate):
    values, slack = sorted(values), abs(estimate) * 2.0**-11
    lo, hi = bisect_left(values, estimate - slack), bisect_right(values, estimate + slack)
    return max(0, lo - share * len(values), share * len(values) - hi) / len(values)


def test_error_bound_and_merge_of_days(spark):
    rows, shares = data(), [0.01, 0.25, 0.5, 0.9, 1.0]
    df = table(spark, rows)
    whole = q.percentiles(q.sketch(df, ["g"], "v"), ["g"], shares)
    merged = q.percentiles(q.merge(q.sketch(df, ["g", "day"], "v"), ["g"]), ["g"], shares)
    got = {(x["g"], x["share"]): x for x in whole.collect()}
    assert len(got) == 15
    assert got == {(x["g"], x["share"]): x for x in merged.collect()}
    for (g, s), x in got.items():
        values = [v for k, _, v in rows if k == g and v is not None]
        assert x["n"] == len(values) and rank_error(values, s, x["estimate"]) <= 0.01


def test_deletions(spark):
    rows = data()
    df = table(spark, rows)
    rest = q.merge(q.sketch(df, ["g"], "v").unionByName(q.negate(q.sketch(df.where("day = 1"), ["g"], "v"))), ["g"])
    direct = q.sketch(df.where("day <> 1"), ["g"], "v")
    assert sorted(map(str, rest.collect())) == sorted(map(str, direct.collect()))
    weighted = q.merge(q.sketch(df.withColumn("w", F.lit(2)), ["g"], "v", weight="w"), ["g"])
    assert sorted(map(str, weighted.collect())) == sorted(map(str, q.sketch(df.union(df), ["g"], "v").collect()))


def test_no_values(spark):
    df = table(spark, [("a", 0, None)])
    assert q.percentiles(q.sketch(df, ["g"], "v"), ["g"], [0.5]).count() == 0
    assert q.percentiles(q.sketch(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0


@pytest.mark.parametrize("v", [0, 1, -1, 4095, 4096, 10**6, -(10**6), 2**61])
def test_codes_keep_order_and_value(spark, v):
    shape = q.Shape()
    code, after = spark.range(1).select(q.encode(F.lit(v).cast("long"), shape), q.encode(F.lit(v + 1).cast("long"), shape)).first()
    assert 0 <= code <= after < 1 << shape.levels
    assert abs(q.decode(code, shape) - v) <= abs(v) * 2.0**-shape.bits
