from pyspark.sql import functions as F

from strandline.operators import skew
from strandline.operators.skew import join_per_key


def test_hot_and_cold_keys_and_nulls(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(600)] + [(None, 1)], "k string, v long")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = join_per_key(rows, per, ["k"], "n")
    assert got.count() == 1500
    assert got.where("k = 'hot' and top = 899").count() == 900
    assert join_per_key(rows.limit(0), per.limit(0), ["k"], "n").count() == 0


def test_both_ways_of_join_per_key_agree(spark, monkeypatch):
    """With and without hot keys the same rows come out."""
    rows = spark.createDataFrame([("h", i) for i in range(900)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, i int")
    per_key = rows.groupBy("k").count().withColumn("v", F.length("k"))
    split = sorted(map(tuple, skew.join_per_key(rows, per_key, ["k"], "count").collect()))
    monkeypatch.setattr(skew, "HOT_SHARE", 0)
    assert sorted(map(tuple, skew.join_per_key(rows, per_key, ["k"], "count").collect())) == split and len(split) == 950


def test_join_split(spark):
    """Hot on either side, on both, missing on one, null, repeated rows."""
    a = spark.createDataFrame([("h", i % 40) for i in range(300)] + [("x", 1), ("y", 2), (None, 3), ("y", 2)], "k string, i int")
    b = spark.createDataFrame([("h", i) for i in range(70)] + [("y", j) for j in range(90)] + [(None, 3), ("z", 1)], "k string, j int")
    want = sorted(map(tuple, a.join(b, "k").collect()))
    assert sorted(map(tuple, skew.join_split(a, b, ["k"], part=20).collect())) == want and len(want) == 300 * 70 + 2 * 90
    assert skew.join_split(a.limit(0), b, ["k"]).count() == 0
