import math
import random
import statistics

from strandline.operators import calls

KEY = ["name", "genome_id", "haplotype"]
DEPTHS = "genome_id string, ref_id string, haplotype int, bin bigint, n bigint"


def shuffled(spark):
    """Rows that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    none, array = sc._jvm.java.util.ArrayList(), sc._gateway.new_array
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def drawn(n, most, longest):
    pick = random.Random(7)
    lows = [pick.randrange(most) for _ in range(n)]
    ranges = [(f"r{i}", low, low + pick.randrange(longest)) for i, low in enumerate(lows)]
    depths = {(h, b): pick.randrange(1, 9) for h in (0, 1, 2) for b in range(most) if pick.random() < 0.3 + 0.2 * h}
    return ranges, depths


def expected(ranges, depths, haplotypes):
    return {(name, h): math.floor(statistics.median([depths.get((h, b), 0) for b in range(low, high + 1)])) for name, low, high in ranges for h in haplotypes}


def test_long_ranges_cost_few_rows(spark):
    depths = spark.createDataFrame([("g", "c", 0, b, 3) for b in range(1000, 1010)], DEPTHS)
    wanted = spark.range(200).selectExpr("concat('r', id) name", "'g' genome_id", "0 haplotype", "'c' ref_id", "id * 7 + 1 low", "id * 7 + 2000 high")
    # As with large tables, neither side is broadcast.
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    try:
        rows = calls.median_depth(wanted, depths, KEY).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert len(rows) == 200 and {r["depth"] for r in rows} == {0}
    # Bin by bin these are 400,000 rows.
    assert shuffled(spark) - before < 200 * 100


def test_same_as_bin_by_bin(spark):
    for ranges, depths in (drawn(150, 300, 80), drawn(40, 9000, 5000), drawn(3, 70_000, 40_000)):
        ranges += [("one", 64, 64), ("block", 64, 127), ("from below", -5, 3), ("reversed", 10, 9)]
        coverage = spark.createDataFrame([("g", "c", h, b, n) for (h, b), n in depths.items()], DEPTHS)
        bare = spark.createDataFrame([(name, "g", "c", low, high) for name, low, high in ranges], "name string, genome_id string, ref_id string, low bigint, high bigint")
        some = [r for r in ranges if r[1] <= r[2]]
        got = calls.median_depth(bare.selectExpr("*", "1 haplotype"), coverage, KEY).collect()
        assert {(r["name"], r["haplotype"]): r["depth"] for r in got} == expected(some, depths, (1,))
        got = calls.median_depth(bare, coverage, KEY, (0, 2)).collect()
        assert {(r["name"], r["haplotype"]): r["depth"] for r in got} == expected(some, depths, (0, 2))


def test_ranges_of_a_key_are_taken_together(spark):
    coverage = spark.createDataFrame([("g", "c", 1, b, b % 5 + 1) for b in range(40)], DEPTHS)
    wanted = spark.createDataFrame([("k", "g", 1, "c", 0, 4), ("k", "g", 1, "c", 30, 45)], "name string, genome_id string, haplotype int, ref_id string, low bigint, high bigint")
    depths = [b % 5 + 1 for b in [*range(5), *range(30, 40)]] + [0] * 6
    assert [r["depth"] for r in calls.median_depth(wanted, coverage, KEY).collect()] == [math.floor(statistics.median(depths))]
