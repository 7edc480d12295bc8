from strandline.operators import calls

JUN = "junction_key string, genome_id string, hp1 int, hp2 int, supp long, length long, is_pass string, is_dup boolean, chr_a string, pos_a long, dir_a int, chr_b string, pos_b long, dir_b int"


def junction(key, a, b, turn, supp=4):
    return (key, "T01", 1, 1, supp, b - a, "PASS", False, "c", a, turn, "c", b, -turn)


def test_deletions_of_all_lengths(spark):
    """short and lone deletions need no drop in depth; 5 Mb ones are judged by medians, which one deep bin doesn't move."""
    rows = [
        junction("short", 500_000, 505_500, 1), junction("small", 501_000, 501_100, 1), junction("lone", 50_000_000, 50_900_000, 1),
        junction("lost", 10_000_000, 15_000_000, 1), junction("kept", 20_000_000, 25_000_000, 1), junction("twice", 30_000_000, 35_000_000, -1), junction("once", 40_000_000, 45_000_000, -1),
        *[junction(f"in{i}", 12_000_000 + i * 10_000_000, 12_000_050 + i * 10_000_000, 1) for i in range(4)],
    ]
    depth = lambda b: 0 if 10_000 <= b <= 15_000 and b != 11_111 else 90_000 if b == 11_111 else 30 if 30_000 <= b <= 35_000 else 10
    coverage = spark.createDataFrame([("T01", 1, "c", b, depth(b)) for b in range(60_000) if depth(b)], "genome_id string, haplotype int, ref_id string, bin long, n long")
    junctions = spark.createDataFrame(rows, JUN)
    got = {x["junction_key"]: x["call"] for x in calls.typed_by_coverage(junctions, coverage, spark.createDataFrame([("c", 60_000_000)], "ref_id string, length long")).collect()}
    want = {"short": "DEL", "small": "DEL", "lone": "DEL", "lost": "DEL", "twice": "tandem_duplication"} | {f"in{i}": "DEL" for i in range(4)}
    assert got == want
