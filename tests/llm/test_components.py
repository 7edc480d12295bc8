import random

import pytest

from strandline.llm import components as c


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return sorted((v, find(v)) for v in parent)


def run(spark, edges):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "a string, b string, low string, n int")
    return sorted(map(tuple, c.groups(df, "a", "b").collect()))


def test_random_graph_with_nulls_loops_and_repeats(spark):
    r = random.Random(2)
    edges = [(f"v{r.randrange(150):03d}", f"v{r.randrange(150):03d}") for _ in range(110)] + [(None, "v1"), ("v1", None), ("z", "z"), ("v001", "v002"), ("v002", "v001")]
    assert run(spark, edges) == brute(edges)


def test_chain_and_hub(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(900)] + [("c030", "hub")]
    assert run(spark, edges) == brute(edges)


def test_no_links(spark):
    assert run(spark, []) == [] and run(spark, [("a", "a"), (None, None)]) == []


@pytest.mark.parametrize("seed", [0, 1])
def test_nearby_links_give_the_groups_of_all_near_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *[f"q{i:02d}" for i in range(40)]]), r.choice(["x", "y", None]), r.choice([None, r.randrange(-3000, 3000)])) for _ in range(120)]
    rows += [(f"h{i}", "x", 500) for i in range(50)]
    near = [(a, b) for a, s, p in rows for b, t, q in rows if None not in (a, s, p, b, t, q) and s == t and abs(p - q) < 100]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "record string, axis string, position long, cell int, first string")
    got = c.groups(c.nearby_links(df, "record", "axis", "position", 100), "a", "b")
    assert sorted(map(tuple, got.collect())) == brute(near)
    assert sorted(map(tuple, c.nearby_groups(df, "record", "axis", "position", 100).collect())) == brute(near)
