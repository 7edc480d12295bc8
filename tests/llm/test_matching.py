import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import matching as m

CALLS = "call_id long, chrom string, pos long, sv_type string, sv_len long, chr2 string, pos2 long, id string, score int"
PANEL = "panel_id long, chrom string, pos long, chr2 string, stop_pos long, svtype string, svlen long, cipos array<int>, ciend array<int>, kind string"


def norm(c):
    c = (c or "").strip().lower()
    for p in ("chr", "scaffold_", "scf_", "scf"):
        if c.startswith(p):
            return ("s" if p[0] == "s" else "") + c[len(p) :].lstrip("0")
    return c.lstrip("0") or None


def kind(k):
    k = (k or "").upper().split(":")[0]
    return {"TRA": "BND", "CTX": "BND", "": None}.get(k, k)


def agrees(c, p):
    _, cc, ca, ck, cl, c2, cb = c[:7]
    _, pc, pa, p2, pb, pk, pl, ci, ce = p[:9]
    ck, pk = kind(ck), kind(pk)
    tol = lambda x: (max(map(abs, x)) if x else 200) + 15
    near = lambda x, a, y, b, t: None not in (x, a, y, b) and norm(x) == norm(y) and norm(x) is not None and abs(a - b) <= t
    if ck == "BND" or pk == "BND":
        if ck != pk:
            return False
        return near(cc, ca, pc, pa, tol(ci)) and near(c2, cb, p2, pb, tol(ce)) or near(c2, cb, pc, pa, tol(ci)) and near(cc, ca, p2, pb, tol(ce))
    if ck and pk and ck != pk or not near(cc, ca, pc, pa, tol(ci)):
        return False
    ins = "INS" in (ck, pk)
    x = abs(cl) if cl is not None else None if ins or cb is None else abs(cb - ca)
    y = abs(pl) if pl is not None else None if ins or pb is None else abs(pb - pa)
    return x is None or y is None or abs(x - y) <= 5 or 20 * abs(x - y) <= max(x, y)


def data(r, n):
    pos = lambda: r.choice([None, r.randrange(0, 1500)]) if r.random() < 0.1 else r.randrange(0, 1500)
    calls = [(i, r.choice(["chr01", "scf0007", None]), pos(), r.choice(["DEL", "INS", "DUP", "BND", None]), r.choice([None, r.randrange(50, 90)]), r.choice(["chr01", "scf0007", None]), pos()) for i in range(n)]
    ends = lambda: r.choice([None, [-r.randrange(60), r.randrange(60)], [-300, 10], []])
    panel = [(i, r.choice(["1", " Chr1", "scaffold_0007", "SCF7", None]), pos(), r.choice(["CHR01", "scf_7", None]), pos(), r.choice(["del", "INS", "DUP:TANDEM", "TRA", "CTX", None, ""]), r.choice([None, -r.randrange(50, 90)]), ends(), ends()) for i in range(n)]
    return calls, panel


def frames(spark, calls, panel):
    return spark.createDataFrame([(*c, "x", 1) for c in calls], CALLS), spark.createDataFrame([(*p, "x") for p in panel], PANEL)


def test_no_agreeing_pair_is_lost(spark):
    calls, panel = data(random.Random(11), 150)
    c, p = frames(spark, calls + calls[:30], panel)
    got = m.candidates(c, p).where("agrees").select("call_id", "panel_id").distinct()
    want = sorted((x[0], y[0]) for x in calls for y in panel if agrees(x, y))
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_matches_have_score_mutual_test_and_confidence(spark):
    calls = [(i, "chr01", 10_000 * i, "DEL", 100 + i, "chr01", 10_000 * i + 100 + i) for i in range(1, 30)]
    panel = [(i, "1", 10_000 * i + 3, None, 10_000 * i + 103 + i, "DEL", -(100 + i), [-5, 5], [-5, 5]) for i in range(1, 30)] + [(99, "1", 10_010, None, 19_000, "DEL", 8000, [-5, 5], [0, 0])]
    got = m.matches(*frames(spark, calls, panel))
    rows = {(x["call_id"], x["panel_id"]): x for x in got.collect()}
    assert all(rows[i, i]["is_mutual"] and rows[i, i]["confidence"] > 0.7 for i in range(1, 30))
    assert not rows[1, 99]["is_mutual"] and rows[1, 99]["confidence"] < rows[1, 1]["confidence"]
    assert m.top(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 0.5)], "query string, score double"), "query", 1).count() == 2


def test_every_agreeing_pair_has_a_confidence(spark):
    """More than k records of one place agree with a call, and as many of the same cell that don't agree compete for the k places."""
    calls = [(i, "chr01", 10_000 + i, "DEL", 100, "chr01", 10_100 + i) for i in range(3)] + [(9, "chr01", 90_000, "DEL", 100, "chr01", 90_100)]
    panel = [(i, "1", 10_000 + i % 7, None, 10_100, "DEL", -100, [-5, 5], [-5, 5]) for i in range(25)] + [(100 + i, "1", 10_000, None, 10_900, "DEL", -900, [-5, 5], [-5, 5]) for i in range(25)]
    c, p = frames(spark, calls, panel)
    want = {(x[0], y[0]) for x in calls for y in panel if agrees(x, y)}
    got = {(x["call_id"], x["panel_id"]): x["confidence"] for x in m.matches(c, p, k=4).collect()}
    assert len(want) == 75 and all(got.get(pair) is not None for pair in want)


def brute_scores(queries, docs):
    """BM25 of all pairs that share a token, from the rows of queries and docs."""
    tokens = {d["id"]: set(d["anchors"]) | set(d["others"]) for d in docs}
    df = collections.Counter(t for s in tokens.values() for t in s)
    avg = sum(map(len, tokens.values())) / len(tokens)
    idf = {t: math.log(1 + (len(tokens) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    part = {d: (m.K1 + 1) / (1 + m.K1 * (1 - m.B + m.B * len(s) / avg)) for d, s in tokens.items()}
    anchors = {d["id"]: set(d["anchors"]) for d in docs}
    pairs = {(q["id"], d): sum(idf[t] * (m.BOOST if t in anchors[d] else 1) for t in s & (set(q["anchors"]) | set(q["others"]))) * part[d] for q in queries for d, s in tokens.items() if s & (set(q["anchors"]) | set(q["others"]))}
    return {pair: round(x, 6) for pair, x in pairs.items()}


def spread(seed):
    calls, panel = data(random.Random(seed), 60)
    calls += [(900 + i, "chr01", 50_000 * i, "DEL", 70, "chr01", 50_000 * i + 70) for i in range(1, 12)]
    panel += [(900 + i, "1", 50_000 * i + 30 * (i % 2), None, 50_000 * i + 70, "DEL", -70, [-5, 5], [-5, 5]) for i in range(1, 120)]
    return calls, panel


def test_retrieval_reads_only_what_can_reach_the_floor(spark):
    c, p, levels = m._records(*frames(spark, *spread(5)))
    asked, docs = m.call_tokens(c, levels), m.panel_tokens(p)
    weighted = m.index(docs)
    lists = m.read_lists(asked, weighted.select(F.col("id").alias("doc"), F.inline("weights"))).collect()
    assert sum(not x["reads"] for x in lists) > len(lists) / 20 and any(x["reads"] for x in lists)
    floor = {x["query"]: x["floor"] for x in lists}
    scores = brute_scores(asked.collect(), docs.collect())
    want = {pair: x for pair, x in scores.items() if x >= floor.get(pair[0], math.inf) - m.NEAR}
    got = {(x["query"], x["doc"]): x["score"] for x in m.retrieve(asked, docs).collect()}
    assert set(got) == set(want) and all(abs(x - want[pair]) < 1e-5 for pair, x in got.items())
    held = {d["id"]: set(d["anchors"]) for d in docs.collect()}
    assert all((q["id"], d) in got for q in asked.collect() for d, a in held.items() if a & set(q["anchors"]))
    best = {(x["query"], x["doc"]) for x in m.retrieve(asked, docs, 2).collect()}
    by = collections.defaultdict(list)
    for (q, _), x in want.items():
        by[q].append(x)
    assert best == {(q, d) for (q, d), x in want.items() if x >= sorted(by[q])[-min(2, len(by[q]))] - 1e-9}


def test_no_score_no_pair(spark, monkeypatch):
    c, p = frames(spark, *spread(6))
    assert m.candidates(c, p).where("agrees").count() > 0
    monkeypatch.setattr(m, "_scored", lambda pairs, *_: pairs.withColumn("score", F.lit(0.0)))
    assert m.candidates(c, p).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_the_k_best_are_those_over_all_attributes(spark, seed):
    """Also records that share no cell with a call, which were never scored."""
    calls, panel = data(random.Random(seed), 60)
    calls += [(900 + i, "chr01", 50_000 * i, "DEL", 70, "chr01", 50_000 * i + 70) for i in range(1, 12)]
    panel += [(900 + i, "1", 50_000 * i + 30_000, None, 50_000 * i + 30_070, "DEL", -70, [-5, 5], [-5, 5]) for i in range(1, 12)]
    panel += [(950, "1", 650, None, 650 + 60, "DEL", -60, [-5, 5], None), (951, "1", 200_000, None, 50_069, "DEL", -70, [-5, 5], [-5, 5])]
    c, p, levels = m._records(*frames(spark, calls, panel))
    asked, docs = m.call_tokens(c, levels).collect(), m.panel_tokens(p).collect()
    want = brute_scores(asked, docs)
    got = {(x["query"], x["doc"]): x for x in m.ranked(m.call_tokens(c, levels), m.panel_tokens(p), 4).collect()}
    assert all(abs(x["score"] - want[pair]) < 1e-5 for pair, x in got.items())
    doc_best = collections.defaultdict(float)
    for (_, d), x in want.items():
        doc_best[d] = max(doc_best[d], x)
    assert all(abs(x["doc_best"] - doc_best[d]) < 1e-5 for (_, d), x in got.items())
    unanchored = 0
    anchors = {d["id"]: set(d["anchors"]) for d in docs}
    for q in asked:
        best = sorted((x for (a, _), x in want.items() if a == q["id"]), reverse=True)[:4]
        mine = sorted((x["score"] for (a, _), x in got.items() if a == q["id"]), reverse=True)[:4]
        assert len(mine) == len(best) and all(abs(x - y) < 1e-5 for x, y in zip(mine, best))
        unanchored += sum(not anchors[d] & set(q["anchors"]) and x["score"] >= best[-1] - 1e-5 for (a, d), x in got.items() if a == q["id"])
    assert unanchored > 50


def test_calibration_follows_the_labels(spark):
    df = spark.range(4000).select(((F.col("id") % 41) - 20.0).alias("gap"), (F.col("id") % 41 > 25).alias("yes"))
    a, b = m.calibrate(df, F.col("yes"))
    assert b > 0 and -8 < -a / b < 8
    assert m.calibrate(df.limit(0), F.col("yes")) == (0.0, 0.0)


def test_empty_tables(spark):
    c, p = frames(spark, *data(random.Random(1), 5))
    for x, y in ((c.limit(0), p), (c, p.limit(0)), (c.limit(0), p.limit(0))):
        assert m.candidates(x, y).count() == 0 and m.matches(x, y).count() == 0
