"""Matching of records of two tables that share no identifier, by retrieval over all their attributes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import contig, kind
from strandline.lineage import cut
from strandline.operators.skew import join_per_key, join_split

K1, B = 1.2, 0.75
#: Weight of a token of an anchoring attribute against that of any other (BM25F).
BOOST = 4.0
#: Slack of comparisons of scores with bounds, above the rounding of scores.
NEAR = 1e-6


def index(docs: DataFrame) -> DataFrame:
    """BM25 weights of (id, anchors, others): arrays of tokens become arrays of (token, weight).

    Weights use all records: idf from how many hold the token, saturation and length from the record's number of distinct tokens; anchors count BOOST times.
    """
    both = F.array_distinct(F.concat("anchors", "others"))
    sized = docs.withColumn("dl", F.size(both))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"))
    held = F.explode(F.transform(both, lambda t: F.struct(t.alias("token"), F.when(F.array_contains("anchors", t), BOOST).otherwise(1.0).alias("boost"))))
    tokens = sized.select("id", "dl", held.alias("t")).select("id", "dl", "t.*")
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n, avg = totals.select("n").scalar(), totals.select("avg").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("boost") * idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / avg))
    return tokens.join(frequency, "token").withColumn("weight", weight).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("weights"))


def _scored(pairs: DataFrame, queries: DataFrame, weighted: DataFrame) -> DataFrame:
    """Pairs (query, doc) with the whole BM25 score over all attributes, rounded so that the order of the sum makes no difference."""
    asked = queries.select(F.col("id").alias("query"), F.concat("anchors", "others").alias("tokens"))
    # Spark's size estimates of what was cut are far too low for a broadcast.
    full = pairs.join(asked.hint("merge"), "query").join(weighted.withColumnRenamed("id", "doc").hint("merge"), "doc")
    shared = F.filter("weights", lambda w: F.array_contains("tokens", w["token"]))
    score = F.aggregate(shared, F.lit(0.0), lambda s, w: s + w["weight"])
    return full.select("query", "doc", F.round(score, 9).alias("score"))


def _anchored(queries: DataFrame, docs: DataFrame) -> DataFrame:
    lists = docs.select(F.col("id").alias("doc"), F.explode(F.array_distinct("anchors")).alias("token"))
    probes = queries.select(F.col("id").alias("query"), F.explode(F.array_distinct("anchors")).alias("token"))
    return join_split(probes, lists, ["token"]).select("query", "doc").distinct()


def read_lists(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows (query, token, bound, floor, reads) of the inverted lists that each query's tokens have. postings: (doc, token, weight).

    floor is the least score of a record that shares an anchor with the query, the smallest weight in the lists of its anchors. A query's lists are taken by
    rising upper bound, the greatest weight in each; those whose bounds sum to less than floor needn't be read, since a record that is in no other list
    stays below floor. So no record that scores floor or more is missed, whichever lists have to be read for it.
    """
    bounds = postings.groupBy("token").agg(F.max("weight").alias("bound"), F.min("weight").alias("least"))
    tokens = F.explode(F.array_distinct(F.concat("anchors", "others")))
    asked = queries.select(F.col("id").alias("query"), "anchors", tokens.alias("token")).withColumn("is_anchor", F.array_contains("anchors", F.col("token"))).drop("anchors")
    # One row per token on this side, so the merge join's hot tokens are left to adaptive execution.
    own = asked.join(bounds.hint("merge"), "token")
    rising = Window.partitionBy("query").orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floors = own.withColumn("floor", F.min(F.when(F.col("is_anchor"), F.col("least"))).over(Window.partitionBy("query"))).where("floor is not null")
    return floors.select("query", "token", "bound", "floor", (F.sum("bound").over(rising) >= F.col("floor") - NEAR).alias("reads"))


def retrieve(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """Rows (query, doc, score) of all records that score at least the query's floor (read_lists), or with k of its k best of these, with all that tie.

    queries and docs: (id, anchors, others), arrays of tokens; ids are unique. A record that shares an anchor reaches the floor, so what must be found by
    one is found, whatever it has else in common. Null or empty arrays match nothing. Lists that very many records and queries have are split.
    """
    weighted = cut(index(docs))
    postings = weighted.select(F.col("id").alias("doc"), F.inline("weights"))
    lists = cut(read_lists(queries, postings))
    met = join_split(lists.where("reads").select("query", "token"), postings.select("token", "doc"), ["token"]).select("query", "doc").distinct()
    floors = lists.groupBy("query").agg(F.first("floor").alias("floor"))
    scored = _scored(met, queries, weighted).join(floors.hint("merge"), "query").where(F.col("score") >= F.col("floor") - NEAR).drop("floor")
    return scored if k is None else top(scored, "query", k)


def strongest(askers: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Rows (a, b, score): the k best entries b of each asker a by the sum over shared tokens of both weights' product, of equal ones the lowest b.

    askers: (a, tokens) and lists: (b, tokens), arrays of (token, weight), weights above 0; a and b are unique. Exact: an asker's lists are read
    by falling upper bound (its weight times the list's greatest), one in each turn, until its k-th score exceeds what the unread ones can give.
    """
    postings = cut(lists.select("b", F.inline("tokens")))
    bounds = postings.groupBy("token").agg(F.max("weight").alias("most"))
    asked = askers.select("a", F.inline("tokens")).join(bounds.hint("merge"), "token").withColumn("bound", F.col("weight") * F.col("most"))
    falling = Window.partitionBy("a").orderBy(F.desc("bound"), "token")
    rest = F.coalesce(F.sum("bound").over(falling.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    asked = cut(asked.select("a", "token", F.row_number().over(falling).alias("turn"), rest.alias("rest")))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    found, unread, turn = None, asked.select("a").distinct(), 0
    while True:
        turn += 1
        due = cut(asked.where(F.col("turn") == turn).join(unread.hint("merge"), "a", "left_semi"))
        if due.isEmpty():
            break
        met = due.select("a", "token").join(postings.select("b", "token").hint("merge"), "token").select("a", "b")
        both = met.join(askers.withColumnRenamed("tokens", "x").hint("merge"), "a").join(lists.withColumnRenamed("tokens", "y").hint("merge"), "b")
        product = F.aggregate("x", F.lit(0.0), lambda s, w: s + w["weight"] * F.coalesce(F.aggregate(F.filter("y", lambda v: v["token"] == w["token"]), F.lit(0.0), lambda t, v: t + v["weight"]), F.lit(0.0)))
        new = both.select("a", "b", F.round(product, 9).alias("score"))
        seen = new if found is None else new.unionByName(found).dropDuplicates(["a", "b"])
        found = cut(seen.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"))
        low = found.groupBy("a").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
        unread = due.join(low.hint("merge"), "a").where((F.col("n") < k) | (F.col("low") <= F.col("rest") + NEAR)).select("a")
    return found if found is not None else askers.join(lists.select("b"), how="cross").select("a", "b", F.lit(0.0).alias("score")).limit(0)


def _profiles(df: DataFrame, row: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """Rows by what they hold in common: (row, profile), and (profile, tokens)."""
    named = cut(df.withColumn(profile, F.sha2(F.to_json("tokens"), 256)))
    return named.select(row, profile), cut(named.groupBy(profile).agg(F.first("tokens").alias("tokens")))


def _per_row(rows: DataFrame, per_profile: DataFrame, profile: str) -> DataFrame:
    """Inner join of (row, profile) with one row per profile; a profile may be that of most rows."""
    sizes = rows.groupBy(profile).agg(F.count(F.lit(1)).alias("_rows"))
    return join_per_key(rows, cut(per_profile.join(sizes.hint("merge"), profile)), [profile], "_rows")


def ranked(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Rows (query, doc, score, doc_best) with all pairs that share an anchor and each query's k best docs, at least 2, by BM25 over all attributes.

    queries and docs: (id, anchors, others, second), second being those of others that say where a record's second end is. doc_best is the best
    score of the doc with any query. Without a shared place a score depends only on the tokens that many records have in common, so these
    are ranked once for each combination that occurs (strongest). A query's k-th score among these and the anchored pairs is its threshold: the lists
    of second are read only where a query or a doc could exceed its own by them. Pairs with a shared place that tie with the k-th are all there; of
    pairs without one that tie, as many as k needs.
    """
    k = max(k, 2)
    weighted = cut(index(docs))
    held = docs.select("id", F.array_except("others", "second").alias("held")).join(weighted.hint("merge"), "id")
    theirs, entries = _profiles(held.select(F.col("id").alias("doc"), F.filter("weights", lambda w: F.array_contains("held", w["token"])).alias("tokens")), "doc", "b")
    common = F.array_sort(F.array_distinct(F.array_except("others", "second")))
    mine, askers = _profiles(queries.select(F.col("id").alias("query"), F.transform(common, lambda t: F.struct(t.alias("token"), F.lit(1.0).alias("weight"))).alias("tokens")), "query", "a")

    forward = strongest(askers, entries, k)
    few = theirs.withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy("doc"))).where(F.col("_r") <= k).drop("_r")
    by_asker = Window.partitionBy("a").orderBy(F.desc("score"), "b", "doc")
    first = forward.join(few.hint("merge"), "b").withColumn("_r", F.row_number().over(by_asker)).where(F.col("_r") <= k)
    first = first.groupBy("a").agg(F.collect_list("doc").alias("docs"), F.max("score").alias("most"))
    seeded = cut(_per_row(mine, first, "a"))
    back = strongest(entries.withColumnRenamed("b", "a"), askers.withColumnRenamed("a", "b"), 1).select(F.col("a").alias("b"), F.col("score").alias("most"))
    reached = cut(_per_row(theirs, back, "b"))

    pairs = _anchored(queries, docs).union(seeded.select("query", F.explode("docs").alias("doc"))).distinct()
    known = cut(_scored(pairs, queries, weighted))
    kth = known.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") == k).select("query", F.col("score").alias("threshold"))
    weights = weighted.select("id", F.inline("weights"))
    places = docs.select("id", F.explode("second").alias("token")).join(weights.hint("merge"), ["id", "token"])
    bounds = places.groupBy("token").agg(F.max("weight").alias("bound"))
    probes = queries.select(F.col("id").alias("query"), F.explode("second").alias("token")).join(bounds.hint("merge"), "token")
    probes = probes.join(seeded.select("query", "most").hint("merge"), "query", "left").join(kth.hint("merge"), "query", "left")
    probes = cut(probes.select("query", "token", F.coalesce(F.col("bound") + F.coalesce("most", F.lit(0.0)) + NEAR >= F.col("threshold"), F.lit(True)).alias("reads")))
    top_known = known.groupBy("doc").agg(F.max("score").alias("threshold"))
    places = places.withColumnRenamed("id", "doc").join(reached.select("doc", "most").hint("merge"), "doc", "left").join(top_known.hint("merge"), "doc", "left")
    places = cut(places.select("doc", "token", F.coalesce(F.col("weight") + F.coalesce("most", F.lit(0.0)) + NEAR >= F.col("threshold"), F.lit(True)).alias("reads")))
    more = probes.where("reads").drop("reads").join(places.drop("reads").hint("merge"), "token").union(probes.drop("reads").join(places.where("reads").drop("reads").hint("merge"), "token"))
    more = more.select("query", "doc").distinct().join(known.select("query", "doc").hint("merge"), ["query", "doc"], "left_anti")
    every = cut(known.unionByName(_scored(more, queries, weighted)))
    doc_best = every.groupBy("doc").agg(F.max("score").alias("_best")).join(reached.select("doc", "most").hint("merge"), "doc", "left")
    return every.join(doc_best.select("doc", F.greatest("_best", "most").alias("doc_best")).hint("merge"), "doc")


def top(pairs: DataFrame, side: str, k: int) -> DataFrame:
    """The k best pairs of each record of a side; all pairs that tie with the k-th stay."""
    order = Window.partitionBy(side).orderBy(F.desc("score"))
    return pairs.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= k).drop("_r")


def mutual(pairs: DataFrame) -> DataFrame:
    """Adds is_mutual (both are the other's nearest, ties included) and gap, by how much the score exceeds that of the query's best other record.

    A pair that is not its query's best has a gap below 0; without another record the gap is the whole score. Other queries of the record
    don't lessen the gap, for several queries may rightly have one record. pairs need each query's two best; doc_best is each doc's best score.
    """
    of_query = Window.partitionBy("query")
    ranked = pairs.withColumn("_n", F.row_number().over(of_query.orderBy(F.desc("score"), "doc")))
    best = F.max("score").over(of_query)
    second = F.coalesce(F.max(F.when(F.col("_n") == 2, F.col("score"))).over(of_query), F.lit(0.0))
    rival = F.when(F.col("_n") == 1, second).otherwise(best)
    is_mutual = (F.col("score") >= best - NEAR) & (F.col("score") >= F.col("doc_best") - NEAR)
    return ranked.withColumns({"is_mutual": is_mutual, "gap": F.col("score") - rival}).drop("_n")


def calibrate(pairs: DataFrame, label: Column, step: float = 0.25, most: float = 64.0) -> tuple[float, float]:
    """Intercept and slope of the logistic model of a true label given the gap.

    Fitted by Newton's method on how many pairs, and true ones, fall in each step of the gap between -most and most: all pairs count, and the
    driver gets at most 2 * most / step + 1 rows. Half a true and a false pair at gap 0 keep separable or empty input finite.
    """
    x = F.round(F.least(F.greatest(F.col("gap"), F.lit(-most)), F.lit(most)) / step) * step
    rows = pairs.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(label.cast("double")).alias("yes")).collect()
    xs = np.array([0.0] + [r["x"] for r in rows])
    n = np.array([1.0] + [float(r["n"]) for r in rows])
    yes = np.array([0.5] + [float(r["yes"] or 0) for r in rows])
    features = np.stack([np.ones_like(xs), xs], axis=1)
    ridge = np.array([0.0, 1e-3])

    def likelihood(beta: np.ndarray) -> float:
        z = features @ beta
        return float((yes * z - n * np.logaddexp(0, z)).sum() - (ridge * beta**2).sum() / 2)

    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -500, 500)))
        gradient = features.T @ (yes - n * p) - ridge * beta
        hessian = (features * (n * p * (1 - p))[:, None]).T @ features + np.diag(ridge + 1e-9)
        move = np.linalg.solve(hessian, gradient)
        while np.abs(move).max() > 1e-9 and likelihood(beta + move) < likelihood(beta):
            move = move / 2
        beta = beta + move
        if np.abs(move).max() <= 1e-9:
            break
    return float(beta[0]), float(beta[1])


# The attributes of rearrangements.

#: Slack of positions, and the bound that stands for a missing interval.
SLACK, UNKNOWN_BOUND = 15, 200
#: Cells of positions are 2**level wide; a record uses the narrowest level that holds its tolerance.
LEVELS = list(range(6, 41, 2))


def _bound(interval: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(interval, lambda x: F.abs(x))).cast("long"), F.lit(UNKNOWN_BOUND)) + SLACK


def _standard(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Distinct records in common terms, each with an id of its own content."""
    rows = df.select(*[c.alias(n) for n, c in columns.items()]).distinct()
    size = F.coalesce(F.abs("len"), F.when(F.coalesce(F.col("kind") != "INS", F.lit(True)), F.abs(F.col("pos_b") - F.col("pos_a"))))
    rows = rows.withColumn("size", F.when(F.coalesce(F.col("kind") != "BND", F.lit(True)), size))
    return rows.withColumn("id", F.sha2(F.to_json(F.struct(*columns)), 256))


def calls(df: DataFrame) -> DataFrame:
    c = F.col
    return _standard(df.where("call_id is not null and pos is not null"), {
        "key": c("call_id"), "chr_a": contig(c("chrom")), "pos_a": c("pos"), "chr_b": contig(c("chr2")), "pos_b": c("pos2"), "kind": kind(c("sv_type")), "len": c("sv_len"),
    })


def panel(df: DataFrame) -> DataFrame:
    c = F.col
    return _standard(df.where("panel_id is not null and pos is not null"), {
        "key": c("panel_id"), "chr_a": contig(c("chrom")), "pos_a": c("pos"), "chr_b": contig(c("chr2")), "pos_b": c("stop_pos"), "kind": kind(c("svtype")), "len": c("svlen"),
        "tol_a": _bound(c("cipos")), "tol_b": _bound(c("ciend")),
    })


def _place(role: Column, chromosome: Column, level: Column, cell: Column) -> Column:
    return F.concat_ws("|", F.lit("at"), role, chromosome, level, cell)


def _others() -> tuple[Column, Column]:
    """others, tokens of attributes that many records share: contigs, kind, steps of a tenth of the size, and second, where the second end is."""
    size = F.floor(F.log(F.col("size") + 10.0) * 10)
    tokens = [
        F.concat(F.lit("contig|"), F.col("chr_a")), F.concat(F.lit("contig2|"), F.coalesce("chr_b", "chr_a")), F.concat(F.lit("kind|"), F.col("kind")),
        F.concat(F.lit("size|"), size), F.concat(F.lit("size|"), size + 1),
    ]
    second = F.array(F.concat_ws("|", F.lit("end"), F.coalesce("chr_b", "chr_a"), F.floor(F.coalesce("pos_b", "pos_a") / 1024)))
    return F.array_compact(F.concat(F.array(*tokens), second)).alias("others"), second.alias("second")


def call_tokens(rows: DataFrame, levels: list[int]) -> DataFrame:
    """A call is at one cell of every level in use; a translocation with either end."""
    roles = F.when(F.col("kind").isNull(), F.array(F.lit("?"))).when(F.col("kind") == "BND", F.array(F.lit("BND"))).otherwise(F.array("kind", F.lit("*")))

    def cells(chromosome: str, pos: str) -> Column:
        def at(level: int) -> Column:
            return F.transform(roles, lambda r: _place(r, F.col(chromosome), F.lit(level), F.floor(F.col(pos) / (1 << level))))

        each = [at(lv) for lv in levels]
        there = F.flatten(F.array(*each)) if each else F.array().cast("array<string>")
        return F.when(F.col(chromosome).isNotNull() & F.col(pos).isNotNull(), there).otherwise(F.array().cast("array<string>"))

    second = F.when(F.col("kind") == "BND", cells("chr_b", "pos_b")).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.concat(cells("chr_a", "pos_a"), second).alias("anchors"), *_others())


def level_of(tolerance: Column) -> Column:
    chain = F.lit(LEVELS[-1])
    for lv in reversed(LEVELS[:-1]):
        chain = F.when(2 * tolerance + 1 <= (1 << lv), F.lit(lv)).otherwise(chain)
    return chain


def panel_tokens(rows: DataFrame) -> DataFrame:
    """A panel record is at the one or two cells that its tolerance around the first position touches."""
    roles = F.when(F.col("kind").isNull(), F.array(F.lit("*"), F.lit("?"))).when(F.col("kind") == "BND", F.array(F.lit("BND"))).otherwise(F.array("kind", F.lit("?")))
    width = F.pow(F.lit(2.0), F.col("level"))
    cells = F.sequence(F.floor((F.col("pos_a") - F.col("tol_a")) / width).cast("long"), F.floor((F.col("pos_a") + F.col("tol_a")) / width).cast("long"))
    there = F.flatten(F.transform(roles, lambda r: F.transform(cells, lambda c: _place(r, F.col("chr_a"), F.col("level"), c))))
    anchors = F.when(F.col("chr_a").isNotNull(), there).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("level", level_of(F.col("tol_a"))).select("id", anchors.alias("anchors"), *_others())


def agrees(c: str, p: str) -> Column:
    """Whether a call and a panel record, columns with these prefixes, describe the same rearrangement."""
    x, y = (lambda n: F.col(c + n)), (lambda n: F.col(p + n))

    def near(chr_x: str, pos_x: str, chr_y: str, pos_y: str, tol: str) -> Column:
        return (x(chr_x) == y(chr_y)) & (F.abs(x(pos_x) - y(pos_y)) <= y(tol))

    direct = near("chr_a", "pos_a", "chr_a", "pos_a", "tol_a") & near("chr_b", "pos_b", "chr_b", "pos_b", "tol_b")
    swapped = near("chr_b", "pos_b", "chr_a", "pos_a", "tol_a") & near("chr_a", "pos_a", "chr_b", "pos_b", "tol_b")
    is_x, is_y = F.coalesce(x("kind") == "BND", F.lit(False)), F.coalesce(y("kind") == "BND", F.lit(False))
    is_ins = F.coalesce(x("kind") == "INS", F.lit(False)) | F.coalesce(y("kind") == "INS", F.lit(False))
    size_x, size_y = [F.when(is_ins, F.abs(s("len"))).otherwise(s("size")) for s in (x, y)]
    off = F.abs(size_x - size_y)
    fits = F.coalesce((off <= 5) | (off * 20 <= F.greatest(size_x, size_y)), F.lit(True))
    same_kind = F.coalesce(x("kind") == y("kind"), F.lit(True))
    plain = ~is_x & ~is_y & same_kind & near("chr_a", "pos_a", "chr_a", "pos_a", "tol_a") & fits
    return F.coalesce((is_x & is_y & (direct | swapped)) | plain, F.lit(False))


def _described(scored: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    """Scored pairs with the records' ids and agrees."""
    own = c.select(F.col("id").alias("query"), *[F.col(n).alias(f"c_{n}") for n in c.columns if n != "id"])
    theirs = p.select(F.col("id").alias("doc"), *[F.col(n).alias(f"p_{n}") for n in p.columns if n != "id"])
    full = scored.join(own.hint("merge"), "query").join(theirs.hint("merge"), "doc")
    return full.select(*scored.columns, F.col("c_key").alias("call_id"), F.col("p_key").alias("panel_id"), agrees("c_", "p_").alias("agrees"))


def _records(call_rows: DataFrame, panel_rows: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    c, p = cut(calls(call_rows)), cut(panel(panel_rows))
    return c, p, sorted(r[0] for r in p.select(level_of(F.col("tol_a"))).distinct().collect())  # at most len(LEVELS)


def candidates(call_rows: DataFrame, panel_rows: DataFrame) -> DataFrame:
    """Scored pairs of calls and panel records that reach the call's floor, with agrees, whether they describe the same rearrangement. Columns query, doc, call_id, panel_id, score, agrees.

    Repeated deliveries of a record are one record; deliveries of an id that differ are records of their own with the same id. Records
    without id or position match nothing. Pairs that agree always share a cell, which is an anchor, so they all reach the floor.
    """
    c, p, levels = _records(call_rows, panel_rows)
    return _described(retrieve(call_tokens(c, levels), panel_tokens(p)), c, p)


def matches(call_rows: DataFrame, panel_rows: DataFrame, k: int = 10) -> DataFrame:
    """Every pair that agrees, and the k best panel records of each call, with confidence: (call_id, panel_id, score, is_mutual, confidence).

    confidence is the calibrated chance that a pair of this gap describes the same rearrangement; pairs that tie with the k-th stay as far as
    ranked has them. k bounds only pairs that don't agree. Of several records of the same two ids one that agrees counts, of these the one with the best score.
    """
    c, p, levels = _records(call_rows, panel_rows)
    found = cut(mutual(_described(ranked(cut(call_tokens(c, levels)), cut(panel_tokens(p)), k), c, p)))
    intercept, slope = calibrate(found, F.col("agrees"))
    chance = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("gap"))))
    kept = top(found, "query", k).unionByName(found.where("agrees"))
    best = F.max(F.struct("agrees", "score", "is_mutual", chance.alias("confidence"))).alias("b")
    return kept.groupBy("call_id", "panel_id").agg(best).select("call_id", "panel_id", "b.score", "b.is_mutual", "b.confidence")
