"""Connected components for graphs of junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.lineage import cut
from strandline.operators.skew import join_per_key


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes with an edge, component being the smallest node: alternating large and small stars until nothing changes.

    A large star links each node's larger neighbours to its smallest neighbour, a small star links each node's smaller neighbours, and the node
    itself, to the smallest of them. Edges with a null are left out; loops alone make a component of one node.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = cut(pairs.select("u").union(pairs.select("v")).distinct())
    links = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def stars(both: DataFrame, only_larger: bool) -> DataFrame:
        low = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"), F.count(F.lit(1)).alias("n")))
        met = join_per_key(both, low, ["u"], "n")
        if only_larger:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return met.select(F.col("v").alias("u"), F.col("low").alias("v")).union(met.select("u", "low")).where("u <> v")

    while True:
        large = cut(stars(links.union(links.select("v", "u")).distinct(), True).where("u <> v").distinct())
        after = cut(stars(large, False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty():
            break
        links = after
    return nodes.join(links, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
