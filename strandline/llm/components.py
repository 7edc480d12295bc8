"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.lineage import cut
from strandline.operators.skew import join_per_key


def groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Seed-tree pruning: one row (vertex, group) for each vertex that is linked to another one; group is the smallest vertex it is linked to.

    Each round, every vertex names the minimum of its neighbourhood to all its neighbours. A vertex that is named by nobody as a minimum drops
    out and hangs below the smallest minimum it was told, the minima it was told stay linked with each other. Rounds end when no link is left;
    what never dropped out is a seed. A parent always drops out later than its children, so seed identifiers flow down the forest in one join
    per round, last round first. The number of rounds grows with the logarithm of the vertices.

    Links in both directions, repeated links and links of a vertex with itself are allowed, rows with a null are left out, further columns are
    not read. No links give no rows. Minima are found with partial sums before the shuffle, so a vertex with very many links is no large group there; in the
    joins, which are sort-merge joins, adaptive execution splits the links of such a vertex. What a round tells and keeps is written once each.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = lambda rows: cut(rows.union(rows.select("v", "u")).distinct())
    links = first = both(links)
    dropped: list[DataFrame] = []
    while not links.isEmpty():
        named = links.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        told = links.join(named.hint("merge"), "u").select(F.col("v").alias("x"), F.col("low").alias("y")).union(named.select("u", "low"))
        told = cut(told.distinct())
        lowest = told.groupBy("x").agg(F.min("y").alias("low"), F.max(F.col("x") == F.col("y")).alias("is_minimum"))
        links = both(told.join(lowest.select("x", "low").hint("merge"), "x").where("y <> low").select(F.col("y").alias("u"), F.col("low").alias("v")))
        dropped.append(lowest.where(~F.col("is_minimum")).select(F.col("x").alias("vertex"), F.col("low").alias("parent")))
    if not dropped:
        return first.select(F.col("u").alias("vertex"), F.col("v").alias("group"))
    fallen = reduce(DataFrame.union, [d.select("vertex") for d in dropped])
    done = cut(first.select(F.col("u").alias("vertex")).distinct().join(fallen.hint("merge"), "vertex", "left_anti").select("vertex", F.col("vertex").alias("group")))
    for rows in reversed(dropped):
        of_parents = done.select(F.col("vertex").alias("parent"), "group")
        done = done.unionByName(cut(rows.join(of_parents.hint("merge"), "parent").select("vertex", "group")))
    return done


def numbered(names: DataFrame, name: str) -> DataFrame:
    """(name, id) of the distinct values of a column without null, with 64-bit ids in the order of the values."""
    # Partitions of a sorted table are in order, and so are ids that grow with the partition and the row in it.
    return cut(names.select(name).dropna().distinct().orderBy(name).withColumn("id", F.monotonically_increasing_id()))


def nearby_links(df: DataFrame, record: str, axis: str, position: str, within: int) -> DataFrame:
    """Links (a, b) whose groups are those of all pairs of records with positions on the same axis that differ by less than within.

    Positions fall into cells of that width: records of a cell are all linked, so each is linked with the cell's smallest record only, and the
    smallest records of two neighbouring cells are linked if the last position of the one and the first of the other are close enough. So the
    links number about one per record and cell, also where many records share a place. Rows with a null are left out.
    """
    rows = (
        df.select(F.col(record).alias("record"), F.col(axis).alias("axis"), F.col(position).alias("position"))
        .dropna()
        .withColumn("cell", F.floor(F.col("position") / within))
        .groupBy("axis", "cell", "record")
        .agg(F.min("position").alias("first"), F.max("position").alias("last"))
    )
    rows = cut(rows)
    cells = cut(
        rows.groupBy("axis", "cell").agg(F.min("record").alias("low"), F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    within_cell = join_per_key(rows.select("axis", "cell", "record"), cells.select("axis", "cell", "low", "n"), ["axis", "cell"], "n")
    after = cells.select("axis", (F.col("cell") - 1).alias("cell"), F.col("low").alias("next_low"), F.col("first").alias("next_first"))
    across = cells.join(after, ["axis", "cell"]).where(F.col("next_first") - F.col("last") < within)
    return within_cell.select(F.col("record").alias("a"), F.col("low").alias("b")).union(across.select("low", "next_low")).where("a <> b").distinct()


def nearby_groups(df: DataFrame, record: str, axis: str, position: str, within: int) -> DataFrame:
    """(vertex, group) of the records that nearby_links links, found with 64-bit ids in place of their names; group is the smallest name."""
    rows = df.select(F.col(record).alias("name"), F.col(axis).alias("axis"), F.col(position).alias("position")).dropna()
    ids = numbered(rows, "name")
    found = groups(nearby_links(rows.join(ids.hint("merge"), "name"), "id", "axis", "position", within), "a", "b")
    named = found.join(ids.select(F.col("id").alias("vertex"), F.col("name").alias("vertex_name")).hint("merge"), "vertex")
    # A group's name is joined once for each group, and goes to its records by the group.
    heads = found.select("group").distinct().join(ids.select(F.col("id").alias("group"), F.col("name").alias("group_name")).hint("merge"), "group")
    return named.join(heads.hint("merge"), "group").select(F.col("vertex_name").alias("vertex"), F.col("group_name").alias("group"))
