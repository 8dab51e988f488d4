"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import Tables


def labelled(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links`` with ca and cb, the components of a and b; a node that ``known`` does not have is its own."""
    for side in ("a", "b"):
        links = links.join(known.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return links


def components(links: DataFrame, tables: Tables, name: str, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b); comp is the smallest node of its component.

    ``known`` is what this function gave for earlier links: the answer is that of the earlier
    and the new links together, and only links between two known components are followed.

    Each round points every node at its smallest neighbour, follows the pointers to the
    roots by doubling, and contracts every tree to its root; what is left are links
    between roots. Every step is an aggregation or an equi-join, and every round a written
    table; rounds grow with the logarithm of the largest component.
    """
    links = links.select("a", "b")
    if known is not None:
        links = labelled(links, known).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    edges = tables.write(links.where("a <> b").distinct(), f"{name}-edges-0")
    found, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        points = tables.write(points, f"{name}-points-{turn}-0")
        hop = 0
        while True:
            ahead = points.select(F.col("node").alias("to"), F.col("to").alias("then"))
            jumped = tables.write(points.join(ahead, "to", "left").select("node", F.coalesce("then", "to").alias("to"), (F.coalesce("then", "to") != F.col("to")).alias("moved")), f"{name}-points-{turn}-{hop + 1}")
            moved = not jumped.where("moved").isEmpty()
            points, hop = jumped.drop("moved"), hop + 1
            if not moved:
                break
        roots = points.select("node", F.col("to").alias("comp"))
        found = roots if found is None else tables.write(_moved(found, roots), f"{name}-found-{turn}")
        at = lambda side: points.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))
        left = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b")
        turn += 1
        edges = tables.write(left.distinct(), f"{name}-edges-{turn}")
    if found is None:
        return known if known is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    if known is None:
        return found
    return tables.write(_moved(known, found).unionByName(found.join(known, "node", "left_anti").select("node", "comp")), name)


def _moved(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """``earlier`` with its components (nodes of ``later``, or unchanged) replaced by theirs."""
    step = later.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return earlier.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
