"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.store import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has a and b of one type, in any direction; returns node and root, its component's least node,
    for every node that is not itself a root.

    Alternates two steps until all edges are stars: every node hands its least neighbour to its larger ones, then
    to its smaller ones. A step is an aggregate, combined before the shuffle, and a join with it; both are written, so
    a lost executor costs a step at most, and a hub's edges, being read from a table on both sides of the join, are
    shared between tasks where they skew it (adaptive execution). The first step's join makes no more edges than there
    are and so isn't shuffled; only the second one's edges are made distinct. Neither edges nor components come to the
    driver.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        # A node is bent if it has two smaller neighbours, or smaller and larger ones: then its edges aren't a star's.
        smaller, larger = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
        bent = (smaller > 1) | (smaller > 0) & (larger > 0)
        least = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), bent.alias("bent")), "least")
        if not least.agg(F.max("bent")).first()[0]:
            discard(least)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = settle(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "edges")
        discard(now, least)
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        now = settle(small.union(least).distinct(), "edges")
        discard(large, least)
