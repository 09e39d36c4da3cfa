"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import runtime


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each node joins its larger, then
    its smaller neighbours to its smallest one, until nothing changes. Both steps are an aggregate that
    combines before the shuffle and a join, so a node with very many links is no single task's work.
    Self links and repeated links do no harm; nodes without links have no row.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    spent: list[str] = []
    pairs = runtime.table(pairs, spent)
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        old, spent = spent, []
        pairs = runtime.table(small.filter("a > b").distinct(), spent)
        runtime.remove(links.sparkSession, old)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
