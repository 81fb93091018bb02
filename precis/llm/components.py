"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the links ``a, b``.

    Alternates two steps until nothing changes: every node hangs its larger neighbours below the
    smallest node it knows, then its smaller ones. A node's smallest neighbour is an aggregate that is
    combined before the shuffle, and the links come back by a join, so a hub is split like any skewed
    key. Each round is written, and only a count and a checksum reach the driver.
    """
    tree = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tree, before = written(tree.distinct(), "links"), None
    while True:
        both = tree.union(tree.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = written(large.distinct(), "larger")
        least = tree.groupBy("a").agg(F.min("b").alias("m"))
        small = tree.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        tree = written(small.union(least).distinct(), "smaller")
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            return tree.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                tree.select("b", "b").distinct())
        before = now
