"""Connected components of a link table, by alternating large and small stars.

Every step is an aggregate plus a join on the node, so a node with very many
links never has to fit in one task (the join's skewed side can be split). Each
round is written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.session import checkpoint_dir


def _stars(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # large star: larger neighbours of a node move to its smallest neighbour
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    # small star: smaller neighbours of a node, and the node, move to the smallest of them
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of comparable values -> ``node``, ``root``: the smallest
    value in the node's component; a row for each value that some link names.
    Links to oneself and repeated links count for nothing."""
    checkpoint_dir(links.sparkSession)
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    print_of = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    links = links.checkpoint()
    before = print_of(links)
    while before[0]:
        links = _stars(links).checkpoint()
        now = print_of(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
