"""Connected components of a table of links, by alternating large and small stars.

Each round hangs the neighbours of a node onto the smallest of them; both steps keep the
components and end in stars around the smallest node.  A round is written to the shared folder,
so a lost executor costs a read.  Hubs are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links run from the larger node ``a`` to the smaller node ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the links (a, b) but the smallest itself."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = materialize(links, "links")
    state = _state(links)
    while True:
        links = materialize(_small_star(_large_star(links)).where("a > b").distinct(), "stars")
        after = _state(links)
        if after == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = after
