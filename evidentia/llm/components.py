"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import kept


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of each linked node, from links ``a``, ``b`` of longs.

    Returns ``node``, ``root`` for every node but the roots themselves.  Each
    round rewires all neighbours of a node to the smallest of them, first those
    above it, then those below; the rounds, whose number grows with the
    logarithm of the longest path, end when a round changes nothing.  A round's
    links are written to the shared folder.  Links with a null end and loops are
    left out; no link gives no row.
    """
    star = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct())
    seen = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
