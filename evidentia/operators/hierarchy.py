"""Types that are their own subtype, put right by what all entries say about parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.star import best_first


def pairs(entries: DataFrame) -> DataFrame:
    """Pairs of different type and subtype with how often, and where first, they occur (``pmcid``, ``pos``)."""
    unlike = entries.where("cell_subtype is not null and cell_subtype != '' and cell_type != cell_subtype")
    return unlike.groupBy("cell_type", "cell_subtype").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("pmcid", "pos")).alias("first"))


def main_parents(entries: DataFrame) -> DataFrame:
    """For each subtype the type it occurs with most often; of equals the one met first."""
    ranked = best_first(["cell_subtype"], [F.desc("count"), F.asc("first")], pairs(entries))
    return ranked.select(F.col("cell_subtype").alias("child"), F.col("cell_type").alias("parent"), "count")


def resolved(entries: DataFrame) -> DataFrame:
    """Entries with equal type and subtype changed: a known parent type keeps no subtype, a known child gets its parent.

    Counts are taken of the entries as they come, before any is changed.
    """
    known = pairs(entries)
    parents = known.select(F.col("cell_type").alias("p")).distinct()
    own = entries.join(parents, entries["cell_type"] == parents["p"], "left").join(main_parents(entries).drop("count"), F.col("cell_type") == F.col("child"), "left")
    same = F.col("cell_type") == F.col("cell_subtype")
    demote = same & F.col("p").isNull() & F.col("parent").isNotNull()
    out = own.withColumn("__sub", F.when(same & ~demote, F.lit(None)).otherwise(F.col("cell_subtype"))).withColumn("__type", F.when(demote, F.col("parent")).otherwise(F.col("cell_type")))
    return out.withColumns({"cell_subtype": F.col("__sub"), "cell_type": F.col("__type")}).select(entries.columns)
