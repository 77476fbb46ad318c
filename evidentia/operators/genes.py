"""Gene symbols against a nomenclature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import strip

APPROVED, CORRECTED, AMBIGUOUS, UNKNOWN = "approved", "corrected", "ambiguous", "unknown"


def approved_symbols(nomenclature: DataFrame) -> DataFrame:
    """``key`` (upper case) and ``symbol`` of the approved rows; of equal keys the last symbol by code point."""
    rows = nomenclature.where(F.col("status") == "Approved") if "status" in nomenclature.columns else nomenclature
    return rows.where(strip(F.col("symbol")) != "").groupBy(F.upper(strip(F.col("symbol"))).alias("key")).agg(F.max(strip(F.col("symbol"))).alias("symbol"))


def aliases(nomenclature: DataFrame) -> DataFrame:
    """``key``, the number of approved symbols that have it as an alias or former symbol, and one of them."""
    rows = nomenclature.where(F.col("status") == "Approved") if "status" in nomenclature.columns else nomenclature
    listed = F.split(F.concat_ws("|", "alias_symbol", "prev_symbol"), r"\|")
    each = rows.select(strip(F.col("symbol")).alias("symbol"), F.explode(listed).alias("alias")).withColumn("key", F.upper(strip(F.col("alias"))))
    return each.where("key != ''").groupBy("key").agg(F.count_distinct("symbol").alias("owners"), F.min("symbol").alias("owner"))


def standardized(entries: DataFrame, nomenclature: DataFrame) -> DataFrame:
    """Entries with ``marker`` corrected, ``marker_status``, and ``marker_original`` where it was corrected or is ambiguous.

    An approved symbol wins over an alias.  A null symbol becomes an empty,
    unknown one; an unknown or ambiguous symbol keeps its text.
    """
    keyed = entries.withColumn("key", F.upper(strip(F.col("marker"))))
    found = keyed.join(approved_symbols(nomenclature), "key", "left").join(aliases(nomenclature), "key", "left")
    blank = F.coalesce(F.col("key"), F.lit("")) == ""
    status = F.when(blank, UNKNOWN).when(F.col("symbol").isNotNull(), APPROVED).when(F.col("owners") == 1, CORRECTED).when(F.col("owners") > 1, AMBIGUOUS).otherwise(UNKNOWN)
    fixed = F.when(F.col("marker").isNull(), "").when(blank, F.col("marker")).otherwise(F.coalesce("symbol", F.when(F.col("owners") == 1, F.col("owner")), strip(F.col("marker"))))
    out = found.withColumn("marker_status", status).withColumn("marker_original", F.when(F.col("marker_status").isin(CORRECTED, AMBIGUOUS), F.col("marker"))).withColumn("marker", fixed)
    return out.select(*entries.columns, "marker_status", "marker_original")


def unmapped(entries: DataFrame) -> DataFrame:
    """Unknown symbols, as written, with how often they occur, most frequent first."""
    symbol = strip(F.col("marker"))
    return entries.where((F.col("marker_status") == UNKNOWN) & (symbol != "")).groupBy(symbol.alias("symbol")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "symbol")


def validation_counts(entries: DataFrame, by: str = "pmcid") -> DataFrame:
    """Numbers of corrected, ambiguous and unknown symbols of each paper."""
    return entries.groupBy(by).agg(*[F.count_if(F.col("marker_status") == s).alias(s) for s in (CORRECTED, AMBIGUOUS, UNKNOWN)])
