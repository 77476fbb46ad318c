"""Schemas of the documents that pass between stages and of the star's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# Names, types and order of columns, which files and tables have.
MARKER = StructType(
    [
        StructField("cell_type", StringType()),
        StructField("cell_subtype", StringType()),
        StructField("marker", StringType()),
        StructField("tissue", StringType()),
        StructField("disease", StringType()),
    ]
)
USAGE = StructType(
    [
        StructField("prompt_tokens", IntegerType()),
        StructField("completion_tokens", IntegerType()),
        StructField("total_tokens", IntegerType()),
    ]
)
PROCESSED = StructType(
    [
        StructField("pmcid", StringType()),
        StructField("pmid", StringType()),
        StructField("title", StringType()),
        StructField("journal", StringType()),
        StructField("year", IntegerType()),
        StructField("abstract", StringType()),
        StructField("results", StringType()),
        StructField("methods", StringType()),
        StructField("tables_md", StringType()),
        StructField("clean_text", StringType()),
        StructField("char_count", IntegerType()),
        StructField("estimated_tokens", IntegerType()),
    ]
)
EXTRACTED = StructType(
    [
        StructField("pmcid", StringType()),
        StructField("pmid", StringType()),
        StructField("title", StringType()),
        StructField("markers", ArrayType(MARKER)),
        StructField("raw_marker_count", IntegerType()),
        StructField("valid_marker_count", IntegerType()),
        StructField("model", StringType()),
        StructField("usage", USAGE),
        StructField("extracted_at", StringType()),
        StructField("validated", BooleanType()),
        StructField("original_model", StringType()),
    ]
)
NOMENCLATURE = StructType(
    [
        StructField("symbol", StringType()),
        StructField("status", StringType()),
        StructField("alias_symbol", StringType()),
        StructField("prev_symbol", StringType()),
    ]
)

PAPERS = StructType(
    [
        StructField("id", LongType()),
        StructField("pmid", StringType()),
        StructField("pmcid", StringType()),
        StructField("title", StringType()),
        StructField("journal", StringType()),
        StructField("pub_year", IntegerType()),
        StructField("fetched_at", TimestampType()),
    ]
)
CELL_TYPES = StructType([StructField("id", LongType()), StructField("name", StringType())])
TISSUES = StructType([StructField("id", LongType()), StructField("name", StringType())])
DISEASES = StructType([StructField("id", LongType()), StructField("name", StringType())])
CELL_SUBTYPES = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("cell_type_id", LongType())])
MARKERS = StructType(
    [
        StructField("id", LongType()),
        StructField("symbol", StringType()),
        StructField("name", StringType()),
        StructField("citation_count", LongType()),
    ]
)
ENTRIES = StructType(
    [
        StructField("id", LongType()),
        StructField("cell_type_id", LongType()),
        StructField("cell_subtype_id", LongType()),
        StructField("marker_id", LongType()),
        StructField("tissue_id", LongType()),
        StructField("disease_id", LongType()),
        StructField("paper_id", LongType()),
        StructField("marker_status", StringType()),
        StructField("created_at", TimestampType()),
    ]
)
#: The six keys that make an entry unique, nulls being equal.
ENTRY_KEYS = ["cell_type_id", "cell_subtype_id", "marker_id", "tissue_id", "disease_id", "paper_id"]
#: The columns of a listed entry.
LISTED = ["marker", "cell_type", "cell_subtype", "tissue", "disease", "pmid", "pmcid", "marker_status"]
