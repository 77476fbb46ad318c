"""Answers of the star as JSON texts, one row each, in the shape that clients read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LISTED
from .star import FIELDS, PAGE_SIZE, TOP, Filters, Star

#: Name of each field's list in answers.
PLURAL = {"cell_type": "cell_types", "cell_subtype": "subtypes", "tissue": "tissues", "disease": "diseases"}


def _as_list(df: DataFrame, order: list[Column], item: Column) -> DataFrame:
    """One row with all rows of a bounded table as a list, in an order given by columns."""
    keyed = df.select(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), item.alias("item"))
    return keyed.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "item"))), lambda x: x["item"]).alias("results"))


def _json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"}).alias("json"))


def _numbered(df: DataFrame, item: Column) -> DataFrame:
    """The rows of a page, whose order is that of the sorted result."""
    return _as_list(df.withColumn("__at", F.monotonically_increasing_id()), [F.col("__at")], item)


def search_response(star: Star, filters: Filters = Filters(), page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """``total``, ``page``, ``page_size``, ``results``."""
    found = _numbered(star.search(filters, page, page_size), F.struct(*LISTED))
    return _json(star.total(filters).crossJoin(found).select("total", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), "results"))  # of single rows


def ranking_response(star: Star, limit: int = 50, **parts: str) -> DataFrame:
    """``total`` and ``results`` of the ranking, at most 500."""
    item = F.struct(F.col("marker").alias("symbol"), "citation_count", "cell_type_count", "cell_types", "tissues", "diseases")
    found = _as_list(star.ranking(limit, **parts), [-F.col("citation_count"), F.col("marker")], item)
    return _json(found.select(F.size("results").alias("total"), "results"))


def detail_response(star: Star, symbol: str, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """A marker with a page of its entries; no row if there is no such marker."""
    entries = _numbered(star.detail_entries(symbol, page, page_size), F.struct(*LISTED)).withColumnRenamed("results", "entries")
    about = star.detail(symbol).select(F.col("marker").alias("symbol"), "citation_count", "cell_types", F.col("cell_subtypes").alias("subtypes"), "tissues", "diseases", F.col("total").alias("total_entries"))
    return _json(about.crossJoin(entries).select(*about.columns, F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), "entries"))  # of single rows


def types_response(star: Star) -> DataFrame:
    found = _as_list(star.types(), [-F.col("entry_count"), F.col("name")], F.struct("name", "marker_count", "entry_count", "subtypes"))
    return _json(found.select(F.size("results").alias("total"), "results"))


def facets_response(star: Star, filters: Filters = Filters()) -> DataFrame:
    """The choices of each field, sorted."""
    choices = star.facets(filters)
    return _json(choices.agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("value")))).alias(PLURAL[f]) for f in FIELDS]))


def dashboard_response(star: Star) -> DataFrame:
    """``overview`` and ``distribution``."""
    answers = star.dashboard()
    row = answers["overview"].select(F.struct(*answers["overview"].columns).alias("overview"))
    for name in TOP:
        part = _as_list(answers[name], [-F.col("count"), F.col("name")], F.struct("name", "count"))
        row = row.crossJoin(part.withColumnRenamed("results", PLURAL[name]))  # of single rows
    return _json(row.select("overview", F.struct(*[PLURAL[n] for n in TOP]).alias("distribution")))


def initial_response(star: Star) -> DataFrame:
    """``filters``, ``search`` and ``bubble``, what a search view starts with."""
    inside = lambda df, name: df.select(F.col("json").alias(name))
    bubble = _as_list(star.bubble(limit=2000), [-F.col("count"), F.col("cell_type"), F.col("marker")], F.struct("cell_type", "marker", "count"))
    row = inside(facets_response(star), "f").crossJoin(inside(search_response(star), "s")).crossJoin(bubble.select(F.to_json("results").alias("b")))  # of single rows
    return row.select(F.concat(F.lit('{"filters":'), "f", F.lit(',"search":'), "s", F.lit(',"bubble":'), "b", F.lit("}")).alias("json"))
