"""Entries into the star's tables, as sets.

Keys are hashes of natural keys, so that loads need no counter and a second
load of the same entries adds nothing.  Two natural keys with one hash are
found where rows of a key meet, and stop the load instead of losing a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.star import Star
from ..schema import ENTRY_KEYS
from ..session import scratch
from .entries import FIELDS

#: The natural key of each dimension's rows.
NATURAL = {"markers": ("symbol",), "cell_types": ("name",), "cell_subtypes": ("name", "cell_type_id"), "tissues": ("name",), "diseases": ("name",), "papers": ("pmcid",)}


def _key(*parts: str | Column) -> Column:
    """A positive key of natural keys; null if the first is."""
    first = F.col(parts[0]) if isinstance(parts[0], str) else parts[0]
    return F.when(first.isNotNull(), F.bitwise_not(F.lit(-(1 << 63)).cast("long")).bitwiseAND(F.xxhash64(*parts)))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _reason() -> Column:
    """Why an entry can't be loaded; null if it can."""
    return F.coalesce(*[F.when(_blank(c), F.lit(f"no {name}")) for c, name in (("pmcid", "paper"), ("cell_type", "cell type"), ("marker", "marker"))])


def judged(entries: DataFrame) -> DataFrame:
    """Entries with the ``reason`` why they can't be loaded, null where they can."""
    return entries.withColumn("reason", _reason())


def unfit(entries: DataFrame) -> DataFrame:
    """Entries that can't be loaded, with the ``reason``."""
    return judged(entries).where("reason is not null")


def different(entries: DataFrame) -> DataFrame:
    """Entries that can be loaded, each once by its paper, fields and status; a blank subtype is none, a missing status approved."""
    rows = entries.where(_reason().isNull())
    status = F.coalesce("marker_status", F.lit("approved")) if "marker_status" in entries.columns else F.lit("approved")
    return rows.withColumns({"marker_status": status, "cell_subtype": F.when(~_blank("cell_subtype"), F.col("cell_subtype"))}).select("pmcid", *FIELDS, "marker_status").distinct()


def keyed_entries(entries: DataFrame) -> DataFrame:
    """Different entries with the keys of their parts."""
    return entries.withColumns(
        {
            "cell_type_id": _key("cell_type"),
            "cell_subtype_id": _key("cell_subtype", "cell_type"),
            "marker_id": _key("marker"),
            "tissue_id": _key("tissue"),
            "disease_id": _key("disease"),
            "paper_id": _key("pmcid"),
        }
    )


def _one_of(key: str, natural: Column, rows: DataFrame) -> DataFrame:
    """``id`` and the natural key of each key; an error where a key has two."""
    clash = F.raise_error(F.concat(F.lit("two names have the key "), F.col(key))).cast(rows.select(natural.alias("n")).schema[0].dataType)
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(natural).alias("least"), F.max(natural).alias("most"))
    return own.select(F.col(key).alias("id"), F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(clash).alias("natural"))


def rows_of(keyed: DataFrame, papers: DataFrame) -> dict[str, DataFrame]:
    """The rows that keyed entries have in each table, as if loaded into an empty star.

    ``citations`` are the pairs of a marker and a paper.  Of papers with one id
    the first by title and pmid counts; of entries with the same six keys the
    first status.
    """
    def named(key: str, name: str, column: str) -> DataFrame:
        return _one_of(key, F.col(name), keyed).withColumnRenamed("natural", column)

    subtypes = _one_of("cell_subtype_id", F.struct(F.col("cell_subtype").alias("name"), "cell_type_id"), keyed)
    own_papers = papers.where(~_blank("pmcid")).join(keyed.select("pmcid").distinct(), "pmcid", "left_semi")
    first = own_papers.groupBy("pmcid").agg(F.min(F.struct("title", "pmid")).alias("x"))
    entries = keyed.groupBy(*ENTRY_KEYS).agg(F.min("marker_status").alias("marker_status"))
    id_of_six = _key(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in ENTRY_KEYS]))
    return {
        "entries": entries.select(id_of_six.alias("id"), *ENTRY_KEYS, "marker_status"),
        "markers": named("marker_id", "marker", "symbol"),
        "cell_types": named("cell_type_id", "cell_type", "name"),
        "cell_subtypes": subtypes.select("id", "natural.name", "natural.cell_type_id"),
        "tissues": named("tissue_id", "tissue", "name"),
        "diseases": named("disease_id", "disease", "name"),
        "papers": first.select(_key("pmcid").alias("id"), "x.pmid", "pmcid", "x.title"),
        "citations": keyed.select("marker_id", "paper_id").distinct(),
    }


def not_in(table: str, rows: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of a table that it lacks; those it has stay as the first writer left them."""
    if table == "citations":
        return rows.join(old, ["marker_id", "paper_id"], "left_anti")
    if table == "entries":
        known = old.select([F.col(k).alias(f"old_{k}") for k in ENTRY_KEYS])
        return rows.join(known, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in ENTRY_KEYS]), "left_anti")
    natural = NATURAL[table]
    known = old.select("id", F.struct(*[F.col(c) for c in natural]).alias("__old"))
    clash = F.raise_error(F.concat(F.lit(f"{table} has another name for the key "), F.col("id"))).cast("boolean")
    new = F.when(F.col("__old").isNull(), True).when(F.col("__old") == F.struct(*[F.col(c) for c in natural]), False).otherwise(clash)
    return rows.join(known, "id", "left").where(new).drop("__old")


def load(entries: DataFrame, papers: DataFrame, existing: Star | None = None) -> Star:
    """The star with the entries of papers (``pmcid``, five fields, optional ``marker_status``) added.

    Papers without an id and entries without cell type or marker are left out.
    Entries are unique by their six keys, nulls being equal.  Citation counts
    of markers are counted anew.  The different entries are written to a scratch
    folder, so that the input is read once and not once for each table.
    """
    spark, at, fit = entries.sparkSession, scratch(entries.sparkSession), different(entries)
    fit.write.parquet(at)
    parts = rows_of(keyed_entries(spark.read.schema(fit.schema).parquet(at)), papers)
    del parts["citations"]
    parts["markers"] = parts["markers"].withColumn("citation_count", F.lit(0).cast("long"))
    if existing is not None:
        old = existing.__dict__
        parts = {t: old[t].unionByName(not_in(t, rows, old[t]), allowMissingColumns=True) for t, rows in parts.items()}
    star = Star(**parts)
    return Star(**{**parts, "markers": star.refreshed_markers()})
