"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes the documents that the one before kept and, but for the last,
returns documents with the same columns, extra ones included.  ``run`` writes
each result to the folder that the cluster shares and reads it again, so that a
lost executor costs at most the stage that runs, and deletes what a stage wrote
for itself.

Stages judge rows, not ids: of several rows with one id, or with none, each
stays or goes by itself.  A row is known by two hashes of all its columns, so
rows that agree in all of them stay or go together (but of near duplicates one
row stays).  Texts may have any length; extra columns may have any name, but
those of ``_KEY``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.blocks import forget, kept, kept_so_far
from evidentia.llm.decontamination import find_contamination
from evidentia.llm.line_dedup import line_dedup
from evidentia.llm.mixing import in_training_order, mix_sources
from evidentia.llm.ngram_jaccard import ngram_jaccard
from evidentia.llm.quality_rules import quality_rules

_KEY = "__row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    return docs.withColumn(_KEY, F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go; so do null, empty and blank texts."""
    keyed = _keyed(docs)
    rejected = quality_rules(keyed, id_col=_KEY).where("not kept").select(_KEY).distinct()
    return keyed.join(rejected, _KEY, "left_anti").drop(_KEY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier line go, copies of lines of every length; a document goes if nothing but white space is left of it.

    A document that loses nothing stays as it is, a null text null.  ``n_chars``
    follows the text.  Rows with one id, and all without one, share a place in
    the order of documents: equal lines at equal places of theirs both stay.
    """
    cut = line_dedup(docs, carry="row", whole=True).where("n_removed = 0 or kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    own = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return cut.select([own[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays, that with the smallest id, rows without an id last; ties by hash.

    Texts without words are near nothing and stay.
    """
    keyed = _keyed(docs)
    found = ngram_jaccard(keyed, carry=_KEY).where("n_shingles > 0")
    rows = kept(found.groupBy("component_key", _KEY).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("place"), F.count(F.lit(1)).alias("times")))
    first = rows.groupBy("component_key").agg(F.min(F.struct("place", _KEY)).alias("first"))
    judged = rows.join(first, "component_key").select(_KEY, "times", (F.struct("place", _KEY) == F.col("first")).alias("stays"))
    judged = kept(judged.where("not stays or times > 1"))
    left = keyed.join(judged.select(_KEY), _KEY, "left_anti")
    repeated = judged.where("stays").select(_KEY)
    if not repeated.isEmpty():
        left = left.union(keyed.join(repeated, _KEY, "left_semi").dropDuplicates([_KEY]))
    return left.drop(_KEY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that holds a benchmark item go.  Texts are known by a hash, so equal ones go together; null and empty ones stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn(_KEY, F.xxhash64("text"))
    found = find_contamination(keyed, items, id_col=_KEY).select(_KEY).distinct()
    return keyed.join(found, _KEY, "left_anti").drop(_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many words it takes of each, a row for each use in the order of the training.

    Texts without words are not taken; a null source is a source.  Rows with one
    id, or none, are taken each for itself.
    """
    mixed = mix_sources(docs, carry=[c for c in ("text", "lang", "source") if c in docs.columns]).where("taken > 0")
    return in_training_order(mixed).select("doc_id", "carried.*", "size", "source_size", "target", "taken", "pass", "used", "position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The outlier test and the edit join can't be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = kept_so_far()
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
        forget(spark, before, 1)
    return docs
