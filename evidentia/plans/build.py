"""From articles to the star, as one composition of the stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalized
from ..functions.vocabulary import DEFAULT, Vocabulary
from ..operators.entries import exploded, first_entries
from ..operators.extraction import ask, extracted
from ..operators.genes import standardized
from ..operators.hierarchy import resolved
from ..operators.load import load
from ..sources.jats import parse_articles
from ..sources.sinks import write_stage
from .star import Star


def standard_entries(documents: DataFrame, nomenclature: DataFrame, vocabulary: Vocabulary = DEFAULT, keep_status: bool = True) -> DataFrame:
    """Entries of extracted documents after gene symbols, first-wins dedup, names and hierarchy.

    Repeats are removed within a paper before names are standardised.  Without
    ``keep_status`` the status of symbols is dropped, and all count as approved.
    """
    genes = standardized(exploded(documents), nomenclature)
    entries = resolved(normalized(first_entries(genes), vocabulary))
    return entries if keep_status else entries.drop("marker_status", "marker_original")


def build_star(raw: DataFrame, model: Callable[[str], tuple[str, dict]], nomenclature: DataFrame, folder: str, *, existing: Star | None = None, vocabulary: Vocabulary = DEFAULT, keep_status: bool = True) -> Star:
    """Parse, extract, standardise and load raw articles (``xml``); each stage is a dataset of its own in ``folder``.

    What the model said is written before anything reads it, so that no call is
    made twice.
    """
    processed = write_stage(parse_articles(raw).where(F.col("pmcid").isNotNull()), folder, "processed")
    replies = write_stage(ask(processed, model), folder, "replies")
    documents = write_stage(extracted(replies), folder, "extracted")
    entries = write_stage(standard_entries(documents, nomenclature, vocabulary, keep_status), folder, "entries")
    return load(entries, documents.select("pmcid", "pmid", "title"), existing)
