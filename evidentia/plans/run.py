"""A whole run by its settings: harvest, parse, ask, validate, load.

Every stage has a dataset of its own in the settings' folder and takes what it
lacks from the one before, so that a run that broke off, or one with new
articles, does only what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..config import Settings
from ..functions.vocabulary import DEFAULT, Vocabulary
from ..operators.entries import sampled
from ..operators.extraction import ask, extracted, validation_run
from ..schema import PROCESSED, USAGE
from ..sources.jats import parse_articles
from ..sources.literature import Transport, articles_of, harvest, harvested
from .build import standard_entries
from .store import add_to_star

STAGES = ("harvest", "parse", "ask", "validate", "load")
_REPLIES = StructType().add("pmcid", "string").add("pmid", "string").add("title", "string").add("reply", "string").add("usage", USAGE).add("model", "string")
Model = Callable[[str], tuple[str, dict]]


def _dataset(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, settings: Settings, *, transport: Transport | None = None, model: Model | None = None, validator: Model | None = None, nomenclature: DataFrame | None = None, vocabulary: Vocabulary = DEFAULT, stages: Sequence[str] = STAGES) -> dict[str, int]:
    """Do the named stages, those without what they need left out; numbers of what each has left or has done.

    ``harvest`` needs a transport, ``ask`` a model, ``validate`` a validator and
    ``load`` the nomenclature.  Papers without a reply stay for another run; a
    paper that was loaded is not loaded again.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    at = lambda name: f"{settings.folder.rstrip('/')}/{name}"
    processed = lambda: _dataset(spark, at("processed"), PROCESSED)
    replies = lambda: _dataset(spark, at("replies"), _REPLIES)
    done: dict[str, int] = {}
    if "harvest" in stages and transport:
        done["unanswered_pages"] = harvest(spark, at("raw"), transport, settings).count()
    if "parse" in stages:
        new = articles_of(harvested(spark, at("raw"))).join(processed().select("pmcid"), "pmcid", "left_anti")
        parsed = parse_articles(new, text_tokens=settings.text_tokens, table_rows=settings.table_rows).where("pmcid is not null")
        parsed.select(PROCESSED.names).write.mode("append").parquet(at("processed"))
        done["processed"] = processed().count()
    if "ask" in stages and model:
        left = processed().join(replies().where("reply is not null").select("pmcid"), "pmcid", "left_anti")
        asked = ask(left, model, name=settings.model, at_once=settings.at_once, tries=settings.tries, wait=settings.wait)
        asked.write.mode("append").parquet(at("replies"))
        done["answered"] = replies().where("reply is not null").count()
    if "validate" in stages and validator:
        some = sampled(processed(), "pmcid", settings.sample_share)
        done |= {f"validation_{k}": n for k, n in validation_run(some, validator, at("validation"), name=settings.validation_model, wait=settings.wait).items()}
    if "load" in stages and nomenclature is not None:
        documents = extracted(replies().where("reply is not null"))
        entries = standard_entries(documents, nomenclature, vocabulary, settings.keep_status)
        done["version"] = add_to_star(entries, documents.select("pmcid", "pmid", "title"), at("star"))
    return done
