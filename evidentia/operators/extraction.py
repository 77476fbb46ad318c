"""Entries from texts by a model that the caller gives.

A model is a function from a prompt to (reply, token usage), called inside the
tasks, several calls at a time; a reply that can't be had after ``tries`` tries
is null.  Write what it returns before going on: a second evaluation would call
the model again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.documents import prompt
from ..session import scratch
from ..sources.sinks import write_stage
from .entries import gathered, parsed, unreadable

AT_ONCE, TRIES, WAIT = 5, 3, 2.0


def ask(documents: DataFrame, model: Callable[[str], tuple[str, dict]], *, name: str = "model", at_once: int = AT_ONCE, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """``pmcid, pmid, title, reply, usage, model`` for each document."""

    def one(text: str) -> tuple[str | None, dict]:
        for k in range(tries):
            try:
                return model(text)
            except Exception:  # noqa: BLE001 - a model may fail in any way
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None, {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                got = list(pool.map(one, batch["prompt"]))
                usage = [{k: int(u.get(k, 0)) for k in ("prompt_tokens", "completion_tokens", "total_tokens")} for _, u in got]
                yield batch[["pmcid", "pmid", "title"]].assign(reply=[r for r, _ in got], usage=usage)

    asked = documents.select("pmcid", "pmid", "title", prompt(F.col("pmid"), F.col("title"), F.col("clean_text")).alias("prompt"))
    out = "pmcid string, pmid string, title string, reply string, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"
    return asked.mapInPandas(run, out).withColumn("model", F.lit(name))


def extracted(replies: DataFrame) -> DataFrame:
    """Documents with their valid entries out of replies; papers without a reply stay out, for another run."""
    answered = replies.where("reply is not null")
    raw = F.size(F.from_json("reply", "markers array<string>")["markers"])
    entries = gathered(parsed(answered))
    none = F.array().cast("array<struct<cell_type:string,cell_subtype:string,marker:string,tissue:string,disease:string>>")
    docs = answered.withColumn("raw_marker_count", F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0))).join(entries, "pmcid", "left").withColumn("markers", F.coalesce("markers", none))
    return docs.select("pmcid", "pmid", "title", "markers", "raw_marker_count", F.size("markers").alias("valid_marker_count"), "model", "usage", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"))


def validation_run(documents: DataFrame, model: Callable[[str], tuple[str, dict]], folder: str, *, name: str = "model", wait: float = WAIT) -> dict[str, int]:
    """Ask the model about the documents that ``folder`` has no reply for yet, and write its replies and its failures.

    A run that broke off, or had failures, goes on with what is left; a document
    that is answered now is no failure any more.  Returns numbers of documents
    asked, answered and failed.
    """
    spark, folder = documents.sparkSession, folder.rstrip("/")

    def known(table: str, columns: str) -> DataFrame:
        try:
            return spark.read.schema(columns).parquet(f"{folder}/{table}")
        except AnalysisException:
            return spark.createDataFrame([], columns)

    left = documents.join(pending(documents, known("replies", "pmcid string")), "pmcid", "left_semi")
    asked = write_stage(ask(left, model, name=name, wait=wait), scratch(spark), "asked")
    bad = unreadable(asked).select("pmcid")
    asked.join(bad, "pmcid", "left_anti").write.mode("append").parquet(f"{folder}/replies")
    bad.withColumn("failed_at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/failures")
    n, failed = asked.count(), bad.count()
    return {"asked": n, "answered": n - failed, "failed": failed}


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that failed and have no reply since, with when they failed last."""
    folder = folder.rstrip("/")
    failed = spark.read.parquet(f"{folder}/failures").groupBy("pmcid").agg(F.max("failed_at").alias("failed_at"))
    return failed.join(spark.read.parquet(f"{folder}/replies").select("pmcid"), "pmcid", "left_anti")


def pending(candidates: DataFrame, validated: DataFrame) -> DataFrame:
    """Papers that still have to be validated."""
    return candidates.select("pmcid").distinct().join(validated.select("pmcid"), "pmcid", "left_anti")
