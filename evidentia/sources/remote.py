"""Search and download of articles through a transport that the caller gives.

A transport is a function that a task can call; tests give one that answers
from memory.  A task waits between calls so that all tasks together stay
within the rate.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .jats import first_id, split_set
from .sinks import append_raw

PAGE, BATCH, RATE, TRIES, WAIT = 500, 50, 10.0, 3, 2.0


def patiently(call: Callable, *args, tries: int = TRIES, wait: float = WAIT):
    """The call's answer, after at most ``tries`` tries with waits that double; None if all fail."""
    for k in range(tries):
        try:
            return call(*args)
        except Exception:  # noqa: BLE001 - a transport may fail in any way
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return None


def search_ids(spark: SparkSession, total: int, page_of: Callable[[int, int], list[str] | None], *, page: int = PAGE, tasks: int = 0, rate: float = RATE, wait: float = WAIT) -> DataFrame:
    """Ids of a search with ``total`` hits; a page that fails every time is left out.  ``literature`` keeps such pages for another run."""
    tasks = max(1, min(tasks or spark.sparkContext.defaultParallelism, -(-total // page)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in batch["start"]:
                time.sleep(tasks / rate)
                yield pd.DataFrame({"pmcid": pd.Series(patiently(page_of, int(start), page, wait=wait) or [], dtype=str)})

    return spark.range(0, total, page, tasks).withColumnRenamed("id", "start").mapInPandas(read, "pmcid string")


def search(spark: SparkSession, count: Callable[[], int], page_of: Callable[[int, int], list[str] | None], **how) -> DataFrame:
    """Ids of a search: its number of hits is asked for first, then its pages.  A count that can't be had is an error."""
    total = patiently(count, wait=how.get("wait", WAIT))
    if total is None:
        raise ConnectionError("the number of hits can't be had")
    return search_ids(spark, int(total), page_of, **how)


def download(ids: DataFrame, fetch: Callable[[list[str]], str], raw: str, *, limit: int = 0, **how) -> DataFrame:
    """Fetch the articles that the raw table in ``raw`` lacks, at most ``limit`` (0: all) by id, add them, and return the ids still missing.

    The raw table is the ledger: a download that broke off goes on where it was.
    """
    wanted = ids.select("pmcid").distinct()
    left = missing(wanted, fetched(ids.sparkSession, raw))
    got = fetch_articles(left.orderBy("pmcid").limit(limit) if limit else left, fetch, **how)
    append_raw(got, raw)
    return missing(wanted, fetched(ids.sparkSession, raw))


def fetched(spark: SparkSession, raw: str) -> DataFrame:
    """Ids of the raw table; none where it isn't there yet."""
    try:
        return spark.read.schema("pmcid string, xml string").parquet(raw).select("pmcid")
    except AnalysisException:
        return spark.createDataFrame([], "pmcid string")


def fetch_articles(ids: DataFrame, fetch: Callable[[list[str]], str], *, batch: int = BATCH, tasks: int = 0, rate: float = RATE, wait: float = WAIT) -> DataFrame:
    """``pmcid``, ``xml`` of the articles that the transport returns for batches of ids.

    Batches are asked for in ``tasks`` tasks at once (0: as many as the session
    has cores), which share the rate.
    """
    tasks = tasks or ids.sparkSession.sparkContext.defaultParallelism

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wanted = frame["pmcid"].tolist()
            for at in range(0, len(wanted), batch):
                time.sleep(tasks / rate)
                got = split_set(patiently(fetch, wanted[at : at + batch], wait=wait))
                yield pd.DataFrame({"pmcid": [first_id(x) for x in got], "xml": got}, dtype=object)

    return ids.select("pmcid").repartition(tasks).mapInPandas(read, "pmcid string, xml string").where(F.col("pmcid").isNotNull())


def missing(ids: DataFrame, fetched: DataFrame) -> DataFrame:
    """Ids that were asked for and not returned."""
    return ids.select("pmcid").distinct().join(fetched.select("pmcid"), "pmcid", "left_anti")
