"""Search and download of articles as a partitioned data source.

    spark.dataSource.register(LiteratureArticles)
    spark.read.format("literature_articles").options(transport="mine:transport", term="…", partitions=8).load()

A partition is a run of pages of the search, so that pages are asked for in
parallel and a lost task asks again for its own pages only.  A page is asked for
``tries`` times with waits that double; what can't be had is a row with the
error, and the other pages go on (``strict``: it fails the task, which Spark
tries again).  All tasks together stay within ``rate`` requests a second: each
waits ``slots / rate`` between two of its own, where ``slots`` is how many run at
once.

``harvest`` keeps the rows in a folder, whose page rows are the ledger: a second
call asks only for pages that have no answer yet.

A transport has ``count(term)``, ``page(term, start, size)`` (ids, or None where
the answer lacks them) and ``fetch(ids)`` (a set of articles).  ``HttpTransport``
speaks the public E-utilities' protocol.
"""

from __future__ import annotations

import base64
import importlib
import json
import pickle
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

from ..config import Settings
from .jats import first_id, split_set

IDS = "page long, total long, pmcid string, error string"
ARTICLES = f"{IDS}, xml string"
#: What is said of an id that was asked for and isn't in the answer.
MISSING = "not in the answer"


class Transport(Protocol):
    def count(self, term: str) -> int: ...

    def page(self, term: str, start: int, size: int) -> list[str] | None: ...

    def fetch(self, ids: list[str]) -> str: ...


class HttpTransport:
    """Requests to a server with the E-utilities' search and fetch.  The search is kept by the server, and its handle goes to the tasks."""

    def __init__(self, base: str, db: str = "pmc", key: str = "", timeout: float = 120.0):
        self.base, self.timeout = base.rstrip("/"), timeout
        self.always = {"db": db, **({"api_key": key} if key else {})}
        self.history: dict[str, str] = {}

    def _get(self, name: str, **asked: Any) -> str:
        with urllib.request.urlopen(f"{self.base}/{name}?{urllib.parse.urlencode({**self.always, **asked})}", timeout=self.timeout) as answer:
            return answer.read().decode("utf-8", "replace")

    def _search(self, **asked: Any) -> dict:
        return json.loads(self._get("esearch.fcgi", retmode="json", **asked), strict=False).get("esearchresult", {})

    # The protocol's names of parameters and fields.
    def count(self, term: str) -> int:
        found = self._search(term=term, retmax=0, usehistory="y")
        self.history = {"WebEnv": found["webenv"], "query_key": found["querykey"]}
        return int(found["count"])

    def page(self, term: str, start: int, size: int) -> list[str] | None:
        return self._search(**(self.history or {"term": term}), retstart=start, retmax=size).get("idlist")

    def fetch(self, ids: list[str]) -> str:
        return self._get("efetch.fcgi", id=",".join(ids), retmode="xml")


def as_option(transport: Transport) -> str:
    """A transport as the text of an option."""
    return "pickle:" + base64.b64encode(cloudpickle.dumps(transport)).decode()


def _transport(option: str) -> Transport:
    """The transport that an option holds, or names as ``module:attribute``; a class is called."""
    if option.startswith("pickle:"):
        return pickle.loads(base64.b64decode(option[7:]))
    module, _, name = option.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found() if isinstance(found, type) else found


def pages_of(text: str) -> list[range]:
    """Runs of pages out of a text like ``0-7,9``."""
    ends = [part.partition("-") for part in text.split(",") if part]
    return [range(int(a), int(b or a) + 1) for a, _, b in ends]


def text_of(pages: Iterator[int]) -> str:
    """The reverse, of pages in rising order; holds runs, not pages."""
    runs: list[list[int]] = []
    for p in pages:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return ",".join(f"{a}-{b}" if b > a else str(a) for a, b in runs)


@dataclass
class Pages(InputPartition):
    """Pages of a search with so many hits; the transport that counted them may hold the search's handle."""

    runs: list[range]
    total: int
    transport: Transport


def shared_out(runs: list[range], parts: int) -> list[list[range]]:
    """Runs of pages in parts of as many pages, or one less."""
    total = sum(map(len, runs))
    parts = max(1, min(parts, total))
    out, at, k = [[] for _ in range(parts)], 0, 0
    for run in runs:
        while len(run):
            end = total * (k + 1) // parts
            take = min(len(run), end - at)
            if take:
                out[k].append(run[:take])
            run, at = run[take:], at + take
            if at == end:
                k += 1
    return [x for x in out if x]


class _Pace:
    """At least so many seconds between two requests, and tries with waits that double."""

    def __init__(self, seconds: float, tries: int, wait: float):
        self.seconds, self.tries, self.wait, self.next = seconds, tries, wait, 0.0

    def ask(self, call: Callable, *args) -> tuple[Any, str | None]:
        """The answer, or what went wrong the last time.  None is no answer."""
        error = None
        for k in range(self.tries):
            time.sleep(max(0.0, self.next - time.monotonic()))
            self.next = time.monotonic() + self.seconds
            try:
                got = call(*args)
                if got is not None:
                    return got, None
                error = "an answer without ids"
            except Exception as e:  # noqa: BLE001 - a transport may fail in any way
                error = f"{type(e).__name__}: {e}"
            if k + 1 < self.tries:
                time.sleep(self.wait * 2**k)
        return None, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], articles: bool):
        own = Settings()
        text = lambda name, default: options.get(name, str(default))
        self.transport, self.term, self.articles = _transport(options["transport"]), text("term", own.search_term), articles
        self.size, self.batch = int(text("page", own.page)), int(text("batch", own.batch))
        self.parts = int(text("partitions", 8))
        self.slots, self.rate = int(text("slots", self.parts)), float(text("rate", own.rate))
        self.tries, self.wait, self.strict = int(text("tries", own.tries)), float(text("wait", own.wait)), text("strict", False).lower() == "true"
        self.pages, self.total = options.get("pages"), int(text("total", -1))

    def _pace(self, seconds: float) -> _Pace:
        return _Pace(seconds, self.tries, self.wait)

    def partitions(self) -> list[Pages]:
        if self.total < 0:
            self.total, error = self._pace(1 / self.rate).ask(self.transport.count, self.term)
            if error:
                raise ConnectionError(f"the number of hits can't be had: {error}")
        whole = [range(-(-self.total // self.size))]
        runs = whole if self.pages is None else pages_of(self.pages)
        return [Pages(x, self.total, self.transport) for x in shared_out(runs, self.parts)]

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        pace = self._pace(self.slots / self.rate)
        for run in partition.runs if partition else ():
            for page in run:
                yield self._page(page, partition.total, partition.transport, pace)

    def _page(self, page: int, total: int, transport: Transport, pace: _Pace) -> pa.RecordBatch:
        start = page * self.size
        ids, error = pace.ask(transport.page, self.term, start, min(self.size, total - start))
        rows: list[tuple[str, str | None, str | None]] = [(i, None, None) for i in ids or ()]
        if ids and self.articles:
            rows = []
            for a in range(0, len(ids), self.batch):
                wanted = ids[a : a + self.batch]
                answer, wrong = pace.ask(transport.fetch, wanted)
                error = wrong or error
                got = {first_id(x): x for x in split_set(answer)} if answer else {}
                rows += [(i, None if i in got else wrong or MISSING, got.get(i)) for i in wanted]
        if error and self.strict:
            raise ConnectionError(f"page {page}: {error}")
        rows.append((None, error, None))
        columns = [pa.array([page] * len(rows)), pa.array([total] * len(rows)), *[pa.array([r[k] for r in rows], pa.string()) for k in range(3)]]
        names = ["page", "total", "pmcid", "error", "xml"]
        n = 5 if self.articles else 4
        return pa.RecordBatch.from_arrays(columns[:n], names[:n])


class LiteratureIds(DataSource):
    """``page``, ``total`` (hits), ``pmcid``, ``error``: a row for each id, and one without id for each page, which says whether it was answered."""

    @classmethod
    def name(cls) -> str:
        return "literature_ids"

    def schema(self) -> str:
        return IDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, articles=False)


class LiteratureArticles(DataSource):
    """The same with ``xml``.  An id without article has an ``error``; a page has one if one of its requests failed."""

    @classmethod
    def name(cls) -> str:
        return "literature_articles"

    def schema(self) -> str:
        return ARTICLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, articles=True)


def harvested(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a folder; none where there is nothing yet."""
    try:
        return spark.read.schema(ARTICLES).parquet(f"{folder.rstrip('/')}/pages")
    except AnalysisException:
        return spark.createDataFrame([], ARTICLES)


def ids_of(rows: DataFrame) -> DataFrame:
    return rows.where("pmcid is not null").select("pmcid").distinct()


def articles_of(rows: DataFrame) -> DataFrame:
    """``pmcid``, ``xml`` of each article once, also where a page was asked for again."""
    return rows.where("xml is not null").groupBy("pmcid").agg(F.any_value("xml").alias("xml"))


def harvest(spark: SparkSession, folder: str, transport: Transport, settings: Settings = Settings(), *, articles: bool = True, partitions: int = 0) -> DataFrame:
    """Ask for the pages of a search that a folder lacks, add their rows, and return the pages that are still without an answer (``page``, ``error``).

    If the number of hits isn't that of an earlier call, pages hold other ids
    now, and all are asked for; articles that are there once stay once.
    ``settings.batch_limit``: at most so many hits.
    """
    folder = folder.rstrip("/")
    total, error = _Pace(0, settings.tries, settings.wait).ask(transport.count, settings.search_term)
    if error:
        raise ConnectionError(f"the number of hits can't be had: {error}")
    total = min(total, settings.batch_limit) if settings.batch_limit else total
    known = lambda: harvested(spark, folder).where((F.col("total") == total) & F.col("pmcid").isNull())
    every = spark.range(-(-total // settings.page)).withColumnRenamed("id", "page")
    left = every.join(known().where("error is null").select("page"), "page", "left_anti")
    pages = text_of(r["page"] for r in left.orderBy("page").toLocalIterator())
    if pages:
        slots = spark.sparkContext.defaultParallelism
        kind = LiteratureArticles if articles else LiteratureIds
        spark.dataSource.register(kind)
        asked = {"transport": as_option(transport), "term": settings.search_term, "total": total, "pages": pages, "page": settings.page, "batch": settings.batch, "rate": settings.rate, "tries": settings.tries, "wait": settings.wait, "partitions": partitions or 4 * slots, "slots": min(slots, partitions or slots)}
        rows = spark.read.format(kind.name()).options(**asked).load()
        rows.select("*", *([] if articles else [F.lit(None).cast("string").alias("xml")])).write.mode("append").parquet(f"{folder}/pages")
    last = known().groupBy("page").agg(F.bool_or(F.col("error").isNull()).alias("answered"), F.max("error").alias("error"))
    return last.where("not answered").select("page", "error")
