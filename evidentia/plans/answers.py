"""Answers about a stored star that are kept until the star changes or they are too old.

An answer is a table in ``answers/<version>``, filed under the question's name
and the key of what was asked, with a note of its schema and when it was made.
The note is written last, so that a table that broke off is no answer.  A kept
answer is found, and its plan made, without a job.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..config import Settings
from ..sources.atomic import create_once, delete, names_in, read_text
from .responses import initial_response, search_response
from .star import Filters, Star
from .store import read_star, version_of

#: Seconds for which an answer is taken without being made anew.
TIME_TO_LIVE = 300.0


def question_key(asked: Mapping[str, Any]) -> str:
    """The key of what was asked: the order of its names doesn't matter, that of their values does; what is empty isn't asked."""
    given = [{"key": k, "value": v} for k, v in sorted(asked.items()) if v not in (None, "", [], ())]
    return hashlib.md5(json.dumps(given, separators=(",", ":"), ensure_ascii=False, default=list).encode()).hexdigest()


def answered(spark: SparkSession, folder: str, name: str, asked: Mapping[str, Any], question: Callable[[Star], DataFrame], *, seconds: float = TIME_TO_LIVE, now: Callable[[], float] = time.time) -> DataFrame:
    """The answer to a question about the last star in a folder, made only if there is none of this version that is young enough.

    Of two that make one answer at a time the first that is done is kept.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a name of letters, digits and underscores is needed")
    folder = folder.rstrip("/")
    version = version_of(spark, folder).version
    at = f"{folder}/answers/{version:012d}/{name}-{question_key(asked)}"
    notes = [n for n in names_in(spark, at) if n.endswith(".json") and not n.startswith((".", "_"))]
    if notes:
        kept = json.loads(read_text(spark, f"{at}/{notes[-1]}"))
        if now() - kept["made_at"] < seconds:
            return spark.read.schema(StructType.fromJson(kept["schema"])).parquet(f"{at}/{kept['table']}")
    star = read_star(spark, folder, version or None)
    if star is None:
        raise FileNotFoundError(f"no star in {folder}")
    answer, table = question(star), uuid.uuid4().hex
    answer.write.parquet(f"{at}/{table}")
    note = {"made_at": now(), "schema": answer.schema.jsonValue(), "table": table}
    number = int(notes[-1].removesuffix(".json")) + 1 if notes else 1
    if not create_once(spark, f"{at}/{number:06d}.json", json.dumps(note)):
        delete(spark, f"{at}/{table}")
        note = json.loads(read_text(spark, f"{at}/{number:06d}.json"))
    return spark.read.schema(answer.schema).parquet(f"{at}/{note['table']}")


def forget_old(spark: SparkSession, folder: str) -> int:
    """Delete the answers about all versions but the last; how many versions these were."""
    folder = folder.rstrip("/")
    last = f"{version_of(spark, folder).version:012d}"
    old = [n for n in names_in(spark, f"{folder}/answers") if n < last]
    for n in old:
        delete(spark, f"{folder}/answers/{n}")
    return len(old)


def search_answer(spark: SparkSession, folder: str, filters: Filters = Filters(), page: int = 1, page_size: int = 0, settings: Settings = Settings(), **how) -> DataFrame:
    """``search_response`` by the settings' sizes of pages, kept."""
    size = page_size or settings.page_size
    if not 1 <= size <= settings.most_per_page:
        raise ValueError(f"page_size must be from 1 to {settings.most_per_page}")
    asked = {**filters.__dict__, "page": page, "page_size": size}
    return answered(spark, folder, "search", asked, lambda star: search_response(star, filters, page, size), **how)


def initial_answer(spark: SparkSession, folder: str, **how) -> DataFrame:
    return answered(spark, folder, "initial", {}, initial_response, **how)


def export_answer(spark: SparkSession, folder: str, filters: Filters = Filters(), settings: Settings = Settings(), **how) -> DataFrame:
    """The rows of an export, at most the settings' cap, kept."""
    return answered(spark, folder, "export", {**filters.__dict__, "cap": settings.export_cap}, lambda star: star.export(filters, settings.export_cap), **how)
