"""A star that is kept in a folder, and loaded into again and again, by any number of writers.

``data/<load>/<table>`` holds the rows that one load added, ``commits/<version>``
names all folders that make up the star of a version.  A load writes only what
the star lacks: new rows of the dimensions, new entries, new pairs of a marker
and a paper, and by how much these pairs raise the citation counts of their
markers.  So what is written grows with what is new; the old rows are read for
their keys, and readers of a version keep what they read.

A version is made by creating its file, which only one writer can.  A writer
that comes second takes from its rows what the versions since have added, which
needs no look at the rest of the star, and tries for the next version.  What a
load that broke off has written is in no version; ``expire`` deletes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.load import different, judged, keyed_entries, not_in, rows_of
from ..sources.atomic import age_hours, create_once, delete, names_in, read_text
from .star import Star

TABLES = ("entries", "markers", "cell_types", "cell_subtypes", "tissues", "diseases", "papers")
#: Pairs of a marker and a paper, and numbers that are added to citation counts.
STORED = (*TABLES, "citations", "counts")
_COUNTS = StructType([StructField("id", LongType()), StructField("citation_count", LongType())])


@dataclass(frozen=True)
class Version:
    """What a star consists of: folders and schema of each table, and the last batch of each stream that is in it."""

    version: int = 0
    saved_at: str = ""
    folders: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def more(self, made: dict[str, tuple[str, StructType]], batch: tuple[str, int] | None = None) -> Version:
        """The next version with folders added."""
        folders, schemas = {t: list(x) for t, x in self.folders.items()}, dict(self.schemas)
        for t, (folder, schema) in made.items():
            folders.setdefault(t, []).append(folder)
            known = StructType.fromJson(schemas[t]).fields if t in schemas else []
            schemas[t] = StructType(known + [f for f in schema.fields if f.name not in {k.name for k in known}]).jsonValue()
        return Version(self.version + 1, _now(), folders, schemas, self.batches | ({batch[0]: batch[1]} if batch else {}))

    def since(self, old: Version) -> Version:
        """Only the folders that another version lacks."""
        left = {t: [x for x in paths if x not in set(old.folders.get(t, ()))] for t, paths in self.folders.items()}
        return replace(self, folders={t: paths for t, paths in left.items() if paths})


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _commit(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/commits/{version:012d}.json"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return [int(n[:-5]) for n in names_in(spark, f"{folder.rstrip('/')}/commits") if n[:-5].isdigit() and n.endswith(".json")]


def version_of(spark: SparkSession, folder: str, version: int | None = None) -> Version:
    """A version, the last without a number; number 0, without tables, where nothing is saved yet."""
    number = version or max(_numbers(spark, folder), default=0)
    return Version(**json.loads(read_text(spark, _commit(folder, number)))) if number else Version()


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """``version``, ``saved_at`` of all versions; no row where nothing is saved yet."""
    rows = [(n, version_of(spark, folder, n).saved_at) for n in _numbers(spark, folder)]
    return spark.createDataFrame(rows, "version long, saved_at string").withColumn("saved_at", F.to_timestamp("saved_at"))


def _publish(spark: SparkSession, folder: str, version: Version) -> bool:
    return create_once(spark, _commit(folder, version.version), json.dumps(version.__dict__))


def _table(spark: SparkSession, folder: str, version: Version, name: str) -> DataFrame | None:
    paths = [f"{folder.rstrip('/')}/data/{x}" for x in version.folders.get(name, ())]
    return spark.read.schema(StructType.fromJson(version.schemas[name])).parquet(*paths) if paths else None


def _write(rows: dict[str, DataFrame], folder: str, load: str) -> dict[str, tuple[str, StructType]]:
    """Write tables, and name the folders of those that have rows."""
    made = {}
    for name, df in rows.items():
        n = Observation()
        df.observe(n, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder.rstrip('/')}/data/{load}/{name}")
        if n.get["rows"]:
            made[name] = (f"{load}/{name}", df.schema)
    return made


def _read(spark: SparkSession, folder: str, made: dict[str, tuple[str, StructType]]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/data/{path}") for name, (path, schema) in made.items()}


def _raised(citations: DataFrame) -> DataFrame:
    """By how much new pairs raise the counts of their markers."""
    return citations.groupBy(F.col("marker_id").alias("id")).agg(F.count(F.lit(1)).alias("citation_count"))


def star_of(spark: SparkSession, folder: str, version: Version) -> Star:
    """The star of a version; a table without rows is empty."""
    tables = {name: _table(spark, folder, version, name) for name in (*TABLES, "counts")}
    empty = _empty(spark)
    tables = {name: empty[name] if df is None else df for name, df in tables.items()}
    counts = tables.pop("counts").groupBy("id").agg(F.sum("citation_count").alias("citation_count"))
    markers = tables["markers"].join(counts, "id", "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))
    return Star(**{**tables, "markers": markers})


def _empty(spark: SparkSession) -> dict[str, DataFrame]:
    none = spark.createDataFrame([], "pmcid string, cell_type string, cell_subtype string, marker string, tissue string, disease string")
    rows = rows_of(keyed_entries(different(none)), spark.createDataFrame([], "pmcid string, pmid string, title string"))
    return {name: spark.createDataFrame([], df.schema) for name, df in rows.items()} | {"counts": spark.createDataFrame([], _COUNTS)}


def read_star(spark: SparkSession, folder: str, version: int | None = None) -> Star | None:
    """The star of a version, the last without one; None if there is none."""
    numbers = _numbers(spark, folder)
    if (version or max(numbers, default=0)) not in numbers:
        return None
    return star_of(spark, folder, version_of(spark, folder, version))


def _publish_rows(spark: SparkSession, folder: str, base: Version, rows: dict[str, DataFrame], batch: tuple[str, int] | None, tries: int, between: Callable[[int], None] | None) -> int:
    """Write what ``base`` lacks of the rows, and make it part of the next version that nobody else makes."""
    seen = base
    for k in range(tries):
        added = seen if k == 0 else base.since(seen)
        left = {}
        for name, df in rows.items():
            old = _table(spark, folder, added, name)
            left[name] = df if old is None else not_in(name, df, old)
        load = uuid.uuid4().hex
        made = _write(left, folder, load)
        rows = _read(spark, folder, made)
        if "citations" in made:
            made |= _write({"counts": _raised(rows["citations"])}, folder, load)
        if between:
            between(k)
        if _publish(spark, folder, base.more(made, batch)):
            return base.version + 1
        seen, base = base, version_of(spark, folder)
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base.version
    raise TimeoutError(f"other writers were first {tries} times")


def save_star(star: Star, folder: str, tries: int = 20) -> int:
    """Write a whole star as the folder's next version, in the place of what was there."""
    spark = star.entries.sparkSession
    rows = {name: getattr(star, name) for name in TABLES}
    rows |= {"markers": star.markers.drop("citation_count"), "citations": star.entries.select("marker_id", "paper_id").distinct(), "counts": star.markers.select("id", F.col("citation_count").cast("long").alias("citation_count"))}
    made = _write(rows, folder, uuid.uuid4().hex)
    for _ in range(tries):
        last = version_of(spark, folder)
        if _publish(spark, folder, Version(last.version, batches=last.batches).more(made)):
            return last.version + 1
    raise TimeoutError(f"other writers were first {tries} times")


def add_to_star(entries: DataFrame, papers: DataFrame, folder: str, *, batch: tuple[str, int] | None = None, tries: int = 20, between: Callable[[int], None] | None = None) -> int:
    """Load entries into the folder's star; the number of the version that has them.

    Loading the same again adds nothing (and makes a version that says so).
    Entries that can't be loaded (without paper, cell type or marker) go to
    ``quarantine``, with the reason.  ``batch``: the name of a stream and the
    number of its batch; a batch that the star has, or a later one, is not
    loaded again.  ``between`` is called before each try to make a version.
    """
    spark, folder = entries.sparkSession, folder.rstrip("/")
    base = version_of(spark, folder)
    if batch and base.batches.get(batch[0], -1) >= batch[1]:
        return base.version
    load = f"{batch[0]}-{batch[1]}" if batch else uuid.uuid4().hex
    staged = f"{folder}/staged/{load}"
    read = judged(entries)
    read.write.mode("overwrite").parquet(f"{staged}/read")  # so that tables and quarantine read the input once
    read = spark.read.schema(read.schema).parquet(f"{staged}/read")
    bad = read.where("reason is not null")
    if not bad.isEmpty():
        bad.withColumn("set_aside_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/quarantine/load={load}")
    fit = different(read)
    fit.write.mode("overwrite").parquet(f"{staged}/different")  # which all tables are made of
    rows = rows_of(keyed_entries(spark.read.schema(fit.schema).parquet(f"{staged}/different")), papers)
    version = _publish_rows(spark, folder, base, rows, batch, tries, between)
    delete(spark, staged)
    return version


def compact(spark: SparkSession, folder: str, tries: int = 20) -> int:
    """Write the rows of all loads as one folder a table, entries by marker, and make it the next version.

    Loads that are made meanwhile are added as they are.  Old versions stay
    readable until they expire.
    """
    base = version_of(spark, folder)
    rows = {name: df for name in STORED if (df := _table(spark, folder, base, name)) is not None}
    if "counts" in rows:
        rows["counts"] = rows["counts"].groupBy("id").agg(F.sum("citation_count").alias("citation_count"))
    if "entries" in rows:
        rows["entries"] = rows["entries"].repartitionByRange("marker_id").sortWithinPartitions("marker_id")
    made = _write(rows, folder, uuid.uuid4().hex)
    for _ in range(tries):
        last = version_of(spark, folder)
        new = last.since(base)
        whole = replace(Version(last.version, batches=last.batches).more(made), schemas=last.schemas)
        for name, paths in new.folders.items():
            whole.folders.setdefault(name, []).extend(paths)
        if _publish(spark, folder, whole):
            return whole.version
    raise TimeoutError(f"other writers were first {tries} times")


def expire(spark: SparkSession, folder: str, keep: int = 1, hours: float = 24.0) -> int:
    """Delete all but the last ``keep`` versions, and loads that no version left names and that are older than ``hours``; the number of loads deleted."""
    folder, numbers = folder.rstrip("/"), _numbers(spark, folder)
    last = numbers[-max(keep, 1) :]
    used = reduce(set.union, ({x.partition("/")[0] for paths in version_of(spark, folder, n).folders.values() for x in paths} for n in last), set())
    for n in numbers[: len(numbers) - len(last)]:
        delete(spark, _commit(folder, n))
    gone = [f"{folder}/{part}/{x}" for part in ("data", "staged") for x in names_in(spark, f"{folder}/{part}") if x not in used]
    gone = [x for x in gone if age_hours(spark, x) >= hours]
    for x in gone:
        delete(spark, x)
    return len(gone)
