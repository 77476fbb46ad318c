"""Tables that make a star's pages and name searches cheap.

``Listing``: the entries in the order of the search, each with its place, in
files by range of that order.  A page by number reads the file (at most two) in
which its places lie, and a page after a key reads from that key on, so that
page 10,000 costs what page 1 costs.

``NameIndex``: for every three neighbouring characters the names that hold them.
A text is looked for among the names that hold all of its own; wildcards in it,
and whether the characters stand together, are verified on these.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import LISTED
from .star import FIELDS, MOST_PER_PAGE, PAGE_SIZE, Filters, Star, _within

#: Each key with its direction; the star's own order follows.
_ORDER = (("citation_count", "desc"), ("marker", "asc"), ("cell_type", "asc"))
GRAM = 3
#: A place is the number of the file, shifted by so many bits, and the row's in it.
_ROWS = 33


@dataclass(frozen=True)
class Listing:
    """Listed entries in files, with how many rows are before each file."""

    spark: SparkSession
    folder: str
    files: tuple[str, ...]
    parts: tuple[int, ...]
    before: tuple[int, ...]
    order: tuple[str, ...]
    schema: StructType

    @classmethod
    def write(cls, star: Star, folder: str, partitions: int = 0) -> Listing:
        """Sort the entries once and write them; ``folder`` must be new."""
        by = [F.desc(c) if way == "desc" else F.asc(c) for c, way in _ORDER] + [F.asc(c) for c in star.order]
        rows = star.listed(cited=True)
        ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
        ranged.sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("place")).write.parquet(f"{folder}/rows")
        own = star.entries.sparkSession.read.parquet(f"{folder}/rows")
        parts = own.select(F.shiftright("place", _ROWS).alias("part"), F.col("_metadata.file_path").alias("file")).groupBy("part", "file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
        order = F.array(*[F.lit(c) for c in star.order]).cast("array<string>")
        parts.coalesce(1).withColumn("order", order).write.parquet(f"{folder}/files")
        return cls.read(own.sparkSession, folder)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Listing:
        files = spark.read.parquet(f"{folder}/files").orderBy("part").collect()  # a row for each file
        before = tuple(accumulate((r["n"] for r in files), initial=0))
        return cls(spark, folder, tuple(r["file"] for r in files), tuple(r["part"] for r in files), before, tuple(files[0]["order"]) if files else (), spark.read.parquet(f"{folder}/rows").schema)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    @property
    def total(self) -> int:
        return self.before[-1]

    def page(self, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
        """One page of all entries, as ``Star.search`` has it."""
        size = _within(page_size, 1, MOST_PER_PAGE, "page_size")
        skip = (_within(page, 1, 1 << 40, "page") - 1) * size
        end = min(skip + size, self.total)
        own = [k for k in range(len(self.files)) if self.before[k] < end and self.before[k + 1] > skip]
        if not own:
            return self.rows.select(LISTED).limit(0)
        inside = [F.col("place").between((self.parts[k] << _ROWS) + max(0, skip - self.before[k]), (self.parts[k] << _ROWS) + min(end, self.before[k + 1]) - self.before[k] - 1) for k in own]
        found = self.spark.read.schema(self.schema).parquet(*[self.files[k] for k in own]).where(reduce(lambda x, y: x | y, inside))
        return found.orderBy("place").select(LISTED)

    def after(self, key: Row | Mapping | None, filters: Filters = Filters(), page_size: int = PAGE_SIZE) -> DataFrame:
        """The page that follows a row in the order of the search, with the columns that make its last row the next key; without a key the first."""
        size = _within(page_size, 1, MOST_PER_PAGE, "page_size")
        found = reduce(lambda d, c: d.where(c), filters.conditions().values(), self.rows)
        keys = [*_ORDER, *[(c, "asc") for c in self.order]]
        if key is not None:
            found = found.where(F.col("citation_count") <= key["citation_count"]).where(_later(keys, key))
        by = [F.desc(c) if way == "desc" else F.asc(c) for c, way in keys]
        return found.orderBy(*by).limit(size).select(*LISTED, "citation_count", *[c for c in self.order if c not in LISTED])


def _later(keys: Sequence[tuple[str, str]], key: Row | Mapping) -> Column:
    """Rows behind a key."""
    (name, way), rest = keys[0], keys[1:]
    own = F.col(name) < F.lit(key[name]) if way == "desc" else F.col(name) > F.lit(key[name])
    return own | ((F.col(name) == F.lit(key[name])) & _later(rest, key)) if rest else own


def grams_of(text: str) -> list[str] | None:
    """The trigrams that every name with a text has, in lower case; None where the text has too few characters in a row."""
    if "\\" in text:  # escapes a wildcard
        return None
    runs = text.lower().replace("_", "%").split("%")
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)}) or None


@dataclass(frozen=True)
class NameIndex:
    """Trigrams of names (``field``, ``gram``, ``id``, ``name``, and what else the dimension has), sorted by trigram."""

    rows: dict[str, DataFrame]

    @classmethod
    def write(cls, star: Star, folder: str, fields: Sequence[str] = ("marker", *FIELDS)) -> NameIndex:
        """Index the names of the dimensions; ``folder`` must be new."""
        for field in fields:
            table, label = star.dimension(field)
            low = F.lower(F.col(label))
            grams = F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))
            long = table.where(F.length(low) >= GRAM).select("*", F.explode(F.array_distinct(grams)).alias("gram"))
            long.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/{field}")
        return cls.read(star.entries.sparkSession, folder, fields)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, fields: Sequence[str] = ("marker", *FIELDS)) -> NameIndex:
        return cls({f: spark.read.parquet(f"{folder}/{f}") for f in fields})

    def candidates(self, field: str, label: str, text: str) -> DataFrame | None:
        """The dimension's rows whose names hold all trigrams of a text and match it; None where the index can't tell."""
        grams = grams_of(text)
        if not grams or field not in self.rows:
            return None
        own = self.rows[field].where(F.col("gram").isin(grams))
        if len(grams) == 1:
            found = own.drop("gram")
        else:
            rest = [c for c in own.columns if c not in ("id", "gram")]
            found = own.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest]).where(F.col("__n") == len(grams)).drop("__n")
        return found.where(F.col(label).ilike(f"%{text}%"))

    def narrowed(self, star: Star, texts: Mapping[str, str]) -> Star:
        """A star of the entries whose names hold texts (``marker`` and the four fields), with only these rows in the dimensions asked for.

        Questions about entries that match (search, total, export, the counts of
        a ranking) have the answers that they have about the whole star with
        these texts; the lists of a ranking are of all entries, which this star
        hasn't.  A text that the index can't tell is left to the question's own
        filter.
        """
        for field, text in texts.items():
            _, label = star.dimension(field)
            found = self.candidates(field, label, text) if text else None
            if found is not None:
                star = star.with_dimension(field, found, star.entries.join(found.select(F.col("id").alias(f"{field}_id")), f"{field}_id", "left_semi"))
        return star
