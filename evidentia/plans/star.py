"""Questions asked of a star of entries, markers, cell types, subtypes, tissues, diseases and papers.

Every question is a lazy DataFrame.  Dimensions are joined without hints, so
that Spark broadcasts them where its size estimate allows and shuffles them
where not.  Ties are broken by key, so that pages and top lists are total orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LISTED

UNSPECIFIED = "Not specified"
PAGE_SIZE, MOST_PER_PAGE, MOST_RANKED, EXPORT_CAP = 20, 200, 500, 50_000
TOP = {"cell_type": 15, "disease": 30, "tissue": 15}
FIELDS = ("cell_type", "cell_subtype", "tissue", "disease")


@dataclass(frozen=True)
class Filters:
    """What entries are asked for.  Empty means all; values of one field are alternatives, fields are combined."""

    cell_type: Sequence[str] = ()
    cell_subtype: Sequence[str] = ()
    tissue: Sequence[str] = ()
    disease: Sequence[str] = ()
    marker: str = ""

    def but(self, name: str) -> Filters:
        return Filters(**{**self.__dict__, name: () if name != "marker" else ""})

    def conditions(self) -> dict[str, Column]:
        asked = {f: F.col(f).isin(list(getattr(self, f))) for f in FIELDS if getattr(self, f)}
        if self.marker:  # % and _ in it are wildcards
            asked["marker"] = F.col("marker").ilike(f"%{self.marker}%")
        return asked


#: Rows of a part into which entries are dealt, so that a task's memory doesn't grow with the table.
PART_ROWS = 250_000


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``n`` rows in parts of at most about ``PART_ROWS`` by keys, which Spark doesn't merge; as they are where few parts would do.

    Fewer parts than the session's exchanges have would be dealt out once more by the next join.
    """
    parts = -(-n // PART_ROWS)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, least), *by) if parts > 8 else rows


def _within(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


@dataclass(frozen=True)
class Star:
    """The tables.  ``order``: the entries' key columns, which break ties.

    ``size``: about how many entries there are, where markers are too many to be broadcast; 0 leaves parts to Spark,
    which merges those of an exchange up to a size in bytes, however many rows and operators meet in one task then.
    """

    entries: DataFrame
    markers: DataFrame
    cell_types: DataFrame
    cell_subtypes: DataFrame
    tissues: DataFrame
    diseases: DataFrame
    papers: DataFrame
    order: tuple[str, ...] = ("id",)
    size: int = 0

    def _dim(self, name: str, *more: str) -> tuple[DataFrame, str, str]:
        """A dimension as (key, label) and further columns, with the join that keeps every entry it must keep."""
        table, label, how = {
            "marker": (self.markers, "symbol", "inner"),
            "cell_type": (self.cell_types, "name", "inner"),
            "cell_subtype": (self.cell_subtypes, "name", "left"),
            "tissue": (self.tissues, "name", "left"),
            "disease": (self.diseases, "name", "left"),
        }[name]
        return table.select(F.col("id").alias(f"{name}_id"), F.col(label).alias(name), *more), f"{name}_id", how

    def dimension(self, name: str) -> tuple[DataFrame, str]:
        """The table of a field or of markers, and the column of its names."""
        return getattr(self, f"{name}s"), "symbol" if name == "marker" else "name"

    def with_dimension(self, name: str, table: DataFrame, entries: DataFrame) -> Star:
        return Star(**{**self.__dict__, f"{name}s": table, "entries": entries})

    def joined(self, names: Sequence[str], inner: Sequence[str] = (), cited: bool = False) -> DataFrame:
        """Entries with the named dimensions; those in ``inner`` keep only entries that have one.  ``cited``: markers with their citation counts."""
        def add(df: DataFrame, name: str) -> DataFrame:
            dim, key, how = self._dim(name, *(["citation_count"] if cited and name == "marker" else []))
            own = dealt(df, self.size, key) if name == "marker" else df
            return own.join(dim, key, "inner" if name in inner else how)

        return reduce(add, names, self.entries)

    def listed(self, cited: bool = False) -> DataFrame:
        """Every entry with its eight listed columns, the key, and if asked the marker's citation count."""
        papers = self.papers.select(F.col("id").alias("paper_id"), "pmid", "pmcid")
        cited_by = Star(**{**self.__dict__, "entries": self.entries.join(papers, "paper_id")})  # first, as entries often lie by paper
        rows = cited_by.joined(["marker", *FIELDS], cited=cited)
        return rows.select(*LISTED, *(["citation_count"] if cited else []), *self.order)

    def filtered(self, filters: Filters, also: Sequence[str] = ()) -> DataFrame:
        """Entries that pass, joined with no more dimensions than the filters and ``also`` need."""
        asked = filters.conditions()
        df = self.joined(list(dict.fromkeys([*also, *asked])), inner=list(asked))
        return reduce(lambda d, c: d.where(c), asked.values(), df)

    def search(self, filters: Filters = Filters(), page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
        """One page of entries, by citation count, marker and cell type; what neither order nor filters need is joined to its rows alone."""
        size = _within(page_size, 1, MOST_PER_PAGE, "page_size")
        skip = (_within(page, 1, 1 << 30, "page") - 1) * size
        asked = filters.conditions()
        with_paper = self.entries.join(self.papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
        early = [f for f in FIELDS if f in asked or f == "cell_type"]
        rows = Star(**{**self.__dict__, "entries": with_paper}).joined(["marker", *early], inner=[f for f in early if f in asked], cited=True)
        by = [F.desc("citation_count"), "marker", "cell_type", *self.order]
        page_rows = reduce(lambda d, c: d.where(c), asked.values(), rows).orderBy(*by).offset(skip).limit(size)
        named = Star(**{**self.__dict__, "entries": page_rows})
        papers = self.papers.select(F.col("id").alias("paper_id"), "pmid", "pmcid")
        return named.joined([f for f in FIELDS if f not in early]).join(papers, "paper_id").orderBy(*by).select(LISTED)

    def total(self, filters: Filters = Filters(), hint: int = 0) -> DataFrame:
        """Number of entries that pass; a positive hint is taken for it."""
        if hint < 0:
            raise ValueError("hint must not be negative")
        if hint:
            return self.entries.sparkSession.createDataFrame([(hint,)], "total long")
        return self.filtered(filters, ["marker", "cell_type"]).agg(F.count(F.lit(1)).alias("total"))

    def lists_of_markers(self) -> DataFrame:
        """For each marker with entries the sorted names of its cell types, subtypes, tissues and diseases."""
        every = self.joined(["marker", *FIELDS])
        return every.groupBy("marker_id", "marker").agg(*[F.array_sort(F.collect_set(f)).alias(f"{f}s") for f in FIELDS])

    def ranking(self, limit: int = 50, cell_type: str = "", tissue: str = "", disease: str = "") -> DataFrame:
        """Markers by distinct papers among entries whose names contain the texts; their lists are of all entries."""
        parts = {"cell_type": cell_type, "tissue": tissue, "disease": disease}
        df = self.joined(["marker", "cell_type", *[k for k in ("tissue", "disease") if parts[k]]])
        for name, text in parts.items():
            if text:
                df = df.where(F.col(name).ilike(f"%{text}%"))
        counts = df.groupBy("marker_id", "marker").agg(F.count_distinct("paper_id").alias("citation_count"), F.count_distinct("cell_type_id").alias("cell_type_count"))
        top = counts.orderBy(F.desc("citation_count"), "marker").limit(_within(limit, 1, MOST_RANKED, "limit"))
        own = self.entries.join(top.select("marker_id"), "marker_id", "left_semi")
        lists = Star(**{**self.__dict__, "entries": own, "size": 0}).lists_of_markers().select("marker_id", "cell_types", "tissues", "diseases")
        return top.join(lists, "marker_id").drop("marker_id").orderBy(F.desc("citation_count"), "marker")

    def detail(self, symbol: str) -> DataFrame:
        """A marker's citation count, lists and number of entries; no row if there is no such marker."""
        own = self.markers.where(F.col("symbol") == symbol).select(F.col("id").alias("marker_id"), F.col("symbol").alias("marker"), "citation_count")
        entries = self.joined(FIELDS).join(own.select("marker_id"), "marker_id", "left_semi")
        about = entries.groupBy("marker_id").agg(F.count(F.lit(1)).alias("total"), *[F.array_sort(F.collect_set(f)).alias(f"{f}s") for f in FIELDS])
        none = F.array().cast("array<string>")
        return own.join(about, "marker_id", "left").select("marker", "citation_count", F.coalesce("total", F.lit(0)).alias("total"), *[F.coalesce(f"{f}s", none).alias(f"{f}s") for f in FIELDS])

    def detail_entries(self, symbol: str, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
        """One page of a marker's entries, by cell type and paper."""
        size = _within(page_size, 1, MOST_PER_PAGE, "page_size")
        skip = (_within(page, 1, 1 << 30, "page") - 1) * size
        return self.listed().where(F.col("marker") == symbol).orderBy("cell_type", "pmcid", *self.order).offset(skip).limit(size).select(LISTED)

    def types(self) -> DataFrame:
        """Every cell type, also without entries, with its numbers of markers and entries and its subtypes."""
        counts = self.entries.groupBy("cell_type_id").agg(F.count_distinct("marker_id").alias("m"), F.count(F.lit(1)).alias("n"))
        subtypes = self.cell_subtypes.groupBy("cell_type_id").agg(F.array_sort(F.collect_set("name")).alias("s"))
        named = self.cell_types.select(F.col("id").alias("cell_type_id"), "name").join(counts, "cell_type_id", "left").join(subtypes, "cell_type_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        return named.select("name", zero("m").alias("marker_count"), zero("n").alias("entry_count"), F.coalesce("s", F.array().cast("array<string>")).alias("subtypes")).orderBy(F.desc("entry_count"), "name")

    def overview(self) -> DataFrame:
        """Numbers of rows of the six tables, in one row."""
        tables = {"papers": self.papers, "markers": self.markers, "cell_types": self.cell_types, "diseases": self.diseases, "tissues": self.tissues, "entries": self.entries}
        counts = [t.agg(F.count(F.lit(1)).alias(f"total_{n}")) for n, t in tables.items()]
        return reduce(DataFrame.crossJoin, counts)  # of single rows

    def distribution(self, name: str, limit: int | None = None) -> DataFrame:
        """The names with most entries; tissues leave out what is not specified."""
        df = self.joined([name], inner=[name])
        if name == "tissue":
            df = df.where(F.col(name) != UNSPECIFIED)
        return df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name").limit(limit or TOP[name])

    def facets(self, filters: Filters = Filters()) -> DataFrame:
        """Choices (``field``, ``value``) left in each field by the filters on the others.

        Without any filter the dimensions are listed as they are, with values
        that no entry has and subtypes of several cell types more than once.
        """
        if not any(getattr(filters, f) for f in FIELDS):
            tables = {"cell_type": self.cell_types, "cell_subtype": self.cell_subtypes, "tissue": self.tissues, "disease": self.diseases}
            parts = [t.select(F.lit(f).alias("field"), F.col("name").alias("value")) for f, t in tables.items()]
            return reduce(DataFrame.union, parts).orderBy("field", "value")
        return self._choices(filters).orderBy("field", "value")

    def _choices(self, filters: Filters) -> DataFrame:
        """Fields and values of the entries that pass all filters but the field's own.

        One pass: entries count once for each combination of the four keys, each
        combination gets a bit for every filter that it fails, and a field takes
        the combinations that fail none but perhaps its own.
        """
        combinations = self.entries.select([f"{f}_id" for f in FIELDS]).distinct()
        named = combinations
        for f in FIELDS:
            dim, key, _ = self._dim(f)
            named = named.join(dim, key, "left")
        asked = filters.but("marker").conditions()
        fails = [F.when(F.coalesce(asked[f], F.lit(False)), 0).otherwise(1 << k) if f in asked else F.lit(0) for k, f in enumerate(FIELDS)]
        masked = named.withColumn("fails", reduce(lambda a, b: a + b, fails)).where(F.bit_count("fails") <= 1)
        open_to = lambda k: F.col("fails").bitwiseAND(F.lit(((1 << len(FIELDS)) - 1) ^ (1 << k))) == 0
        choices = [F.when(open_to(k) & F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for k, f in enumerate(FIELDS)]
        return masked.select(F.explode(F.array_compact(F.array(*choices))).alias("c")).select("c.*").distinct()

    def bubble(self, filters: Filters = Filters(), limit: int = 200) -> DataFrame:
        """Pairs of cell type and marker by distinct papers."""
        df = self.filtered(filters.but("marker"), ["cell_type", "marker"])
        own = dealt(df.select("cell_type", "marker", "paper_id"), self.size, "cell_type", "marker", "paper_id")  # not by pairs alone, of which one may have many papers
        pairs = own.groupBy("cell_type", "marker").agg(F.count_distinct("paper_id").alias("count"))
        return pairs.orderBy(F.desc("count"), "cell_type", "marker").limit(_within(limit, 10, 10_000, "limit"))

    def export(self, filters: Filters = Filters(), cap: int | None = EXPORT_CAP) -> DataFrame:
        """Entries in the order of markers, at most ``cap`` (None: all, in as many sorted partitions as there are), nulls as empty texts."""
        found = reduce(lambda d, c: d.where(c), filters.conditions().values(), self.listed())
        ordered = found.orderBy("marker", *self.order)
        return (ordered if cap is None else ordered.limit(cap)).select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LISTED])

    def refreshed_markers(self) -> DataFrame:
        """Markers with their citation counts counted anew; those without entries keep theirs."""
        counts = self.entries.groupBy(F.col("marker_id").alias("id")).agg(F.count_distinct("paper_id").alias("fresh"))
        return self.markers.join(counts, "id", "left").withColumn("citation_count", F.coalesce("fresh", "citation_count")).drop("fresh")

    def init(self) -> dict[str, DataFrame]:
        """What a search view starts with."""
        return {"facets": self.facets(), "page": self.search(), "total": self.total(), "bubble": self.bubble(limit=2000)}

    def dashboard(self) -> dict[str, DataFrame]:
        return {"overview": self.overview(), **{name: self.distribution(name) for name in TOP}}


def best_first(keys: Sequence[str], order: Sequence[Column | str], df: DataFrame, k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def least_first(keys: Sequence[str], order: Sequence[str], df: DataFrame) -> DataFrame:
    """The first row of each group by columns in rising order, nulls first; rows that agree in these by the others.

    Groups are combined before they are exchanged, unlike ``best_first``, which
    takes over where a column has no order.
    """
    rest = [*order, *[c for c in df.columns if c not in {*keys, *order}]]
    if any("map<" in kind or kind == "variant" for _, kind in df.select(*rest).dtypes):
        return best_first(keys, order, df)
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__least")).select(*keys, "__least.*").select(df.columns)
