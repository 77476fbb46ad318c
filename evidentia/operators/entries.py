"""Entries out of model replies: parsing, required fields, first-wins dedup, sampling, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.names import strip
from ..plans.star import least_first
from ..schema import MARKER
from ..session import scratch
from ..sources.sinks import write_stage

FIELDS = [f.name for f in MARKER.fields]


def parsed(replies: DataFrame, json_col: str = "reply") -> DataFrame:
    """Entries (``pmcid``, ``pos`` and the five fields) of replies with a JSON list ``markers``.

    Each element is parsed by itself, so that one which is no object costs only
    itself.  Fields that aren't texts or are blank are null; an element without
    a cell type or marker (null, empty, false, 0) is left out.  A reply that
    isn't JSON has no entries.
    """
    items = F.from_json(F.col(json_col), "markers array<string>")["markers"]
    each = replies.select("pmcid", F.posexplode(items).alias("pos", "item")).where(F.col("item").startswith("{"))
    raw = {f: F.get_json_object("item", f"$.{f}") for f in FIELDS}
    kinds = F.try_parse_json("item")
    is_text = {f: F.schema_of_variant(F.try_variant_get(kinds, f"$.{f}", "variant")) == "STRING" for f in FIELDS}
    values = {f: F.when(is_text[f], let(strip(raw[f]), lambda s: F.when(s != "", s))) for f in FIELDS}
    truthy = [F.coalesce(raw[f], F.lit("")).isin("", "false", "0", "[]", "{}", "0.0") for f in ("cell_type", "marker")]
    return each.where(~truthy[0] & ~truthy[1]).select("pmcid", "pos", *[v.alias(f) for f, v in values.items()])


def unreadable(replies: DataFrame, json_col: str = "reply") -> DataFrame:
    """Replies that are no JSON object with a list ``markers``, to be set aside."""
    return replies.where(F.col(json_col).isNull() | F.from_json(F.col(json_col), "markers array<string>")["markers"].isNull())


def exploded(documents: DataFrame) -> DataFrame:
    """Entries of documents with an array ``markers``, numbered by place."""
    return documents.select("pmcid", F.posexplode("markers").alias("pos", "m")).select("pmcid", "pos", "m.*")


def gathered(entries: DataFrame) -> DataFrame:
    """The reverse: ``pmcid`` and ``markers`` in their order."""
    item = F.struct("pos", F.struct(*FIELDS).alias("m"))
    return entries.groupBy("pmcid").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("markers"))


def first_entries(entries: DataFrame, keys=tuple(FIELDS), paper: str = "pmcid", order=("pos",)) -> DataFrame:
    """The first entry of a paper with the same keys; nulls are equal.  ``order`` names columns; equal ones are followed by the others."""
    return least_first([paper, *keys], list(order), entries)


#: Hexadecimal digits of a row's digest by which a sample is cut: at most 65,536 groups.
_DIGITS = 4


def sampled(df: DataFrame, key: str, share: float = 0.05, seed: int = 0) -> DataFrame:
    """Exactly ``max(1, int(n * share))`` rows, the same in each run, in the order of their digests.

    Rows are counted by the beginnings of their digests.  All rows of the groups
    before the one in which the sample ends are in it, and only of that group
    the first rows are looked for; no task sees the whole sample.
    """
    rows = df.withColumn("__digest", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    group = F.substring("__digest", 1, _DIGITS)
    sizes = sorted(rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each group
    wanted = max(1, int(sum(s["n"] for s in sizes) * share))
    before, last = 0, ""
    for s in sizes:
        last = s["g"]
        if before + s["n"] >= wanted:
            break
        before += s["n"]
    edge = rows.where(group == last).orderBy("__digest", key).limit(wanted - before if sizes else 0)
    return rows.where(group < last).union(edge).orderBy("__digest", key).drop("__digest")


def unprocessed(todo: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows without a result yet; if asked the first ``limit`` by key."""
    left = todo.join(done.select(key).distinct(), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def batches(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Rows with the number of their batch, in the order of a key; rows with equal keys in any order.

    The sorted rows are written once, each with its partition and its place in
    it, and both the sizes of partitions and the rows are read from there: a
    second evaluation could draw other bounds.  No task sees all rows.
    """
    spread = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    spread = write_stage(spread, scratch(df.sparkSession), "sorted")
    counts = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__least"))
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each partition
    return spread.join(before, "__p").withColumn("batch", F.floor((F.col("__before") + F.col("__i") - F.col("__least")) / size)).drop("__p", "__i", "__least", "__before")


def run_totals(documents: DataFrame) -> DataFrame:
    """Papers, markers, tokens, and markers a paper (of at least one)."""
    n = F.count(F.lit(1))
    total = F.sum(F.size("markers"))
    return documents.agg(n.alias("papers"), F.coalesce(total, F.lit(0)).alias("markers"), F.coalesce(F.sum("usage.total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(total / F.greatest(n, F.lit(1)), F.lit(0.0)).alias("markers_per_paper"))


def accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many entries a step was given, kept and dropped."""
    n, k = before.agg(F.count(F.lit(1)).alias("total")), after.agg(F.count(F.lit(1)).alias("kept"))
    return n.crossJoin(k).withColumn("dropped", F.col("total") - F.col("kept"))  # of single rows
