"""Operator 8: mixing of sources to target weights along a curriculum.

Each source gets a share of all words by its weight, at most ``most`` times its
own size, what exceeds that being shared anew by weight.  Its documents, in an
order by digest, are taken in whole passes and one partial pass until the share
is reached.  A source's weight changes over the training from ``begins`` to
``ends`` times its mean; the integral of that line is the source's cumulative
demand for words, and inverting it gives the moment at which the words that
precede a document are used up, its position, one for each pass that takes it.
The training order is a range sort of all uses by position.

Scale.  One aggregation by source; positions within a source come from sums of
4096 slices of the digest's range and a window inside each slice, so that a
source with a third of all rows is spread over 4096 groups.  The water level is
found by windows over the table of sources, one row for each, in one task: it
is for sources by name, up to millions, and not for one source a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import kept
from .expressions import WORD

WEIGHTS = (5, 2, 1)
#: Weight at the beginning and the end of the training, as multiples of its mean, for the sources in turn.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MOST = 3


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, most: int = MOST) -> DataFrame:
    """For each ``key`` (of a source): ``source_size``, ``target``, and ``bend`` of its schedule.

    Sources take weights and schedules in turn, by code point, null last.  The
    water level rises until the uncapped sources, in proportion to their
    weights, take all words that the capped ones leave.
    """
    by_source = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    take = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (nth % len(values) + 1).cast("int"))
    bends = [(a - b) / (a + b) for a, b in schedules]
    placed = by_source.withColumns({"weight": take(weights), "bend": take(bends), "cap": (F.col("source_size") * most).cast("double")})
    placed = placed.withColumn("at", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after, everything = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    placed = placed.withColumn("level", left / F.sum("weight").over(after)).withColumn("capped", F.col("at") <= F.col("level"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("at"))).over(everything)
    return placed.select("key", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"), "bend")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, most: int = MOST, carry: Sequence[str] = ()) -> DataFrame:
    """For each row: the id, ``size`` (words), ``source_size``, ``target``, ``taken`` and ``position`` (from 0 to 1, of its first use; null if unused),
    ``positions`` (of all its uses, one a pass, a partial one included),
    and ``carried``, a struct of the columns in ``carry`` if there are any.

    A null or empty text has size 0 and is never taken.  A null source is a
    source, the last.  Rows with the same id, or without one, are ordered by
    size and share or split what their place yields.  A text of any length is
    one row.  Other columns are ignored, whatever their names.
    """
    source = F.col(source_col).cast("string")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    more = [F.struct(*carry).alias("carried")] if carry else []
    sized = kept(
        docs.select(
            F.col(id_col).alias("id"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            digest.alias("digest"),
            *more,
        )
    ).withColumn("slice", F.substring("digest", 1, 3))
    targets = kept(source_targets(sized, weights, schedules, most))
    slices = sized.groupBy("key", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("key", "slice", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")).join(targets, "key")
    inside = Window.partitionBy("key", "slice").orderBy("digest", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(slices, ["key", "slice"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    quota, total = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    passes = F.floor(quota / total)
    taken = passes * F.col("size") + F.least("size", F.greatest(quota - passes * F.col("source_size") - F.col("start"), F.lit(0)))
    line = 1 + F.col("bend")

    def moment(k):
        used = (F.col("start") + k * F.col("source_size")) / F.greatest(quota, F.lit(1))
        return 2 * used / (line + F.sqrt(F.greatest(line * line - 4 * F.col("bend") * used, F.lit(0.0))))

    placed = placed.withColumn("taken", taken.cast("long"))
    uses = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    positions = F.when(uses > 0, F.transform(F.sequence(F.lit(0), uses - 1), moment)).otherwise(F.array().cast("array<double>"))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, moment(F.lit(0))).alias("position"), positions.alias("positions"), *(["carried"] if carry else []))


def in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each use of a document, with its ``position`` and the words it takes, ``used``; range sort by position.

    ``taken`` stays the number of words of all uses.  What the mix doesn't take
    has one row without a position, and comes last.
    """
    others = [c for c in mixed.columns if c not in ("position", "positions")]
    each = mixed.select(*others, F.posexplode_outer("positions").alias("pass", "position"))
    used = F.when(F.col("position").isNull(), F.lit(0)).otherwise(F.least("size", F.col("taken") - F.col("pass") * F.col("size"))).cast("long")
    return each.withColumn("used", used).orderBy(F.col("position").asc_nulls_last(), id_col, "pass")


def in_first_use_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document; range sort by the position of its first use."""
    return mixed.drop("positions").orderBy(F.col("position").asc_nulls_last(), id_col)
