"""Small builders of Spark expressions for the operators that run on DataFrame functions alone."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let  # noqa: F401 - the operators take it from here

#: White space of the word rule; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_STEP = 512


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def running_sums(values: Column) -> Column:
    """Sums of an array of longs up to each element, in time n to the power 1.5."""

    def within(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(part, start, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"] + x)).alias("a")))["a"]

    def joined(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<array<bigint>>").alias("a"))
        step = lambda s, p: F.struct((s["t"] + F.element_at(p, -1)).alias("t"), F.concat(s["a"], F.array(F.transform(p, lambda x: x + s["t"]))).alias("a"))
        return F.flatten(F.aggregate(parts, start, step)["a"])

    def whole(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), ((F.size(v) - 1) / _STEP).cast("int"))
        return joined(F.transform(cuts, lambda c: within(F.slice(v, c * _STEP + 1, _STEP))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<bigint>")))
