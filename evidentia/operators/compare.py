"""Comparison of two extractions of the same papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import strict_key
from ..functions.names import strip
from ..plans.star import best_first, least_first

LOW_F1, SAMPLE = 0.5, 10


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def keyed(entries: DataFrame) -> DataFrame:
    """The first entry of each paper and strict key (``pmcid``, ``pos`` give the order)."""
    rows = entries.withColumn("key", strict_key(F.col("cell_type"), F.col("marker"))).where("key is not null")
    return least_first(["pmcid", "key"], ["pos"], rows).withColumn("gene", F.col("key.marker"))


def _first_keys(rows: DataFrame, name: str) -> DataFrame:
    """The first ``SAMPLE`` keys of each paper in their order, as a list; only these are gathered."""
    first = best_first(["pmcid"], ["key.cell_type", "key.marker"], rows.select("pmcid", "key"), SAMPLE)
    said = F.struct(F.col("key.cell_type").alias("cell_type"), F.col("key.marker").alias("marker"))
    return first.groupBy("pmcid").agg(F.array_sort(F.collect_list(said)).alias(name))


def compared(original: DataFrame, reference: DataFrame) -> DataFrame:
    """For each paper the sizes of both key sets and of what they share, precision, recall and F1, by key and by gene, and the agreement of fields.

    Metrics are 0 where they have no denominator, agreement is relative to at
    least one match; all are rounded half to even.
    """
    text = lambda c: F.lower(F.coalesce(strip(F.col(c)), F.lit("")))
    fields = ["tissue", "disease", "cell_subtype"]
    side = lambda df, s: keyed(df).select("pmcid", "key", *[text(f).alias(f"{f}_{s}") for f in fields], F.lit(True).alias(s))
    both = side(original, "o").join(side(reference, "r"), ["pmcid", "key"], "full")
    o, r = F.coalesce("o", F.lit(False)), F.coalesce("r", F.lit(False))
    both = both.select("pmcid", "key", o.alias("o"), r.alias("r"), *[(o & r & (F.col(f"{f}_o") == F.col(f"{f}_r"))).alias(f"same_{f}") for f in fields])
    counted = {"original": F.col("o"), "reference": F.col("r"), "matched": F.col("o") & F.col("r"), **{f"same_{f}": F.col(f"same_{f}") for f in fields}}
    genes = both.groupBy("pmcid", F.col("key.marker").alias("gene")).agg(*[F.count_if(c).alias(name) for name, c in counted.items()])
    has_o, has_r = F.col("original") > 0, F.col("reference") > 0
    sums = genes.groupBy("pmcid").agg(*[F.sum(name).alias(name) for name in counted], F.count_if(has_o).alias("go"), F.count_if(has_r).alias("gr"), F.count_if(has_o & has_r).alias("shared"))
    for name, only in (("only_in_original", F.col("o") & ~F.col("r")), ("only_in_reference", ~F.col("o") & F.col("r"))):
        sums = sums.join(_first_keys(both.where(only), name), "pmcid", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<cell_type:string,marker:string>>")))
    round4 = lambda c: F.bround(c, 4)
    p, q = _ratio(F.col("matched"), F.col("original")), _ratio(F.col("matched"), F.col("reference"))
    gp, gq = _ratio(F.col("shared"), F.col("go")), _ratio(F.col("shared"), F.col("gr"))
    return sums.select(
        "pmcid", "original", "reference", "matched",
        round4(p).alias("precision"), round4(q).alias("recall"), round4(_ratio(2 * p * q, p + q)).alias("f1"),
        round4(gp).alias("gene_precision"), round4(gq).alias("gene_recall"),
        *[round4(F.col(f"same_{f}") / F.greatest("matched", F.lit(1))).alias(f"{f}_agreement") for f in fields],
        "only_in_original", "only_in_reference",
    )


def summary(reports: DataFrame) -> DataFrame:
    """Means over papers of their rounded metrics, and how many papers have a low F1."""
    metrics = ["precision", "recall", "f1", "gene_precision", "gene_recall"]
    return reports.agg(
        F.count(F.lit(1)).alias("papers"),
        *[F.bround(F.avg(m), 4).alias(f"avg_{m}") for m in metrics],
        F.count_if(F.col("f1") < LOW_F1).alias("low_quality"),
    )


def low_quality_papers(reports: DataFrame) -> DataFrame:
    """Papers with a low F1, the worst first."""
    return reports.where(F.col("f1") < LOW_F1).select("pmcid", "f1").orderBy("f1", "pmcid")


def replaced(documents: DataFrame, reference: DataFrame) -> DataFrame:
    """Documents with the markers of the reference where there are any; ``original_markers`` keeps what they had."""
    ref = reference.select("pmcid", F.col("markers").alias("__new"), F.col("model").alias("__model"))
    out = documents.join(ref, "pmcid", "left").withColumn("validated", F.col("__new").isNotNull())
    changed = {
        "original_markers": F.when(F.col("validated"), F.col("markers")),
        "original_model": F.when(F.col("validated"), F.col("model")),
        "markers": F.coalesce("__new", "markers"),
        "model": F.coalesce("__model", "model"),
    }
    out = out.withColumns(changed)
    return out.withColumn("valid_marker_count", F.when(F.col("validated"), F.size("markers")).otherwise(F.col("valid_marker_count"))).drop("__new", "__model")
