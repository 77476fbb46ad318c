"""What the charts and lists of a client show of a bubble table (``cell_type``, ``marker``, ``count``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_groups(bubble: DataFrame) -> DataFrame:
    """Markers of each cell type by count; cell types by how many markers they have."""
    own = Window.partitionBy("cell_type")
    ranked = bubble.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("count"), "marker")), "group_size": F.count(F.lit(1)).over(own)})
    return ranked.orderBy(F.desc("group_size"), "cell_type", "rank")


def ranking_page(bubble: DataFrame, limit: int = 500, head: int = 200) -> DataFrame:
    """Rows of the first ``head`` overall and the first ``limit`` others, in the order of the groups."""
    grouped = ranking_groups(bubble).withColumn("in_bubble", F.row_number().over(Window.orderBy(F.desc("count"), "cell_type", "marker")) <= head)
    before = Window.orderBy(F.desc("group_size"), "cell_type", "rank").rowsBetween(Window.unboundedPreceding, 0)
    others = F.sum((~F.col("in_bubble")).cast("int")).over(before)
    return grouped.withColumn("others", others).where(F.col("in_bubble") | (F.col("others") <= limit)).drop("others")


def shares(bubble: DataFrame) -> DataFrame:
    """Each count in per cent of the largest."""
    return bubble.withColumn("share", F.col("count") / F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1)) * 100)


def jitter(bubble: DataFrame) -> DataFrame:
    """Offsets that set apart points with the same cell type and count, and the place of the cell type on the axis."""
    same = Window.partitionBy("cell_type", "count")
    i, n = F.row_number().over(same.orderBy("marker")) - 1, F.count(F.lit(1)).over(same)
    spread = F.greatest(F.col("count") * 0.06, F.lit(0.4))
    step = 2 * spread / F.greatest(n - 1, F.lit(1))
    return bubble.withColumns({"offset": (i - (n - 1) / 2) * step, "x": F.dense_rank().over(Window.orderBy("cell_type")) - 1})


def sizes(bubble: DataFrame) -> DataFrame:
    """Diameter of each point."""
    most = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    return bubble.withColumn("size", F.greatest(F.lit(6.0), F.sqrt(F.col("count") / most) * 45))


def pie_shares(counts: DataFrame, longest: int = 20, cut: int = 18) -> DataFrame:
    """Each count of a distribution in per cent of those listed, with a short label."""
    label = F.when(F.length("name") > longest, F.concat(F.substring("name", 1, cut), F.lit("…"))).otherwise(F.col("name"))
    return counts.withColumns({"percent": F.col("count") / F.sum("count").over(Window.partitionBy()) * 100, "label": label})


def bars(counts: DataFrame, colours: int = 15) -> DataFrame:
    """A distribution from small to large with the number of each bar's colour."""
    rank = F.row_number().over(Window.orderBy("count", F.desc("name"))) - 1
    return counts.withColumn("colour", F.pmod(rank, F.lit(colours))).orderBy("count", F.desc("name"))


def group_counters(bubble: DataFrame) -> DataFrame:
    """Numbers of rows and cell types, and the largest count, at least 1."""
    return bubble.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cell_type").alias("groups"), F.greatest(F.coalesce(F.max("count"), F.lit(1)), F.lit(1)).alias("max_count"))


def reconciled(selected: dict[str, list[str]], options, rounds: int = 3) -> dict[str, list[str]]:
    """Drop selected values that the facets no longer offer, until nothing changes or ``rounds`` are over.

    ``options``: a function from selections to a table of facets (``field``, ``value``).
    """
    for _ in range(rounds):
        asked = [(f, v) for f, values in selected.items() for v in values]
        if not asked:
            return selected
        table = options(selected)
        wanted = table.sparkSession.createDataFrame(asked, "field string, value string")
        left = {(r["field"], r["value"]) for r in wanted.join(table.distinct(), ["field", "value"], "left_semi").collect()}
        kept = {f: [v for v in values if (f, v) in left] for f, values in selected.items()}
        if kept == selected:
            break
        selected = kept
    return selected
