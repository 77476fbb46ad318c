"""Operator 5: quality rules, by DataFrame functions alone.

A document fails the base rules or is a robust multivariate outlier.  Five
transformed statistics of each text that passes the base rules are compared
with minimum-covariance-determinant estimates of its language and source.  Each
estimate begins from three places: medians and absolute deviations, the moments
of all documents, and medians with the covariance of spatial signs.  From each,
concentration steps follow, all groups and starts in one pass, which take mean
and covariance of the ``SHARE`` of documents nearest by Mahalanobis distance,
until nothing changes (or ``STEPS`` are done).  The start with the smallest
determinant is kept, and one reweighting step ends it.  Rejected are documents
beyond ``CUTOFF``.

Statistics are rounded to a grid and summed as whole numbers, and quantiles are
counted on grids, so that reruns agree bit for bit however rows are dealt out.

Scale.  Texts are read once, in one pass without a shuffle; what follows works
on a narrow table of five numbers a document.  Every aggregation has a partial
one before its shuffle, and no group is gathered: medians and the share's
radius come from counts of grid cells, whose number is bounded by the range of
a logarithm.  Groups of fewer than ``LEAST`` documents are judged with their
language's other small groups, or with all such, and where those are too few
with the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import kept
from .expressions import let, words

WINDOW = 8
#: Share of a group in each estimate, most concentration steps, smallest group that is judged by itself.
SHARE, STEPS, LEAST = 0.75, 10, 60
#: Rows in a partition of the statistics, which each step reads.
EACH = 1 << 17
#: Squared Mahalanobis distance beyond which a document is rejected; of 10^7 normal vectors it would reject about one or two.
CUTOFF = 40.0
#: Chi-squared of five degrees: what makes the share's covariance that of all, and the limit of the reweighting step.
_GROWN, _NEAR = 1.41, 12.83
#: Grid of a statistic (cells a unit), number of cells of a distance, cells a unit of distance, and of a sign.
GRID, CELLS, _FINE, _SIGN = 256, 8192, 64, 1024
#: Standard deviation of each statistic that is added to its estimate, in its own unit, so that one which hardly varies doesn't decide alone.
STATISTICS = {"size": 0.5, "word": 0.05, "symbols": 0.35, "lines": 0.5, "repeats": 0.4}
_P = len(STATISTICS)


def _repeat_words(ws: Column) -> Column:
    """Words in windows of ``WINDOW`` that the text has twice or more."""
    n = F.size(ws) - WINDOW + 1

    def covered(places: Column) -> Column:
        after = F.concat(F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
        return F.aggregate(F.zip_with(places, after, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)

    def doubled(s: Column) -> Column:
        last = F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("i"))
        after = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(last))
        before = F.concat(F.array(last), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
        near = F.zip_with(F.zip_with(s, before, lambda x, b: F.struct(x["h"].alias("h"), x["i"].alias("i"), ((b["i"] >= 0) & (b["h"] == x["h"])).alias("t"))), after, lambda x, a: F.struct(x["i"].alias("i"), (x["t"] | ((a["i"] >= 0) & (a["h"] == x["h"]))).alias("t")))
        return F.array_sort(F.transform(F.filter(near, lambda x: x["t"]), lambda x: x["i"]))

    def counted(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(ordered, doubled), covered))

    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    return F.when(n >= 2, let(hashes, counted)).otherwise(0)


def text_statistics(text: Column) -> Column:
    """Counts of a text; a null text has none of anything."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.coalesce(F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + F.length(w)), F.lit(0)).alias("word_chars"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))


def _cells(n_words: str = "n_words") -> dict[str, Column]:
    """The transformed statistics in cells of the grid."""
    at_least = F.greatest(F.col(n_words), F.lit(1))
    values = {
        "size": F.log1p(n_words),
        "word": F.log((F.col("word_chars") + 1) / at_least),
        "symbols": F.log((F.col("n_symbols") + 1) / (at_least + 20)),
        "lines": 5 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": 5 * F.col("n_repeat_words") / at_least,
    }
    return {k: F.round(v * GRID).cast("long") for k, v in values.items()}


def _rank_cell(cells: DataFrame, share: float, by: list[str], cell: str, n: str) -> DataFrame:
    """The cell that holds the given share of each group's counted values."""
    so_far = F.sum(n).over(Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy(*by))
    return cells.select(*by, cell, so_far.alias("so_far"), total.alias("total")).where(F.col("so_far") >= F.ceil(F.col("total") * share)).groupBy(*by).agg(F.min(cell).alias(cell))


_NAMES = list(STATISTICS)
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[: i + 1]]
_SUMS = [f"s_{a}" for a in _NAMES] + [f"s_{b}_{a}" for a, b in _PAIRS]
_FACTORS = [f"m_{a}" for a in _NAMES] + [f"l_{i}_{j}" for i in range(_P) for j in range(i + 1)]


def _factored(moments: DataFrame, grown: float, by: list[str]) -> DataFrame:
    """Means, the Cholesky factor of the covariance (in units, with the added deviations) from sums, and the logarithm of its determinant.

    Each line of the select may name the ones before it.
    """
    out = [f"s_{a} / cast(n as double) / {GRID} as m_{a}" for a in _NAMES]
    for j, b in enumerate(_NAMES):
        for i, a in list(enumerate(_NAMES))[j:]:
            cov = f"(s_{b}_{a} / cast(n as double) / {GRID} / {GRID} - m_{a} * m_{b}) * {grown!r}D"
            if i == j:
                cov = f"greatest({cov}, 0.0D) + {STATISTICS[a] ** 2!r}D"
            for k in range(j):
                cov = f"{cov} - l_{i}_{k} * l_{j}_{k}"
            out.append(f"sqrt(greatest({cov}, 1e-6D)) as l_{i}_{i}" if i == j else f"({cov}) / l_{j}_{j} as l_{i}_{j}")
    spread = " + ".join(f"ln(l_{i}_{i})" for i in range(_P))
    return moments.selectExpr(*by, *out, f"round({spread}, 6) as spread", f"xxhash64(n, {', '.join(_SUMS)}) as state")


def _distances(cells: DataFrame, estimate: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """``d2``, the squared Mahalanobis distance of each row to its group's estimates; null without one."""
    out = []
    for i, a in enumerate(_NAMES):
        z = " - ".join([f"{a} / {GRID} - m_{a}", *[f"l_{i}_{j} * z_{j}" for j in range(i)]])
        out.append(f"({z}) / l_{i}_{i} as z_{i}")
    d2 = " + ".join(f"z_{i} * z_{i}" for i in range(_P))
    return cells.join(estimate.select("group", *more, *_FACTORS), "group", "left").selectExpr(*cells.columns, *more, *out, f"{d2} as d2").select(*cells.columns, *more, "d2")


def _moments(cells: DataFrame, by: list[str]) -> DataFrame:
    sums = [f"sum({a}) as s_{a}" for a in _NAMES] + [f"sum({a} * {b}) as s_{b}_{a}" for a, b in _PAIRS]
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *map(F.expr, sums))


def _nearest(far: DataFrame, share: float) -> DataFrame:
    """Moments of the share of each group and start with the smallest ``d2``: sums of bins first, then of the bins up to the share's edge."""
    bins = _moments(far.withColumn("bin", F.least(F.floor(F.sqrt("d2") * _FINE), F.lit(CELLS))), ["group", "start", "bin"])
    whole = Window.partitionBy("group", "start")
    before = F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = bins.select("*", before.alias("before"), F.sum("n").over(whole).alias("total")).where(F.col("before") < F.ceil(F.col("total") * share))
    return some.groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)])


def _medians(cells: DataFrame) -> DataFrame:
    """Median (``m_``) and median absolute deviation (``d_``) of each group's statistics, in cells."""
    long = cells.select("group", F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).alias("cell")) for a in _NAMES])).alias("x")).select("group", "x.name", "x.cell")
    counted = kept(long.groupBy("group", "name", "cell").count())
    medians = _rank_cell(counted, 0.5, ["group", "name"], "cell", "count").withColumnRenamed("cell", "median")
    apart = counted.join(medians, ["group", "name"]).select("group", "name", "median", F.abs(F.col("cell") - F.col("median")).alias("apart"), "count")
    spread = _rank_cell(apart.groupBy("group", "name", "apart").agg(F.sum("count").alias("count")), 0.5, ["group", "name"], "apart", "count")
    both = medians.join(spread, ["group", "name"])
    return both.groupBy("group").agg(*[F.max(F.when(F.col("name") == a, F.col(c))).alias(f"{k}_{a}") for k, c in (("m", "median"), ("d", "apart")) for a in _NAMES])


def _starts(cells: DataFrame) -> DataFrame:
    """Three estimates of each group to begin from."""
    medians = kept(_medians(cells))
    around = {f"s_{a}": F.col(f"m_{a}").cast("double") for a in _NAMES}
    product = lambda a, b: F.col(f"m_{a}") * F.col(f"m_{b}").cast("double")
    plain = {f"s_{b}_{a}": product(a, b) + (F.col(f"d_{a}") * F.col(f"d_{a}") * 1.4826**2 if a == b else F.lit(0.0)) for a, b in _PAIRS}
    first = medians.select("group", F.lit("1 medians").alias("start"), F.lit(1).cast("long").alias("n"), *[v.alias(k) for k, v in (around | plain).items()])
    second = _moments(cells, ["group"]).select("group", F.lit("2 all").alias("start"), "n", *[F.col(c).cast("double").alias(c) for c in _SUMS])
    scale = {a: F.greatest(F.col(f"d_{a}") * 1.4826, F.lit(float(STATISTICS[a] * GRID))) for a in _NAMES}
    apart = cells.join(medians, "group").withColumns({f"z_{a}": (F.col(a) - F.col(f"m_{a}")) / scale[a] for a in _NAMES})
    size = F.sqrt(sum((F.col(f"z_{a}") * F.col(f"z_{a}") for a in _NAMES[1:]), F.col(f"z_{_NAMES[0]}") * F.col(f"z_{_NAMES[0]}")))
    signs = apart.withColumn("size_z", size).select("group", *[F.when(F.col("size_z") > 0, F.round(F.col(f"z_{a}") / F.col("size_z") * _SIGN).cast("long")).otherwise(F.lit(0)).alias(a) for a in _NAMES])
    shape = _moments(signs, ["group"]).select("group", F.col("n").alias("of"), *[F.col(f"s_{b}_{a}").alias(f"u_{b}_{a}") for a, b in _PAIRS])
    shaped = {f"s_{b}_{a}": product(a, b) + F.col(f"u_{b}_{a}") / F.col("of").cast("double") / (_SIGN * _SIGN / _P) * scale[a] * scale[b] for a, b in _PAIRS}
    third = medians.join(shape, "group").select("group", F.lit("3 signs").alias("start"), F.lit(1).cast("long").alias("n"), *[v.alias(k) for k, v in (around | shaped).items()])
    return _factored(first.union(second).union(third), 1.0, ["group", "start"])


def robust_estimates(cells: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates of each group."""
    estimate, state = kept(_starts(cells)), None
    for _ in range(STEPS):
        estimate = kept(_factored(_nearest(_distances(cells, estimate, ["start"]), SHARE), _GROWN, ["group", "start"]))
        now = estimate.agg(F.count(F.lit(1)), F.sum(F.xxhash64("group", "start", "state").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    best = estimate.groupBy("group").agg(F.min_by(F.struct(*_FACTORS), F.struct("spread", "start")).alias("x")).select("group", "x.*")
    return kept(_factored(_moments(_distances(cells, kept(best)).where(F.col("d2") <= _NEAR), ["group"]), 1.0, ["group"]))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row for each input row: the id, the counts, ``base_failed``, ``distance`` and ``kept``.

    Counts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``.  The base rules reject fewer than 20 words, or over 30 %
    of words in repeated windows; null and empty texts fail.  ``distance`` (the
    squared Mahalanobis distance) is null where the base rules reject.  Null
    languages and sources are groups like others.  Repeated rows are judged
    each, rows without an id too.  A text of any length is one row.  Other
    columns are ignored, whatever their names.
    """
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (lang_col, source_col))
    counted = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), source.alias("source"), text_statistics(F.col(text_col)).alias("t"))
    counted = counted.select("id", "lang", "source", "t.w.n_words", "t.w.word_chars", "t.n_symbols", "t.l.n_lines", "t.l.n_dup_lines", "t.w.n_repeat_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = kept(counted.withColumn("base_failed", failed).withColumns(_cells()))
    sizes = counted.where("not base_failed").groupBy("lang", "source").count()
    little = F.col("count") < LEAST
    of_lang = F.sum(F.when(little, F.col("count"))).over(Window.partitionBy("lang"))
    group = F.when(~little, F.concat("lang", F.lit("/"), "source")).when(of_lang >= LEAST, F.concat("lang", F.lit("//"))).otherwise("///")
    grouped = kept(sizes.select("lang", "source", group.alias("group"), "count"))
    totals = grouped.groupBy("group").agg(F.sum("count").alias("count"))
    largest = totals.agg(F.max_by("group", F.struct("count", "group")).alias("largest"), F.max(F.when(F.col("group") == "///", F.col("count"))).alias("rest"))
    own = F.when((F.col("group") == "///") & (F.col("rest") < LEAST), F.col("largest")).otherwise(F.col("group"))
    groups = kept(grouped.join(largest, F.lit(True)).select("lang", "source", own.alias("group")))  # with a single row
    cells = counted.where("not base_failed").join(groups, ["lang", "source"]).select("group", *STATISTICS)
    rows = grouped.agg(F.sum("count")).first()[0] or 0
    cells = kept(cells.coalesce(-(-rows // EACH) or 1))
    estimates = robust_estimates(cells)
    judged = _distances(counted.join(groups, ["lang", "source"], "left"), estimates)
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round(distance, 3).alias("distance"), (~F.col("base_failed") & ~F.coalesce(distance > cutoff, F.lit(False))).alias("kept"))
