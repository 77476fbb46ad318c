"""Texts and small values derived from documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .names import strip

#: Characters of a token, tokens of a text, and characters below which a section isn't begun.
PER_TOKEN, MOST_TOKENS, TOO_LITTLE = 4, 10_000, 200


def one_line(c: Column) -> Column:
    """White space of any kind as single spaces."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def cell(c: Column) -> Column:
    """Text that can stand in a cell of a Markdown table."""
    return one_line(F.translate(c, "|", "/"))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / PER_TOKEN).cast("int")


def assembled(abstract: Column, tables: Column, results: Column, methods: Column, budget: int = MOST_TOKENS * PER_TOKEN) -> Column:
    """Named sections in their order as long as the budget of characters lasts; the one that exceeds it is cut.

    With no more than ``TOO_LITTLE`` characters left no further section begins.
    """
    parts = F.array(*[F.when(c != "", F.concat(F.lit(f"[{name}]\n"), c)) for name, c in (("Abstract", abstract), ("Tables", tables), ("Results", results), ("Methods", methods))])
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(budget).alias("left"))

    def add(s: Column, part: Column) -> Column:
        room, whole = s["left"] > TOO_LITTLE, F.length(part) <= s["left"]
        taken = F.when(whole, part).otherwise(F.concat(F.substring(part, F.lit(1), s["left"]), F.lit(" ...")))
        left = F.when(~room, s["left"]).when(whole, s["left"] - F.length(part)).otherwise(F.lit(0))
        return F.struct(F.when(room, F.concat(s["taken"], F.array(taken))).otherwise(s["taken"]).alias("taken"), left.alias("left"))

    return strip(F.array_join(F.aggregate(F.array_compact(parts), start, add)["taken"], "\n\n"))


def prompt(pmid: Column, title: Column, text: Column) -> Column:
    """What a model is asked about a paper."""
    return F.concat(F.lit("PMID: "), F.coalesce(pmid, F.lit("")), F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def strict_key(cell_type: Column, marker: Column) -> Column:
    """Key of an entry: type in lower case, symbol in upper case; null without a symbol."""
    return let(F.upper(strip(marker)), lambda m: F.when(m != "", F.struct(F.lower(strip(F.coalesce(cell_type, F.lit("")))).alias("cell_type"), m.alias("marker"))))


def link(pmcid: Column, base: str = "https://www.ncbi.nlm.nih.gov/pmc/articles/") -> Column:
    return F.concat(F.lit(base), pmcid, F.lit("/"))


def short_label(c: Column, longest: int = 20, cut: int = 18) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, cut), F.lit("…"))).otherwise(c)


def status_class(status: Column) -> Column:
    """Display class of a marker's status."""
    classes = {"approved": "success", "corrected": "warning", "ambiguous": "danger", "unknown": "info"}
    out = F.lit("info")
    for name, kind in classes.items():
        out = F.when(status == name, kind).otherwise(out)
    return out


def shown_number(n: Column) -> Column:
    return F.coalesce(F.format_number(n, 0), F.lit("—"))


def cache_key(filters: Column) -> Column:
    """A key for a map of filters; the order of its fields doesn't matter, that of their values does."""
    return F.md5(F.to_json(F.array_sort(F.map_entries(filters))).cast("binary"))
