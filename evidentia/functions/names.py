"""Standard forms of the names of cell types, subtypes, tissues, diseases and markers, as column expressions.

They are meant for the distinct values of a column, which ``normalized`` joins
back: names repeat, and a chain of lookups for each row would be wasted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.sinks import write_stage
from .bind import let
from .vocabulary import DEFAULT, Vocabulary

#: Signs that are written in one way.
_QUOTES, _DASHES, _GONE = "‘’“”", "‐‑‒–—―−﹣－", "­�"
LONGEST_MARKER = 30
NOWHERE, HEALTHY = "Not specified", "Normal"


def strip(c: Column) -> Column:
    """Without white space of any kind around."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    return strip(F.regexp_replace(c, "  +", " "))


def clean(c: Column) -> Column:
    """One form of quotes, dashes and blanks; null if nothing is left."""
    plain = F.translate(c, _QUOTES + _DASHES + "_" + _GONE, "''\"\"" + "-" * len(_DASHES) + " ")
    done = squeezed(F.regexp_replace(plain, r"[\x00-\x1f]+", " "))
    return let(done, lambda d: F.when(d != "", d))


def capitalized(c: Column) -> Column:
    """With a first letter that is not lower case; the rest untouched."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def _is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def _in(c: Column, values: Iterable[str]) -> Column:
    return c.isin(sorted(values))


def _lookup(table: dict[str, str]) -> Callable[[Column], Column]:
    entries = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    return lambda key: F.try_element_at(entries, key)


def singular_cell(c: Column) -> Column:
    """Cells become a cell; stem cells, and names in -cytes, -blasts or -phages, stay."""
    low, shorter = F.lower(c), F.substring(c, F.lit(1), F.length(c) - 1)
    stays = low.endswith("cytes") | low.endswith("blasts") | low.endswith("phages")
    return F.when(low.endswith("cells") & ~low.endswith("stem cells"), shorter).when(stays, c).when(low.endswith("mas") & ~low.endswith("smas"), shorter).otherwise(c)


def singular_disease(c: Column) -> Column:
    low = F.lower(c)
    plural = low.endswith("omas") | low.endswith("syndromes") | low.endswith("neoplasms")
    return F.when(plural, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def before_slash(c: Column) -> Column:
    """The first of several names, with the last word of the last where the first, in lower case, lacks it."""
    def chosen(parts: Column) -> Column:
        first, tail = strip(parts[0]), F.filter(F.split(strip(F.element_at(parts, -1)), r"(?U)\s+"), lambda w: w != "")
        lacks = (F.size(tail) > 1) & _is_lower(F.substring(first, 1, 1)) & ~first.endswith("cell")
        return F.when(first == "", c).when(lacks, F.concat_ws(" ", first, F.element_at(tail, -1))).otherwise(first)

    return F.when(F.contains(c, F.lit("/")), let(F.split(c, "/"), chosen)).otherwise(c)


def polarity_and_type(c: Column) -> Column:
    """Positive and negative as signs, numbers of types as Roman numerals."""
    c = F.regexp_replace(c, r"(?U)[\s-]+positive\b,?\s*", "+ ")
    c = F.regexp_replace(c, r"(?U)[\s-]+negative\b,?\s*", "- ")
    for digit, numeral in enumerate(("I", "II", "III", "IV", "V"), 1):
        c = F.regexp_replace(c, rf"(?Ui)\btype\s+{digit}\b", f"type {numeral}")
    return squeezed(F.regexp_replace(c, r"(?Ui)\btype\s+(\d)\b", "type $1"))


def _found(text: Column, table: dict[str, str]) -> Column:
    """The canonical name of a text or of what its variants give: singular, with or without "cell", without hyphens."""
    get = _lookup(table)

    def variants(key: Column) -> Column:
        suffix = F.when(key.endswith(" cell"), strip(F.substring(key, F.lit(1), F.length(key) - 5))).otherwise(F.concat(key, F.lit(" cell")))
        hyphen = F.contains(key, F.lit("-"))
        spaced = F.when(hyphen, squeezed(F.replace(key, F.lit("-"), F.lit(" "))))
        joined = F.when(hyphen, F.replace(key, F.lit("-"), F.lit("")))
        return F.coalesce(get(key), get(suffix), get(spaced), get(joined))

    return F.coalesce(get(F.lower(text)), let(F.lower(singular_cell(text)), variants), capitalized(singular_cell(text)))


def cell_type(c: Column, v: Vocabulary = DEFAULT) -> Column:
    """Standard cell type; null where an entry is to be dropped."""
    def standard(t: Column) -> Column:
        return F.when(~_in(F.lower(t), v.no_cell_types), _found(t, v.cell_types))

    return let(polarity_and_type(before_slash(clean(c))), standard)


def subtype(c: Column, v: Vocabulary = DEFAULT) -> Column:
    """Standard subtype, null where there is none."""
    def standard(t: Column) -> Column:
        return F.when(~_in(F.lower(t), v.no_subtypes) & ~F.rlike(t, F.lit(r"(?i)\(general\)")), _found(t, v.subtypes))

    return let(polarity_and_type(before_slash(clean(c))), standard)


def tissue(c: Column, v: Vocabulary = DEFAULT) -> Column:
    """Standard tissue, null for what is none."""
    def standard(t: Column) -> Column:
        rest = let(strip(F.regexp_replace(t, r"(?Ui)\s+tissues?$", "")), lambda r: F.when(r != "", capitalized(r)))
        return F.when(~_in(F.lower(t), v.no_tissues | v.tissue_diseases), F.coalesce(_lookup(v.tissues)(F.lower(t)), rest))

    return let(clean(c), standard)


def disease(c: Column, v: Vocabulary = DEFAULT) -> Column:
    """Standard disease in American spelling; what is no disease is normal."""
    def standard(t: Column) -> Column:
        spelled = t
        for british, american in v.spellings.items():
            spelled = F.regexp_replace(spelled, f"(?i){british}", american)
        get = _lookup(v.diseases)
        return F.when(_in(F.lower(t), v.no_diseases), HEALTHY).otherwise(let(spelled, lambda s: F.coalesce(get(F.lower(s)), get(F.lower(singular_disease(s))), capitalized(singular_disease(s)))))

    return let(clean(c), lambda t: F.when(t.isNotNull(), standard(t)))


def marker(c: Column, v: Vocabulary = DEFAULT) -> Column:
    """A symbol as it stands, null if it can't be one."""
    return let(strip(c), lambda t: F.when((t != "") & ~_in(F.lower(t), v.no_markers) & ~F.contains(t, F.lit(" ")) & (F.length(t) <= LONGEST_MARKER), t))


def demoted(kind: Column, sub: Column, v: Vocabulary = DEFAULT) -> Column:
    """A struct of cell type and subtype in which kinds of a broader type stand as its subtypes."""
    out = F.struct(kind.alias("cell_type"), sub.alias("cell_subtype"))
    for suffix, parent in reversed(v.parents.items()):
        broader = F.lower(kind).endswith(f" {suffix}") & (F.lower(kind) != parent.lower())
        out = F.when(broader, F.struct(F.lit(parent).alias("cell_type"), F.coalesce(sub, kind).alias("cell_subtype"))).otherwise(out)
    return out


RULES: dict[str, Callable[[Column, Vocabulary], Column]] = {"cell_type": cell_type, "cell_subtype": subtype, "marker": marker, "tissue": tissue, "disease": disease}


def standard_names(entries: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``field``, ``name`` and its ``standard`` for every different name in the five fields, in one pass over the entries."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in RULES])
    names = entries.select(F.explode(each).alias("x")).select("x.*").where("name is not null").distinct()
    standard = reduce(lambda done, f: done.when(F.col("field") == f, RULES[f](F.col("name"), v)), list(RULES)[1:], F.when(F.col("field") == "cell_type", cell_type(F.col("name"), v)))
    return names.withColumn("standard", standard)


def normalized(entries: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Entries (``cell_type, cell_subtype, marker, tissue, disease`` and more) with standard names; entries without type or marker go.

    Different names are standardised once, written, and joined back.
    """
    table = write_stage(standard_names(entries, v), scratch(entries.sparkSession), "names")
    df = entries
    for f in RULES:
        known = table.where(F.col("field") == f).select(F.col("name").alias(f), F.col("standard").alias("__standard"))
        df = df.join(known, f, "left").drop(f).withColumnRenamed("__standard", f)
    df = df.where("cell_type is not null and marker is not null")
    df = df.withColumn("__pair", demoted(F.col("cell_type"), F.col("cell_subtype"), v))
    standard = {"cell_type": F.col("__pair.cell_type"), "cell_subtype": F.col("__pair.cell_subtype"), "tissue": F.coalesce("tissue", F.lit(NOWHERE)), "disease": F.coalesce("disease", F.lit(HEALTHY))}
    return df.withColumns(standard).select(entries.columns)
