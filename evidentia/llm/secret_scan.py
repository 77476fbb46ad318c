"""Operator 4: secrets in texts, by DataFrame functions alone.

A Boolean query over trigrams is derived from the syntax tree of each rule's
pattern: conjunctions of trigrams, one of which any text with a match holds.

The inverted index has, for each of these trigrams and each block of about
``BLOCK`` documents, the sorted keys of the block's documents that hold it.  The
lists of a conjunction's trigrams are intersected block by block, and documents
of any conjunction of a rule are its candidates.  The pattern itself runs on the
candidates alone; rules without a mandatory trigram run on all texts.

Scale.  A text's trigrams are found in one pass of one pattern, and only keys of
documents that hold any are exchanged.  A list is as long as a block at most,
however common its trigram.  Candidates then meet their texts by key: where they
are few Spark sends them to the texts, else the texts are exchanged once.
"""

from __future__ import annotations

import itertools
import re
import re._constants as sre
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let, running_sums


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``least``: characters that ``group`` (0: the match) must have, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
#: Documents in a block of the index, about.
BLOCK = 4096
#: Strings that stand for a sub-pattern are listed up to this number; beyond it the sub-pattern is taken as any text.
_LISTED = 12


def _strings(node, fold: bool) -> list[str] | None:
    """All strings of one item of a parsed pattern in lower case, if they are few."""
    kind, value = node
    if kind is sre.LITERAL:
        return [chr(value).lower()]
    if kind is sre.IN and all(k is sre.LITERAL for k, _ in value):
        found = sorted({chr(v).lower() for _, v in value})
        return found if len(found) <= _LISTED else None
    if kind is sre.SUBPATTERN:
        return _all_strings(value[3], fold)
    if kind is sre.BRANCH:
        options = [_all_strings(x, fold) for x in value[1]]
        found = None if None in options else sorted(set(itertools.chain(*options)))
        return found if found and len(found) <= _LISTED else None
    if kind is sre.MAX_REPEAT and value[1] <= 1:
        inner = _all_strings(value[2], fold)
        return None if inner is None else sorted({*inner, *([""] if value[0] == 0 else [])})
    return None


def _all_strings(items, fold: bool) -> list[str] | None:
    found = [""]
    for item in items:
        own = _strings(item, fold)
        if own is None or len(found) * len(own) > _LISTED:
            return None
        found = [a + b for a in found for b in own]
    return found


def _runs(items) -> list[list[str]]:
    """Alternatives for each stretch of a pattern that is a few fixed strings; each stretch must occur."""
    runs, now = [], [""]
    for item in items:
        own = _strings(item, True)
        if own is not None and len(now) * len(own) <= _LISTED:
            now = [a + b for a in now for b in own]
            continue
        runs.append(now)
        if own is not None:
            now = own
            continue
        now = [""]
        if item[0] is sre.SUBPATTERN:
            runs += _runs(item[1][3])
        elif item[0] is sre.MAX_REPEAT and item[1][0] >= 1:
            runs += _runs(item[1][2])
    return [*runs, now]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of lower-case trigrams, one of which any text with a match holds; none if no trigram is mandatory."""
    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    queries = [[frozenset()]]
    for options in _runs(parser.parse(pattern)):
        own = [grams(x) for x in options]
        if all(own) and len(queries[-1]) * len(own) <= 2 * _LISTED:
            queries.append([a | b for a in queries[-1] for b in own])
    return sorted(set(queries[-1]), key=sorted) if all(queries[-1]) else []


def gram_pattern(grams: Sequence[str]) -> str:
    """A pattern that finds each of some strings wherever it begins, also within another; strings with a common beginning share it."""

    def tree(rest: Sequence[str]) -> str:
        if rest == [""]:
            return ""
        options = [re.escape(c) + tree(sorted({x[1:] for x in rest if x[0] == c})) for c in sorted({x[0] for x in rest})]
        return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"

    return f"(?=({tree(sorted(set(grams)))}))"


def _key(id_: str | Column, text: str | Column) -> Column:
    """What a row is known by; rows that agree in id and text have one key."""
    return F.struct(F.xxhash64(id_, text).alias("a"), F.xxhash64(F.lit(1), id_, text).alias("b"))


def trigram_index(texts: DataFrame, grams: Sequence[str], blocks: int) -> DataFrame:
    """``block``, ``gram``, ``keys``: the documents (``key``, ``text``) of a block that hold a trigram, sorted."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(gram_pattern(grams)), F.lit(1)))
    postings = texts.select("key", F.explode(held).alias("gram"))
    return postings.groupBy(F.pmod("key.a", F.lit(blocks)).alias("block"), "gram").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``key``, ``kinds``: the rules for which a document meets a conjunction of trigrams."""
    terms = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("conjunction"), F.lit(len(grams)).alias("size"), F.lit(g).alias("gram")) for kind, query in queries.items() for n, grams in enumerate(query) for g in sorted(grams)])
    asked = index.select("block", "gram", "keys", F.explode(F.filter(terms, lambda t: t["gram"] == F.col("gram"))).alias("t"))
    lists = asked.groupBy("block", "t.kind", "t.conjunction", "t.size").agg(F.collect_list("keys").alias("lists")).where(F.size("lists") == F.col("size"))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return lists.select("kind", F.explode(both).alias("key")).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def secret_candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The candidates of the rules that have a trigram query: ``key``, ``kinds``."""
    queries = {rule.kind: query for rule in rules if (query := trigram_query(rule.pattern))}
    grams = sorted({g for query in queries.values() for part in query for g in part})
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", _key("id", "text"))
    if not grams:
        return texts.select("key", F.array().cast("array<string>").alias("kinds")).limit(0)
    return candidates(trigram_index(texts.select("key", "text"), grams, -(-docs.count() // BLOCK) or 1), queries)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs of the rule's matches that are long enough: start, order, end, kind."""
    whole = F.lit(rule.pattern)
    size = lambda x: F.length(x).cast("long")
    matches = F.regexp_extract_all(text, whole, F.lit(0))
    measured = matches if rule.group == 0 else F.regexp_extract_all(text, whole, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    joined = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), measured.alias("part"))

    def place(zipped: Column) -> Column:
        ends = running_sums(F.transform(zipped, lambda z: size(z["piece"]) + F.coalesce(size(z["match"]), F.lit(0).cast("long"))))
        spans = F.zip_with(zipped, ends, lambda z, e: F.struct((e - size(z["match"])).alias("start"), F.lit(order).alias("order"), e.alias("end"), F.lit(rule.kind).alias("kind"), size(z["part"]).alias("size")))
        return F.transform(F.filter(spans, lambda s: s["size"] >= rule.least), lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"]))

    return let(joined, place)


_NONE = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the id and ``found``: the matches (start, order, end, kind) by start, then in the order of the rules.

    Matches of one rule are leftmost and don't overlap; those that are too short
    are dropped after matching.  Positions are code points, the end exclusive.
    Null and empty texts have none.  Rows with the same id or without one are
    searched each for itself.  A text of any length is one row.  Other columns
    are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    if any(queries.values()):
        texts = texts.withColumn("key", _key("id", "text")).join(secret_candidates(docs, rules, id_col=id_col, text_col=text_col), "key", "left")
    found = []
    for order, rule in enumerate(rules):
        # A character class repeated without bound: asking for its least length at once gives the same matches.
        quick = F.rlike("text", F.lit(rule.pattern[:-1] + f"{{{rule.least},}}")) if rule.group == 0 and rule.pattern.endswith("]+") else F.rlike("text", F.lit(rule.pattern))
        possible = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if queries[rule.kind] else quick
        found.append(F.when(possible, _spans(F.col("text"), rule, order)).otherwise(F.array().cast(_NONE)))
    return texts.select(F.col("id").alias(id_col), F.array_sort(F.concat(*found)).alias("found"))


def secret_digests(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs, rules).select("doc_id", *[count(k) for k in base], F.sha2(said(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
