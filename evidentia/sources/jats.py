"""Articles in XML as rows of metadata, sections, tables and text.

Mixed content needs the tree itself, which Spark's XML reader and XPath
functions do not keep, so each article is parsed by a function inside the
tasks.  A text that isn't well-formed is read tolerantly; one that holds no
element gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import MOST_TOKENS, PER_TOKEN, assembled, estimated_tokens

MOST_ROWS = 50
# Elements without text of their own, elements that end a line, section names.
SILENT = {"fig", "graphic", "inline-graphic", "media", "inline-formula", "disp-formula", "tex-math"}
BLOCKS = {"p", "sec", "title", "abstract", "list-item", "caption"}
RESULTS = re.compile(r"(?i)(results?|findings?|results?\s+and\s+discussion)")
METHODS = re.compile(r"(?i)(methods?|materials?\s+and\s+methods?|experimental\s+procedures?)")
_PLAIN = re.compile(r"\{[^}]*\}")


class _Tolerant(HTMLParser):
    """Builds a tree from tags that may be unclosed or overlap."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.builder, self.open = ElementTree.TreeBuilder(), []

    def handle_starttag(self, tag, attrs):
        if self.open or not self.builder_closed():
            self.builder.start(tag, {k: v or "" for k, v in attrs})
            self.open.append(tag)

    def builder_closed(self):
        return getattr(self, "done", False)

    def handle_endtag(self, tag):
        while tag in self.open:
            last = self.open.pop()
            self.builder.end(last)
            self.done = not self.open
            if last == tag:
                break

    def handle_data(self, data):
        if self.open:
            self.builder.data(data)

    def tree(self, text: str):
        self.feed(text)
        self.close()
        while self.open:
            self.builder.end(self.open.pop())
        return self.builder.close()


def tree_of(xml: str | bytes | None) -> ElementTree.Element | None:
    """The root of an article, names without namespaces; None if there is none."""
    if not xml:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        try:
            root = _Tolerant().tree(xml.decode("utf-8", "replace") if isinstance(xml, bytes) else xml)
        except (AssertionError, IndexError, ElementTree.ParseError):
            return None
    if root is None:
        return None
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = _PLAIN.sub("", e.tag)
            for name in [k for k in e.attrib if k.startswith("{")]:
                e.set(_PLAIN.sub("", name), e.attrib.pop(name))
    return root


def _pieces(root: ElementTree.Element) -> Iterator[str]:
    """Text in document order, with what follows an element also where the element itself is passed over."""
    todo: list[ElementTree.Element | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
            continue
        todo.append(x.tail or "")
        cited = x.tag == "xref" and x.get("ref-type") == "bibr"
        if x.tag in SILENT or cited:
            continue
        todo.append("\n" if x.tag in BLOCKS else "")
        todo.extend(reversed(x))
        todo.append(x.text or "")


def text_of(e: ElementTree.Element | None) -> str:
    return " ".join("".join(_pieces(e)).split()) if e is not None else ""


def _rows(table: ElementTree.Element) -> list[list[str]]:
    parts = [p for p in (table.find("thead"), table.find("tbody")) if p is not None]
    lines = [tr for p in parts for tr in p.findall("tr")] if parts else table.findall(".//tr")
    rows = [[text_of(c).replace("|", "/") for c in tr if c.tag in ("th", "td")] for tr in lines]
    return [r for r in rows if r]


def markdown(wrap: ElementTree.Element, most: int = MOST_ROWS) -> str:
    """A table with its label and caption; rows have the width of the first."""
    table = wrap.find(".//table")
    rows = _rows(table) if table is not None else []
    if not rows:
        return ""
    caption = text_of(wrap.find(".//caption"))
    title = (text_of(wrap.find("label")) + (f": {caption}" if caption else "")).rstrip()
    width, line = len(rows[0]), lambda cells: f"| {' | '.join(cells)} |"
    shown = [line((r + [""] * width)[:width]) for r in rows[: most + 1]]
    out = [f"**{title}**", shown[0], line(["---"] * width), *shown[1:]]
    if len(rows) > most + 1:
        out.append(f"| *(truncated — >{most} rows)* |")
    return "\n".join(out)


def _sections(body: ElementTree.Element | None, named: re.Pattern) -> str:
    def fits(sec: ElementTree.Element) -> bool:
        title = sec.find("title")
        return bool(named.match(sec.get("sec-type", ""))) or title is not None and bool(named.match((title.text or "").strip()))

    return "\n\n".join(text_of(s) for s in (body.findall("sec") if body is not None else []) if fits(s))


def _year(root: ElementTree.Element) -> int | None:
    for kind in ("epub", "ppub", "pub", "collection"):
        for name in ("pub-type", "date-type"):
            date = root.find(f".//pub-date[@{name}='{kind}']")
            if date is not None:
                year = (date.findtext("year") or "").strip()
                if year.isdecimal():
                    return int(year)
                break
    return None


def article(xml: str | bytes | None, table_rows: int = MOST_ROWS) -> dict | None:
    """Ids (the last of each kind), title, journal, year, sections and tables of an article."""
    root = tree_of(xml)
    if root is None:
        return None
    ids = {}
    for e in root.iter("article-id"):
        value = (e.text or "").strip()
        kind = e.get("pub-id-type", "")
        ids["pmcid" if kind in ("pmc", "pmcaid", "pmcid") else kind] = value.removeprefix("PMC") if kind == "pmcid" else value
    body = root.find(".//body")
    return {
        "pmcid": ids.get("pmcid"),
        "pmid": ids.get("pmid"),
        "title": text_of(root.find(".//article-title")) or "Untitled",
        "journal": text_of(root.find(".//journal-title")) or "Unknown",
        "year": _year(root),
        "abstract": text_of(root.find(".//abstract")),
        "results": _sections(body, RESULTS),
        "methods": _sections(body, METHODS),
        "tables_md": "\n\n".join(t for t in (markdown(w, table_rows) for w in root.iterfind(".//table-wrap")) if t),
    }


_PARSED = "pmcid string, pmid string, title string, journal string, year int, abstract string, results string, methods string, tables_md string"


def _parse(table_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for x in batch["xml"] if (r := article(x, table_rows)) is not None]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _PARSED.split(", ")])
            yield out.assign(year=out["year"].astype("Int32"))

    return run


def parse_articles(raw: DataFrame, xml_col: str = "xml", *, text_tokens: int = MOST_TOKENS, table_rows: int = MOST_ROWS) -> DataFrame:
    """Processed documents of a column of XML (text or bytes): texts of at most so many tokens, tables of at most so many rows."""
    parsed = raw.select(F.col(xml_col).alias("xml")).mapInPandas(_parse(table_rows), _PARSED)
    whole = parsed.withColumn("clean_text", assembled(F.col("abstract"), F.col("tables_md"), F.col("results"), F.col("methods"), text_tokens * PER_TOKEN))
    return whole.withColumns({"char_count": F.length("clean_text"), "estimated_tokens": estimated_tokens(F.col("clean_text"))})


def first_id(xml: str) -> str | None:
    """The first id of an article, as a download is filed under."""
    root = tree_of(xml)
    for e in root.iter("article-id") if root is not None else ():
        if e.get("pub-id-type") in ("pmc", "pmcaid", "pmcid") and (e.text or "").strip():
            value = e.text.strip()
            return value.removeprefix("PMC") if e.get("pub-id-type") == "pmcid" else value
    return None


def split_set(xml: str | None) -> list[str]:
    """The articles of a set, each as XML of its own; none if the set can't be read."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    return [ElementTree.tostring(e, encoding="unicode") for e in root.iter("article")]
