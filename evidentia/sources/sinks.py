"""Tables as the files that users take away."""

from __future__ import annotations

import csv
import re
import zipfile
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file in a folder: a header, lines that end in CRLF, quotes only where needed, nulls as nothing."""
    texts = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    texts.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", lineSep="\r\n")


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=False, quote="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """A stage's documents as a dataset of its own, read back."""
    path = f"{folder.rstrip('/')}/{stage}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_raw(articles: DataFrame, path: str) -> None:
    """Add downloaded articles (``pmcid``, ``xml``) to the raw table, whose ids are the ledger of what was fetched."""
    articles.write.mode("append").parquet(path)


#: Rows of a ranking that is saved, which is what its question gives at most, and column widths of its workbook in characters.
MOST_RANKED, RANKING_WIDTHS = 10_000, (28, 14, 10)


#: Bytes in a piece of a file (Parquet's reader takes some thousand at once), rows that are encoded at a time, and bytes that the driver holds at a time, all about.
_PIECE, _ENCODED, _HELD = 16 << 10, 2_000, 16 << 20
_CHUNKS = "part int, within long, rows long, ends array<long>, data binary"


class _Lines(list):
    write = list.append


def csv_lines(rows: Iterable[Sequence[str | None]]) -> list[str]:
    """Lines that end in CRLF, with quotes only where needed; nulls as nothing."""
    lines = _Lines()
    csv.writer(lines).writerows(rows)
    return lines


def _chunked(df: DataFrame, lines: Callable[[list[tuple]], list[str]]) -> DataFrame:
    """The rows of a table as pieces of a file, made by the tasks that have them, and written; each with how many rows of its partition are before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, _ENCODED):
                own = batch.slice(a, _ENCODED)
                made = [x.encode() for x in lines(list(zip(*[c.to_pylist() for c in own.columns[1:]], strict=True)))]
                rows = []
                while made:
                    ends = list(accumulate(map(len, made)))
                    k = bisect_right(ends, _PIECE) or 1
                    rows.append((n, k, ends[:k], b"".join(made[:k])))
                    n, made = n + k, made[k:]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([own.column(0).take([0] * len(rows)), *[pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]], ["part", "within", "rows", "ends", "data"])

    texts = df.select(F.spark_partition_id().alias("__part"), *[F.col(f"`{c}`").cast("string") for c in df.columns])
    return write_stage(texts.mapInArrow(run, _CHUNKS), scratch(df.sparkSession), "chunks")


def _joined(chunks: DataFrame, cap: int | None) -> Iterator[tuple[list[int], bytes]]:
    """The pieces in order up to ``cap`` rows: where their rows end, and their bytes.  A few pieces at a time pass the driver.

    Rows before a piece are those of the partitions before and those before it in its own.
    """
    parts = chunks.groupBy("part").agg(F.sum("rows").alias("n"), F.sum(F.octet_length("data")).alias("bytes"))  # a row for each partition
    before = parts.select("part", "bytes", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = chunks.join(before.select("part", "before"), "part").withColumn("start", F.col("before") + F.col("within"))
    if cap is not None:
        placed = placed.where(F.col("start") < cap)
    size = before.agg(F.sum("bytes")).first()[0] or 0
    ordered = placed.repartitionByRange(max(1, size // _HELD), "start").sortWithinPartitions("start")
    for r in ordered.select("start", "ends", "data").toLocalIterator():
        take = len(r["ends"]) if cap is None else min(len(r["ends"]), cap - r["start"])
        yield r["ends"][:take], bytes(r["data"][: r["ends"][take - 1]])


def export_csv(df: DataFrame, path: str, cap: int | None = None, *, lines: Callable[[list[tuple]], list[str]] = csv_lines, mark: bool = False) -> int:
    """One file on the driver's disk with a header and at most ``cap`` rows, in the table's order; the number of rows.

    The rows are encoded by the tasks that have them and cut by their places, so
    that neither a sort nor a cap needs one task for all.
    """
    n = 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as out:
        out.write(("\ufeff" if mark else "").encode() + "".join(lines([tuple(df.columns)])).encode())
        for ends, data in _joined(_chunked(df, lines), cap):
            out.write(data)
            n += len(ends)
    return n


def _ranking_lines(cell_type: int):
    """Quotes only around a cell type with a comma."""
    def lines(rows: list[tuple]) -> list[str]:
        return [",".join(f'"{v}"' if k == cell_type and v and "," in v else v or "" for k, v in enumerate(row)) + "\n" for row in rows]

    return lines


def write_ranking_csv(ranking: DataFrame, path: str) -> int:
    """A ranking as the client saves it, on the driver's disk, at most ``MOST_RANKED`` rows: with a byte order mark, and quotes only around a cell type with a comma."""
    at = ranking.columns.index("cell_type") if "cell_type" in ranking.columns else -1
    return export_csv(ranking, path, MOST_RANKED, lines=_ranking_lines(at), mark=True)


# Names of the workbook format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
#: Characters that XML can't hold.
_BAD_XML = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
_XML = '<?xml version="1.0" encoding="UTF-8"?>'
#: Rows of a sheet, by the format.
_SHEET_ROWS = 1_048_576


def _xml_lines(rows: Iterable[Sequence[str | None]]) -> list[str]:
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD_XML.sub("", v or ""))}</t></is></c>'
    return ["<row>" + "".join(map(cell, row)) + "</row>" for row in rows]


def write_xlsx(df: DataFrame, path: str, sheet: str = "Markers", cap: int | None = 50_000, widths: Sequence[int] = ()) -> int:
    """A workbook on the driver's disk, at most ``cap`` rows in the table's order; ``widths`` of the first columns in characters.

    Rows are encoded by the tasks that have them.  More rows than a sheet can
    have go to further sheets, each with the header.
    """
    head = "".join(_xml_lines([tuple(df.columns)])).encode()
    columns = ("<cols>" + "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1)) + "</cols>") if widths else ""
    opening = f'{_XML}<worksheet xmlns="{_MAIN}">{columns}<sheetData>'.encode() + head
    n, room, sheets, out = 0, 0, 0, None
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:

        def turned():
            nonlocal sheets, room
            if out:
                out.write(b"</sheetData></worksheet>")
                out.close()
            sheets, room = sheets + 1, _SHEET_ROWS - 1
            new = book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True)
            new.write(opening)
            return new

        chunks = _chunked(df, _xml_lines)
        out = turned()
        try:
            for ends, data in _joined(chunks, cap):
                a, first = 0, 0
                while a < len(ends):
                    if not room:
                        out = turned()
                    b = min(len(ends), a + room)
                    out.write(data[first : ends[b - 1]])
                    n, room, first, a = n + b - a, room - (b - a), ends[b - 1], b
            out.write(b"</sheetData></worksheet>")
        finally:
            out.close()
        names = [sheet if k == 1 else f"{sheet} {k}" for k in range(1, sheets + 1)]
        book.writestr("[Content_Types].xml", _XML + _TYPES.format("".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_SHEET_TYPE}"/>' for k in range(1, sheets + 1))))
        book.writestr("_rels/.rels", _XML + _RELATIONS.format(f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>'))
        book.writestr("xl/_rels/workbook.xml.rels", _XML + _RELATIONS.format("".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, sheets + 1))))
        listed = "".join(f'<sheet name="{escape(x)}" sheetId="{k}" r:id="rId{k}"/>' for k, x in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')
    return n
