"""Files put together from what tasks encode, against the whole table."""

import csv
import io
import zipfile
from xml.etree import ElementTree

import pytest

from evidentia.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(30_000).selectExpr("(id * 7919) % 30011 as n", "concat('a,', id, ' \"x\"') as marker", "if(id % 3 = 0, null, concat('é\n', id)) as tissue")
    return rows.repartitionByRange(5, "n").sortWithinPartitions("n")


def read(path):
    return list(csv.reader(io.StringIO(open(path, encoding="utf-8", newline="").read())))


@pytest.mark.parametrize("cap", [None, 0, 1, 1999, 2000, 12_345, 99_999])
def test_csv(table, tmp_path, cap):
    want = [tuple("" if v is None else str(v) for v in r) for r in table.collect()][:cap]
    assert sinks.export_csv(table, f"{tmp_path}/x/a.csv", cap) == len(want)
    got = read(f"{tmp_path}/x/a.csv")
    assert got[0] == ["n", "marker", "tissue"] and list(map(tuple, got[1:])) == want
    assert table.rdd.getNumPartitions() > 1


def test_workbook_of_several_sheets(table, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_SHEET_ROWS", 7_001)
    assert sinks.write_xlsx(table, f"{tmp_path}/a.xlsx", cap=20_500) == 20_500
    got = []
    with zipfile.ZipFile(f"{tmp_path}/a.xlsx") as book:
        assert book.testzip() is None
        for k in (1, 2, 3):
            rows = [[t.text or "" for t in row.iter() if t.tag.endswith("}t")] for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).iter() if row.tag.endswith("}row")]
            assert rows[0] == ["n", "marker", "tissue"] and len(rows) == (7_001 if k < 3 else 6_501)
            got += rows[1:]
        assert [e.get("name") for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")] == ["Markers", "Markers 2", "Markers 3"]
    assert got == [["" if v is None else str(v) for v in r] for r in table.limit(20_500).collect()]


def test_nothing_to_export(spark, tmp_path):
    none = spark.createDataFrame([], "marker string")
    assert sinks.export_csv(none, f"{tmp_path}/a.csv") == sinks.write_xlsx(none, f"{tmp_path}/a.xlsx") == 0
    assert open(f"{tmp_path}/a.csv").read() == "marker\n" and zipfile.ZipFile(f"{tmp_path}/a.xlsx").testzip() is None
    odd = spark.createDataFrame([("\x00<&>\x0b",)], "marker string")
    assert sinks.write_xlsx(odd, f"{tmp_path}/b.xlsx") == 1 and b"&lt;&amp;&gt;" in zipfile.ZipFile(f"{tmp_path}/b.xlsx").read("xl/worksheets/sheet1.xml")
