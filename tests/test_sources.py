import csv
import glob
import zipfile
from xml.etree import ElementTree

from evidentia.sources import files, remote, sinks
from evidentia.sources.jats import article, first_id, parse_articles, split_set
from evidentia.streaming.ingest import ingest_articles

XML = """<article xmlns:x="urn:x"><front><article-meta><article-id pub-id-type="pmid">11</article-id><article-id pub-id-type="pmcid">PMC5</article-id>
<article-id pub-id-type="pmcaid">7</article-id><title-group><article-title>A <i>title</i> here</article-title></title-group><journal-title>J</journal-title>
<pub-date date-type="pub"><year>2001</year></pub-date><pub-date pub-type="ppub"><year> 1999 </year></pub-date>
<abstract><p>Some text<xref ref-type="bibr">3</xref>, more<fig><p>hidden</p></fig> tail.</p></abstract></article-meta></front>
<body><sec sec-type="materials|methods"><title>Methods and more</title><p>How.</p></sec><sec><title>Results and discussion</title><p>What <xref ref-type="fig">1</xref>.</p></sec><sec><title>2. Results</title><p>Not this.</p></sec>
<table-wrap><label>Table 1</label><caption><p>Cap</p></caption><table><thead><tr><th>a|b</th><th>c</th></tr></thead><tbody><tr><td>1</td></tr><tr><td>2</td><td>3</td><td>4</td></tr></tbody></table></table-wrap></body></article>"""


def test_article():
    a = article(XML)
    assert (a["pmcid"], a["pmid"], a["title"], a["journal"], a["year"]) == ("7", "11", "A title here", "J", 1999)
    assert a["abstract"] == "Some text, more tail." and a["results"] == "Results and discussion What 1." and a["methods"] == "Methods and more How."
    assert a["tables_md"].split("\n") == ["**Table 1: Cap**", "| a/b | c |", "| --- | --- |", "| 1 |  |", "| 2 | 3 |"]
    assert first_id(XML) == "5"


def test_broken_articles():
    assert article(XML.replace("</abstract>", ""))["title"] == "A title here"
    assert article("") is None and article(None) is None and article("no element") is None
    assert article("<article><article-title>x")["title"] == "x"
    assert article(XML.replace("1999", "19xx"))["year"] == 2001
    assert len(split_set(f"<set>{XML}{XML}</set>")) == 2 and split_set("<set>") == []
    long = "<table-wrap><table>" + "<tr><td>x</td></tr>" * 60 + "</table></table-wrap>"
    lines = article(f"<article><body>{long}</body></article>")["tables_md"].split("\n")
    assert len(lines) == 1 + 1 + 1 + 50 + 1 and "truncated" in lines[-1]


def test_parse_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/PMC1.xml").write_text(XML)
    (tmp_path / "in/PMC2.xml").write_text("junk")
    (tmp_path / "in/other.xml").write_text(XML)
    raw = files.articles(spark, f"{tmp_path}/in")
    got = parse_articles(raw).collect()
    assert len(got) == 1 and got[0].clean_text.startswith("[Abstract]\nSome text") and got[0].char_count == len(got[0].clean_text)
    run = lambda: ingest_articles(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination(60)
    assert run() and spark.read.parquet(f"{tmp_path}/out").count() == 1
    (tmp_path / "in/PMC3.xml").write_text(XML.replace(">7<", ">8<"))
    assert run() and sorted(r.pmcid for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["7", "8"]


def test_remote(spark):
    pages = lambda start, size: None if start == 1000 else [str(i) for i in range(start, min(start + size, 1203))]
    ids = remote.search_ids(spark, 1203, pages, rate=1e6, wait=0.0)
    assert ids.count() == 1000
    fetch = lambda wanted: "<set>" + "".join(f'<article><article-id pub-id-type="pmc">{i}</article-id></article>' for i in wanted if i != "13") + "</set>"
    some = ids.where("cast(pmcid as int) < 120")
    got = remote.fetch_articles(some, fetch, rate=1e6, wait=0.0)
    assert got.count() == 119 and [r.pmcid for r in remote.missing(some, got).collect()] == ["13"]
    assert remote.patiently(lambda: 1 / 0, wait=0.0) is None


def test_tables_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None, 'say "x"'), ("<c>", "d", "é")], "marker string, tissue string, title string").coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/csv")
    text = open(glob.glob(f"{tmp_path}/csv/*.csv")[0], newline="", encoding="utf-8").read()
    assert text == 'marker,tissue,title\r\n"a,b",,"say ""x"""\r\n<c>,d,é\r\n'
    assert sinks.write_xlsx(df, f"{tmp_path}/book.xlsx") == 2
    with zipfile.ZipFile(f"{tmp_path}/book.xlsx") as book:
        sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
        assert [t.text for t in sheet.iter() if t.tag.endswith("}t")] == ["marker", "tissue", "title", "a,b", None, 'say "x"', "<c>", "d", "é"]
    sinks.write_tsv(df.select("marker"), f"{tmp_path}/tsv")
    assert list(csv.reader(open(glob.glob(f"{tmp_path}/tsv/*.csv")[0], encoding="utf-8"), delimiter="\t"))[1] == ["<c>"]
    assert sinks.write_stage(df, str(tmp_path), "stage").count() == 2
    ranking = spark.createDataFrame([("a, b", "X", 2), ("c", None, 1)], "cell_type string, marker string, count int").coalesce(1)
    assert sinks.write_ranking_csv(ranking, f"{tmp_path}/ranking.csv") == 2
    assert open(f"{tmp_path}/ranking.csv", encoding="utf-8").read() == '\ufeffcell_type,marker,count\n"a, b",X,2\nc,,1\n'
    for _ in range(2):
        sinks.append_raw(df, f"{tmp_path}/raw")
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 4
    sinks.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "genes.tsv").write_text('symbol\tstatus\textra\talias_symbol\nCD3D\tApproved\t"q\tT3D|X\n')
    assert tuple(files.nomenclature(spark, f"{tmp_path}/genes.tsv").first()) == ("CD3D", "Approved", "T3D|X", None)
    (tmp_path / "ledger.txt").write_text("1\n2\n\n 2 \n")
    assert sorted(r.pmcid for r in files.ledger(spark, f"{tmp_path}/ledger.txt").collect()) == ["1", "2"]
    (tmp_path / "PMC1.json").write_text('{\n "pmcid": "1",\n "markers": [{"cell_type": "T", "marker": "A"}]\n}')
    from evidentia.schema import EXTRACTED

    assert files.documents(spark, str(tmp_path), EXTRACTED).first().markers[0].marker == "A"
