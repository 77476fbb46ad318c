import json

from pyspark.sql import functions as F

from evidentia.functions import documents as texts
from evidentia.operators import compare, entries, extraction, genes, hierarchy
from evidentia.operators.load import load
from evidentia.plans import views
from evidentia.plans.star import Filters

FIVE = "cell_type string, cell_subtype string, marker string, tissue string, disease string"


def test_genes(spark):
    table = spark.createDataFrame([("CD3D", "Approved", "T3D", None), ("AAA1", "Approved", "DUP", ""), ("BBB1", "Approved", "x|dup ", "OLD1"), ("ZZZ", "Withdrawn", "WAS", None)], "symbol string, status string, alias_symbol string, prev_symbol string")
    given = ["cd3d", "T3D", "DUP", "XYZ9", None, "  ", "old1", "WAS"]
    out = genes.standardized(spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, marker string"), table).orderBy("i").collect()
    assert [(r.marker, r.marker_status) for r in out] == [("CD3D", "approved"), ("CD3D", "corrected"), ("DUP", "ambiguous"), ("XYZ9", "unknown"), ("", "unknown"), ("  ", "unknown"), ("BBB1", "corrected"), ("WAS", "unknown")]
    assert [r.marker_original for r in out[1:4]] == ["T3D", "DUP", None]
    missing = genes.unmapped(spark.createDataFrame(out))
    assert [tuple(r) for r in missing.collect()] == [("WAS", 1), ("XYZ9", 1)]


def test_hierarchy(spark):
    rows = [("1", 0, "T cell", "X"), ("1", 1, "T cell", "X"), ("1", 2, "Other", "X"), ("2", 0, "X", "X"), ("2", 1, "P", "P"), ("2", 2, "P", "C"), ("2", 3, "Z", "Z"), ("3", 0, "A", "tie"), ("2", 4, "B", "tie"), ("4", 0, "tie", "tie"), ("4", 1, "Q", None)]
    got = {(r.pmcid, r.pos): (r.cell_type, r.cell_subtype) for r in hierarchy.resolved(spark.createDataFrame(rows, "pmcid string, pos int, cell_type string, cell_subtype string")).collect()}
    assert got["2", 0] == ("T cell", "X") and got["2", 1] == ("P", None) and got["2", 3] == ("Z", None) and got["4", 0] == ("B", "tie") and got["4", 1] == ("Q", None)
    assert len(got) == len(rows)


def test_comparison(spark):
    schema = f"pmcid string, pos int, {FIVE}"
    o = spark.createDataFrame([("1", 0, "T cell", None, "CD3D", None, None), ("1", 1, "T cell", None, "CD3E", None, None), ("1", 2, "B cell", None, "MS4A1", None, None), ("1", 3, "B cell", None, "", None, None)], schema)
    r = spark.createDataFrame([("1", 0, "t cell", None, "cd3d", "Blood", None), ("1", 1, "NK cell", None, "NKG7", None, None)], schema)
    x = compare.compared(o, r).first()
    assert (x.original, x.reference, x.matched, x.precision, x.recall, x.f1, x.gene_precision, x.gene_recall) == (3, 2, 1, 0.3333, 0.5, 0.4, 0.3333, 0.5)
    assert (x.tissue_agreement, x.disease_agreement) == (0.0, 1.0) and len(x.only_in_original) == 2 and x.only_in_reference[0].marker == "NKG7"
    s = compare.summary(compare.compared(o, r)).first()
    assert s.papers == 1 and s.avg_f1 == 0.4 and s.low_quality == 1
    assert [tuple(x) for x in compare.low_quality_papers(compare.compared(o, r)).collect()] == [("1", 0.4)]


def replies():
    items = [{"cell_type": " T cell ", "marker": "CD3D", "tissue": 5, "disease": ""}, "text", {"cell_type": "B cell"}, {"cell_type": "B cell", "marker": "  "}, {"cell_type": "NK", "marker": 7}, None, {"cell_type": None, "marker": "X"}]
    return [("1", json.dumps({"markers": items})), ("2", "not json"), ("3", json.dumps({"markers": []})), ("4", json.dumps({"other": 1}))]


def test_parsed_replies(spark):
    got = entries.parsed(spark.createDataFrame(replies(), "pmcid string, reply string")).orderBy("pos").collect()
    assert [tuple(r)[:5] for r in got] == [("1", 0, "T cell", None, "CD3D"), ("1", 3, "B cell", None, None), ("1", 4, "NK", None, None)]
    assert (got[0].tissue, got[0].disease) == (None, None)


def test_extraction_with_a_model_that_fails(spark):
    docs = spark.createDataFrame([("1", "11", "T", "good"), ("2", None, "T", "bad"), ("3", "33", None, "good")], "pmcid string, pmid string, title string, clean_text string")

    def model(text):
        if "bad" in text:
            raise ValueError(text)
        assert text.startswith("PMID: ")
        return json.dumps({"markers": [{"cell_type": "T cell", "marker": "CD4"}, 3]}), {"total_tokens": 9}

    done = extraction.extracted(extraction.ask(docs, model, wait=0.0))
    got = done.orderBy("pmcid").collect()
    assert [(r.pmcid, r.raw_marker_count, r.valid_marker_count, r.usage.total_tokens) for r in got] == [("1", 2, 1, 9), ("3", 2, 1, 9)]
    assert [r.pmcid for r in extraction.pending(docs, done).collect()] == ["2"]
    totals = entries.run_totals(done).first()
    assert tuple(totals) == (2, 2, 18, 1.0)


def test_first_wins_and_batches(spark):
    rows = [("1", k, *x) for k, x in enumerate([("T", None, "A", None, "d"), ("T", None, "A", None, "d"), ("T", "s", "A", None, "d")])] + [("2", 0, "T", None, "A", None, "d")]
    df = spark.createDataFrame(rows, f"pmcid string, pos int, {FIVE}")
    assert sorted((r.pmcid, r.pos) for r in entries.first_entries(df).collect()) == [("1", 0), ("1", 2), ("2", 0)]
    assert {r.pmcid: len(r.markers) for r in entries.gathered(df).collect()} == {"1": 3, "2": 1}
    ids = spark.range(0, 205).selectExpr("lpad(id, 5, '0') as pmcid").repartition(7)
    got = {r.pmcid: r.batch for r in entries.batches(ids, "pmcid", 50).collect()}
    assert got == {f"{i:05d}": i // 50 for i in range(205)}
    assert entries.sampled(ids, "pmcid").count() == 10 and entries.sampled(ids.limit(0), "pmcid").count() == 0
    assert entries.sampled(ids, "pmcid").collect() == entries.sampled(ids.repartition(3), "pmcid").collect()
    assert entries.accounting(df, df.where("pos = 0")).first() == (4, 2, 2)


def small_star(spark, existing=None, more=()):
    rows = [("P1", "T cell", None, "CD3D", "Blood", "Normal"), ("P1", "T cell", None, "CD3D", "Blood", "Normal"), ("P2", "T cell", "naive", "CD3D", None, "Normal"), ("P2", "B cell", "naive", "CD_19", "Blood", None), ("P3", "B cell", "", "CD3E", "Lung", "CRC"), (None, "X", None, "Y", None, None), ("P4", "", None, "Y", None, None), *more]
    papers = spark.createDataFrame([(p, f"id{p}", f"about {p}") for p in ("P1", "P2", "P3", "P4", "P9")], "pmcid string, pmid string, title string")
    return load(spark.createDataFrame(rows, "pmcid string, cell_type string, cell_subtype string, marker string, tissue string, disease string"), papers, existing)


def test_load_is_idempotent(spark):
    star = small_star(spark)
    assert star.entries.count() == 4 and star.papers.count() == 3 and star.cell_subtypes.count() == 2
    again = small_star(spark, star, [("P9", "T cell", None, "CD3D", "Blood", "Normal")])
    assert again.entries.count() == 5 and again.markers.count() == 3 and again.papers.count() == 4
    assert {r.symbol: r.citation_count for r in again.markers.collect()} == {"CD3D": 3, "CD_19": 1, "CD3E": 1}
    assert {r.marker_status for r in again.entries.collect()} == {"approved"}


def test_questions(spark):
    star = small_star(spark)
    assert [r.marker for r in star.search().collect()] == ["CD3D", "CD3D", "CD3E", "CD_19"]
    assert star.total(Filters(marker="cd_1")).first().total == 1 and star.total(hint=7).first().total == 7
    assert star.total(Filters(marker="CD_")).first().total == 4
    assert star.total(Filters(cell_type=("T cell",), tissue=("Blood",))).first().total == 1
    detail = star.detail("CD3D").first()
    assert (detail.total, detail.citation_count, detail.cell_subtypes, detail.tissues) == (2, 2, ["naive"], ["Blood"]) and star.detail("none").count() == 0
    facets = {(r.field, r.value) for r in star.facets(Filters(cell_type=("T cell",))).collect()}
    assert ("cell_type", "B cell") in facets and ("tissue", "Lung") not in facets and ("disease", "CRC") not in facets
    assert star.facets().where("field = 'cell_subtype' and value = 'naive'").count() == 2
    assert [tuple(r)[:3] for r in star.types().collect()] == [("B cell", 2, 2), ("T cell", 1, 2)]
    assert star.ranking(1, cell_type="t c").first().cell_types == ["T cell"]
    assert star.export().where("tissue = ''").count() == 1 and star.overview().first().total_entries == 4
    kept = views.reconciled({"cell_type": ["T cell"], "tissue": ["Lung"], "cell_subtype": [], "disease": []}, lambda s: star.facets(Filters(cell_type=tuple(s["cell_type"]), tissue=tuple(s["tissue"]))))
    assert kept["cell_type"] == [] or kept["tissue"] == []
    plan = star.facets(Filters(cell_type=("T cell",)))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    assert "TakeOrdered" in star.search(page=2)._jdf.queryExecution().executedPlan().toString()


def test_page_limits(spark):
    import pytest

    star = small_star(spark)
    for call in (lambda: star.search(page=0), lambda: star.search(page_size=201), lambda: star.ranking(501), lambda: star.bubble(limit=9), lambda: star.total(hint=-1)):
        with pytest.raises(ValueError):
            call()


def test_small_texts(spark):
    row = spark.createDataFrame([("1" * 25, None)], "a string, n long")
    got = row.select(texts.short_label(F.col("a")), texts.shown_number(F.col("n")), texts.status_class(F.lit("corrected")), texts.link(F.lit("PMC1")), texts.cell(F.lit(" a|b  c ")), texts.cache_key(F.create_map(F.lit("b"), F.array(F.lit("2")), F.lit("a"), F.array(F.lit("1")))) == texts.cache_key(F.create_map(F.lit("a"), F.array(F.lit("1")), F.lit("b"), F.array(F.lit("2"))))).first()
    assert tuple(got) == ("1" * 18 + "…", "—", "warning", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC1/", "a/b c", True)


def test_articles_to_star(spark, tmp_path):
    from evidentia.plans.build import build_star

    article = "<article><article-id pub-id-type='pmc'>{0}</article-id><article-id pub-id-type='pmid'>9{0}</article-id><article-title>T{0}</article-title><abstract>{1}</abstract></article>"
    raw = spark.createDataFrame([(article.format(1, "one"),), (article.format(2, "two"),), ("junk",)], "xml string")
    said = {
        "one": [{"cell_type": "T cells", "marker": "T3D", "tissue": "PBMC"}, {"cell_type": "T cells", "marker": "cd3d", "tissue": "PBMC"}, {"cell_type": "CD8+ T cell", "marker": "CD8A"}],
        "two": [{"cell_type": "T cell", "marker": "CD3D"}, "no object", {"cell_type": "Tumor cells", "marker": "X"}],
    }

    def model(prompt):
        return json.dumps({"markers": said["one" if "one" in prompt else "two"]}), {"total_tokens": 1}

    table = spark.createDataFrame([("CD3D", "Approved", "T3D", ""), ("CD8A", "Approved", "", "")], "symbol string, status string, alias_symbol string, prev_symbol string")
    star = build_star(raw, model, table, str(tmp_path))
    listed = {(r.marker, r.cell_type, r.cell_subtype, r.tissue, r.pmcid, r.marker_status) for r in star.search().collect()}
    assert listed == {("CD3D", "T cell", None, "Blood", "1", "corrected"), ("CD8A", "T cell", "CD8+ T cell", "Not specified", "1", "approved"), ("CD3D", "T cell", None, "Not specified", "2", "approved")}
    assert {r.symbol: r.citation_count for r in star.markers.collect()} == {"CD3D": 2, "CD8A": 1}


def test_unreadable_replies(spark):
    assert sorted(r.pmcid for r in entries.unreadable(spark.createDataFrame(replies(), "pmcid string, reply string")).collect()) == ["2", "4"]


def test_sample_is_cut_in_one_group_of_digests(spark):
    import hashlib
    import re

    ids = spark.range(5000).selectExpr("id", "'x' as more").repartition(7)
    for share in (0.0, 0.3, 1.0):
        found = entries.sampled(ids, "id", share, seed=3)
        want = sorted(range(5000), key=lambda i: (hashlib.md5(f"3|{i}".encode()).hexdigest(), i))[: max(1, int(5000 * share))]
        assert [r.id for r in found.collect()] == want and found.columns == ["id", "more"]
        assert all(int(n) < 10 for n in re.findall(r"limit=(\d+)", found._jdf.queryExecution().executedPlan().toString()))
    same = spark.range(50).selectExpr("cast(null as long) as id")
    assert entries.sampled(same, "id", 0.5).count() == 25


def test_a_load_reads_its_input_once(spark, tmp_path):
    from evidentia import catalog_rules

    fields = "pmcid string, cell_type string, cell_subtype string, marker string, tissue string, disease string"
    spark.createDataFrame([("P1", "T cell", None, "CD3D", None, "Normal"), ("P2", "T cell", " ", "CD3D", None, "Normal")] * 50, fields).write.parquet(f"{tmp_path}/given")
    papers = spark.createDataFrame([("P1", "1", "a"), ("P2", "2", "b")], "pmcid string, pmid string, title string")
    star = load(spark.read.parquet(f"{tmp_path}/given"), papers)
    assert (star.entries.count(), star.papers.count(), star.markers.first().citation_count) == (2, 2, 2)
    twice = catalog_rules._loaded(spark, "/root/testdata/sf0.001")
    read = [f for s in (star, twice) for df in (s.entries, s.markers, s.cell_types, s.cell_subtypes, s.tissues, s.diseases, s.papers) for f in df.inputFiles()]
    assert read and not any("/given/" in f or "lineitem" in f for f in read)
