import json
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from evidentia.config import Settings
from evidentia.operators import entries, extraction
from evidentia.plans import responses, store
from evidentia.sources import files, remote, sinks
from evidentia.streaming import ingest

ROWS = "pmcid string, cell_type string, cell_subtype string, marker string, tissue string, disease string"


def given(spark, more=()):
    rows = [("P1", "T cell", None, "CD3D", "Blood", "Normal"), ("P2", "T cell", "naive", "CD3D", None, "Normal"), ("P2", "B cell", "naive", "CD19", "Blood", None), (None, "X", None, "Y", None, None), ("P4", "T cell", None, " ".strip(), None, None), *more]
    papers = spark.createDataFrame([(p, f"id{p}", f"about {p}") for p in ("P1", "P2", "P3", "P4")], "pmcid string, pmid string, title string")
    return spark.createDataFrame(rows, ROWS), papers


def test_star_in_two_sessions(spark, tmp_path):
    folder = f"{tmp_path}/star"
    assert store.read_star(spark, folder) is None
    assert store.add_to_star(*given(spark), folder) == 1
    other = spark.newSession()
    assert store.add_to_star(*given(other, [("P3", "T cell", None, "CD4", None, None)]), folder) == 2
    star = store.read_star(other, folder)
    assert star.entries.count() == 4 and star.markers.count() == 3 and star.papers.count() == 3
    assert {r.symbol: r.citation_count for r in star.markers.collect()} == {"CD3D": 2, "CD19": 1, "CD4": 1}
    assert store.read_star(spark, folder, 1).entries.count() == 3
    assert store.add_to_star(*given(spark), folder) == 3 and store.read_star(spark, folder).entries.count() == 4
    bad = other.read.parquet(f"{folder}/quarantine").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in bad} == {"no paper": 3, "no marker": 3}


def test_a_save_that_breaks_off_leaves_the_old_star(spark, tmp_path):
    folder = f"{tmp_path}/star"
    store.add_to_star(*given(spark), folder)
    star = store.read_star(spark, folder)
    broken = type(star)(**{**star.__dict__, "papers": star.papers.selectExpr("*", "raise_error('broken') as x")})
    with pytest.raises(Exception):
        store.save_star(broken, folder)
    assert store.read_star(spark, folder).entries.count() == 3 and store.versions(spark, folder).count() == 1


def test_answers(spark, tmp_path):
    store.add_to_star(*given(spark), f"{tmp_path}/star")
    star = store.read_star(spark, f"{tmp_path}/star")
    one = lambda df: json.loads(df.first().json)
    page = one(responses.search_response(star))
    assert (page["total"], page["page"], page["page_size"], len(page["results"])) == (3, 1, 20, 3) and page["results"][0]["marker"] == "CD3D" and None in [r["tissue"] for r in page["results"]]
    assert one(responses.ranking_response(star))["results"][0] == {"symbol": "CD3D", "citation_count": 2, "cell_type_count": 1, "cell_types": ["T cell"], "tissues": ["Blood"], "diseases": ["Normal"]}
    assert one(responses.types_response(star))["total"] == 2 and one(responses.facets_response(star))["subtypes"] == ["naive", "naive"]
    start = one(responses.initial_response(star))
    assert set(start) == {"filters", "search", "bubble"} and start["bubble"][0]["count"] == 2
    board = one(responses.dashboard_response(star))
    assert board["overview"]["total_entries"] == 3 and board["distribution"]["tissues"] == [{"name": "Blood", "count": 2}]
    detail = one(responses.detail_response(star, "CD3D"))
    assert detail["total_entries"] == 2 and len(detail["entries"]) == 2 and responses.detail_response(star, "none").count() == 0


def test_resumable_download(spark, tmp_path):
    raw = f"{tmp_path}/raw"
    pages = lambda start, size: [str(i) for i in range(start, min(start + size, 30))]
    ids = remote.search(spark, lambda: 30, pages, page=10, rate=1e6, wait=0.0)
    fetch = lambda wanted: "<set>" + "".join(f'<article><article-id pub-id-type="pmc">{i}</article-id></article>' for i in wanted if i != "13") + "</set>"
    assert remote.download(ids, fetch, raw, limit=20, rate=1e6, wait=0.0).count() == 11
    left = remote.download(ids, fetch, raw, rate=1e6, wait=0.0)
    assert [r.pmcid for r in left.collect()] == ["13"] and remote.fetched(spark, raw).count() == 29
    with pytest.raises(ConnectionError):
        remote.search(spark, lambda: 1 / 0, pages, wait=0.0)


def test_cached_nomenclature(spark, tmp_path):
    calls = []
    text = lambda: calls.append(1) or "symbol\tstatus\talias_symbol\tprev_symbol\nCD3D\tApproved\tT3D\t\n"
    for _ in range(2):
        assert files.cached_nomenclature(spark, f"{tmp_path}/genes", text).first().symbol == "CD3D"
    assert calls == [1]


def test_validation_run_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([("1", "11", "T", "good"), ("2", None, "T", "bad"), ("3", "33", None, "odd")], "pmcid string, pmid string, title string, clean_text string")

    def model(works):
        def ask(text):
            if "bad" in text and not works:
                raise ValueError(text)
            return ("no json" if "odd" in text and not works else '{"markers": []}'), {}

        return ask

    assert extraction.validation_run(docs, model(False), f"{tmp_path}/v", wait=0.0) == {"asked": 3, "answered": 1, "failed": 2}
    assert sorted(r.pmcid for r in extraction.failures(spark, f"{tmp_path}/v").collect()) == ["2", "3"]
    assert extraction.validation_run(docs, model(True), f"{tmp_path}/v", wait=0.0) == {"asked": 2, "answered": 2, "failed": 0}
    assert extraction.failures(spark, f"{tmp_path}/v").count() == 0
    assert extraction.validation_run(docs, model(True), f"{tmp_path}/v", wait=0.0) == {"asked": 0, "answered": 0, "failed": 0}


def test_settings():
    assert Settings.from_environment({}) == Settings()
    s = Settings.from_environment({"EVIDENTIA_RATE": "3", "EVIDENTIA_KEEP_STATUS": "no", "EVIDENTIA_BATCH": " 7 ", "OTHER": "x"})
    assert (s.rate, s.keep_status, s.batch) == (3.0, False, 7)
    with pytest.raises(ValueError, match="EVIDENTIA_PAGE"):
        Settings.from_environment({"EVIDENTIA_PAGE": "many"})


def test_batches_of_a_wide_table_that_is_written(spark, tmp_path):
    wide = spark.range(3_000_000).selectExpr("id * 7919 % 3000017 as id", "repeat(md5(cast(id as string)), 2) as text").repartition(12)
    entries.batches(wide, "id", 50).write.parquet(f"{tmp_path}/numbered")
    sizes = spark.read.parquet(f"{tmp_path}/numbered").groupBy("batch").agg({"id": "count"}).withColumnRenamed("count(id)", "n")
    assert {(r.n, r["count"]) for r in sizes.groupBy("n").count().collect()} == {(50, 60_000)}


def test_ranking_workbook_has_widths(spark, tmp_path):
    import zipfile

    sinks.write_xlsx(spark.createDataFrame([("a", "b", 1)], "`Cell Type` string, Marker string, Citations int"), f"{tmp_path}/r.xlsx", widths=sinks.RANKING_WIDTHS)
    sheet = zipfile.ZipFile(f"{tmp_path}/r.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert '<col min="1" max="1" width="28" customWidth="1"/>' in sheet and sheet.index("<cols>") < sheet.index("<sheetData>")


def _rows(spark, pairs):
    """Entries of (paper, marker), and their papers."""
    rows = [(p, "T cell", None, m, None, "Normal") for p, m in pairs]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame([(p, "1", p) for p in sorted({p for p, _ in pairs}, key=str)], "pmcid string, pmid string, title string")


def _shown(star):
    named = star.entries.join(star.papers.select(col("id").alias("paper_id"), "pmcid"), "paper_id").join(star.markers.select(col("id").alias("marker_id"), "symbol"), "marker_id")
    return sorted((r.pmcid, r.symbol) for r in named.collect()), {r.symbol: r.citation_count for r in star.markers.collect()}


def _counts(pairs):
    return {m: len({p for p, x in pairs if x == m}) for m in {m for _, m in pairs}}


def _bytes(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_a_load_writes_what_is_new(spark, tmp_path):
    folder = f"{tmp_path}/star"
    many = [(f"P{i % 3000}", f"M{i % 997}") for i in range(30_000)]
    few = [(f"P{i}", f"M{i % 10}") for i in range(2990, 3050)]
    store.add_to_star(*_rows(spark, many), folder)
    first = _bytes(f"{folder}/data")
    store.add_to_star(*_rows(spark, few), folder)
    assert _bytes(f"{folder}/data") - first < first / 10
    star = store.read_star(spark, folder)
    shown = _shown(star)
    assert shown == (sorted({*many, *few}), _counts({*many, *few}))
    assert {r.id: r.citation_count for r in star.refreshed_markers().collect()} == {r.id: r.citation_count for r in star.markers.collect()}
    raised = spark.read.parquet(*[f"{folder}/data/{x}" for x in store.version_of(spark, folder).folders["counts"][1:]])
    new = {m for p, m in few if (p, m) not in set(many)}
    assert raised.count() == len(new) < 997
    assert _shown(store.read_star(spark, folder, 1)) == (sorted(set(many)), _counts(set(many)))
    assert store.read_star(spark, folder, 9) is None


def test_nothing_new_is_written_as_nothing(spark, tmp_path):
    folder = f"{tmp_path}/star"
    for _ in range(2):
        store.add_to_star(*_rows(spark, [("P1", "A")]), folder)
    one, two = (store.version_of(spark, folder, k) for k in (1, 2))
    assert one.folders == two.folders


def test_two_writers(spark, tmp_path):
    """Both begin from the same version; the second takes from its rows what the first has added."""
    folder = f"{tmp_path}/star"
    store.add_to_star(*_rows(spark, [("P0", "A")]), folder)
    both = threading.Barrier(2, timeout=120)
    halves = [[("P1", "A"), ("P2", "B"), ("P3", "C")], [("P1", "A"), ("P1", "B"), ("P4", "C"), ("P0", "A")]]

    def write(pairs):
        return store.add_to_star(*_rows(spark, pairs), folder, between=lambda k: both.wait() if k == 0 else None)

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(write, halves)) == [2, 3]
    pairs = {("P0", "A"), *halves[0], *halves[1]}
    assert _shown(store.read_star(spark, folder)) == (sorted(pairs), _counts(pairs))


def test_compact_and_expire(spark, tmp_path):
    folder = f"{tmp_path}/star"
    loads = [[("P1", "A"), ("P2", "B")], [("P2", "A")], [("P9", "C")]]
    for pairs in loads:
        store.add_to_star(*_rows(spark, pairs), folder)
    store._write({"markers": store.read_star(spark, folder).markers}, folder, "broken-off")
    want = sorted(p for x in loads for p in x)
    assert store.compact(spark, folder) == 4
    assert {len(x) for x in store.version_of(spark, folder).folders.values()} == {1}
    assert _shown(store.read_star(spark, folder)) == (want, _counts(want))
    assert store.expire(spark, folder, keep=1, hours=1) == 0 and store.versions(spark, folder).count() == 1
    assert store.expire(spark, folder, keep=1, hours=0) == 4
    assert _shown(store.read_star(spark, folder)) == (want, _counts(want))
    store.add_to_star(*_rows(spark, [("P1", "A"), ("P7", "A")]), folder)
    assert _shown(store.read_star(spark, folder))[1] == {"A": 3, "B": 1, "C": 1}


def test_two_names_with_one_key_stop_a_load(spark, tmp_path, monkeypatch):
    from evidentia.operators import load as loading

    monkeypatch.setattr(loading, "_key", lambda *parts: F.length(parts[0]).cast("long"))
    with pytest.raises(Exception, match="two names have the key"):
        store.add_to_star(*_rows(spark, [("P1", "A"), ("P1", "B")]), f"{tmp_path}/star")
    assert store.read_star(spark, f"{tmp_path}/star") is None
    store.add_to_star(*_rows(spark, [("P1", "A")]), f"{tmp_path}/star")
    with pytest.raises(Exception, match="another name for the key"):
        store.add_to_star(*_rows(spark, [("P1", "B")]), f"{tmp_path}/star")


def test_stream_into_star_exactly_once(spark, tmp_path, monkeypatch):
    folder, mark, source = (f"{tmp_path}/{x}" for x in ("star", "mark", "in"))
    schema = ROWS + ", pmid string, title string"
    put = lambda pairs: _rows(spark, pairs)[0].selectExpr("*", "'1' as pmid", "pmcid as title").coalesce(1).write.mode("append").json(source)

    def run():
        ingest.stream_into_star(spark.readStream.schema(schema).json(source), folder, mark).awaitTermination(120)

    put([("P1", "A"), (None, "A")])
    run()
    real = store._publish
    for stop_after in (False, True):
        put([("P2" if stop_after else "P3", "A"), (None, "B")])

        def stopped(*args, after=stop_after):
            if after:
                real(*args)
            raise RuntimeError("stopped")

        monkeypatch.setattr(store, "_publish", stopped)
        with pytest.raises(Exception, match="stopped"):
            run()
        monkeypatch.setattr(store, "_publish", real)
        run()
    assert _shown(store.read_star(spark, folder)) == ([("P1", "A"), ("P2", "A"), ("P3", "A")], {"A": 3})
    assert store.version_of(spark, folder).batches == {"entries": 2} and store.versions(spark, folder).count() == 3
    assert spark.read.parquet(f"{folder}/quarantine").count() == 3


def test_tables_of_a_load_are_made_of_different_entries(spark, tmp_path, monkeypatch):
    rows, papers = given(spark)
    monkeypatch.setattr(store, "delete", lambda *_: None)
    store.add_to_star(rows.union(rows).union(rows), papers, f"{tmp_path}/star")
    assert spark.read.parquet(f"{tmp_path}/star/staged/*/different").count() == 3
    assert spark.read.parquet(f"{tmp_path}/star/quarantine").count() == 6 and store.read_star(spark, f"{tmp_path}/star").entries.count() == 3


def test_batches_of_a_stream_have_files_by_rows(spark, tmp_path, monkeypatch):
    from evidentia import catalog_rules

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    usual = sorted(catalog_rules.loaded_from_stream(spark, sf).collect())
    monkeypatch.setattr(catalog_rules, "PART_ROWS", -(-rows // 12), raising=False)
    monkeypatch.setattr(catalog_rules, "scratch", lambda _: str(tmp_path))
    assert sorted(catalog_rules.loaded_from_stream(spark, sf).collect()) == usual
    assert len(list(Path(tmp_path, "in").glob("*.parquet"))) == 12 and store.versions(spark, f"{tmp_path}/star").count() == 3
