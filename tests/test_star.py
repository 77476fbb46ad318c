"""Facets in one pass and firsts of groups, against their plain definitions."""

import random
import re

from pyspark.sql import functions as F

from evidentia.plans.star import FIELDS, Filters, Star, best_first, least_first


def random_star(spark, n=400):
    r = random.Random(4)
    dims = {f: [(i, f"{f[:2]}{i % 5}") for i in range(6)] for f in FIELDS}
    rows = [(k, *[r.choice([None, *range(8)]) if f in ("tissue", "disease", "cell_subtype") else r.randrange(8) for f in FIELDS], 0, 0) for k in range(n)]
    entries = spark.createDataFrame(rows, "id long, cell_type_id int, cell_subtype_id int, tissue_id int, disease_id int, marker_id int, paper_id int")
    tables = {f: spark.createDataFrame(d, "id int, name string") for f, d in dims.items()}
    none = spark.createDataFrame([], "id int, symbol string, citation_count long, pmid string, pmcid string")
    star = Star(entries=entries, markers=none, papers=none, cell_types=tables["cell_type"], cell_subtypes=tables["cell_subtype"].withColumn("cell_type_id", F.lit(1)), tissues=tables["tissue"], diseases=tables["disease"])
    return star, [dict(zip(FIELDS, [dict(dims[f]).get(x) for f, x in zip(FIELDS, row[1:5], strict=True)], strict=True)) for row in rows]


def test_facets(spark, tmp_path):
    star, rows = random_star(spark)
    star.entries.write.parquet(f"{tmp_path}/entries")
    star = Star(**{**star.__dict__, "entries": spark.read.parquet(f"{tmp_path}/entries")})
    for asked in ({"cell_type": ["ce1"]}, {"tissue": ["ti0", "ti2"], "disease": ["di3"]}, {f: [f"{f[:2]}1", f"{f[:2]}2"] for f in FIELDS}, {"cell_subtype": ["no such"]}):
        passes = lambda row, but: all(row[g] in values for g, values in asked.items() if g != but)
        want = sorted({(f, row[f]) for f in FIELDS for row in rows if row[f] is not None and passes(row, f)})
        got = star.facets(Filters(**asked, marker="ignored"))
        assert [(r.field, r.value) for r in got.collect()] == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1  # the entries


def test_least_first(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "b"]), r.choice([None, 1, 2, 3]), i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o int, i int, x double")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(least_first(["k"], ["o"], df), best_first(["k"], ["o", "i"], df))
    with_map = df.withColumn("m", F.create_map("i", "x"))
    assert least_first(["k"], ["o", "i"], with_map).columns == with_map.columns and same(least_first(["k"], ["o", "i"], with_map), best_first(["k"], ["o", "i"], with_map))


def test_entries_of_the_driver_are_dealt_by_rows(spark, monkeypatch):
    from evidentia import catalog
    from evidentia.plans import star

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    usual = sorted(catalog.QUERIES["bubble"](spark, sf).collect())
    monkeypatch.setattr(star, "PART_ROWS", -(-rows // 37))
    for name in ("bubble", "citation_refresh", "marker_ranking"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert ", 37), REPARTITION_BY_NUM" in plan
    assert sorted(catalog.QUERIES["bubble"](spark, sf).collect()) == usual


def test_page_is_ordered_before_it_is_named(spark):
    star, _ = random_star(spark)
    entries = star.entries.withColumns({"marker_id": F.col("id") % 7, "paper_id": F.col("id") % 5, "marker_status": F.lit("s")})
    markers = spark.createDataFrame([(i, f"m{i}", i // 2) for i in range(6)], "id int, symbol string, citation_count long")
    papers = spark.createDataFrame([(i, str(i), f"PMC{i}") for i in range(4)], "id int, pmid string, pmcid string")
    star = Star(**{**star.__dict__, "entries": entries, "markers": markers, "papers": papers})
    plan = star.search(page=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("GlobalLimit")].count("Join ") == 4  # subtypes, tissues, diseases, papers
    every = star.listed(cited=True).orderBy(F.desc("citation_count"), "marker", "cell_type", *star.order)
    asked = Filters(tissue=("ti1", "ti2"), marker="1")
    some = every.where(F.col("tissue").isin("ti1", "ti2") & F.col("marker").ilike("%1%"))
    for found, whole in ((star.search(page=3, page_size=30), every.offset(60).limit(30)), (star.search(asked, page_size=200), some.limit(200))):
        got = [tuple(r) for r in found.collect()]
        assert got and got == [tuple(r) for r in whole.select(found.columns).collect()]


def test_first_view_is_made_of_dealt_entries(spark, monkeypatch):
    from evidentia import catalog
    from evidentia.plans import responses, star

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(star, "PART_ROWS", -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 37))
    plan = responses.initial_response(catalog.driver_star(spark, sf, cited=True))._jdf.queryExecution().executedPlan().toString()
    assert ", 37), REPARTITION_BY_NUM" in plan


def test_marker_joins_of_a_counted_star_are_dealt_by_rows(spark, monkeypatch):
    """The first view is the same, and no exchange of entries by marker or by pair and paper is left for Spark to merge."""
    from evidentia import catalog
    from evidentia.plans import responses, star

    sf = "/root/testdata/sf0.001"
    before = responses.initial_response(catalog.driver_star(spark, sf, cited=True)).first().json
    monkeypatch.setattr(star, "PART_ROWS", -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 37))
    view = responses.initial_response(catalog.driver_star(spark, sf, cited=True))
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(marker_id#\w+, 37\), REPARTITION_BY_NUM", plan)
    assert re.search(r"hashpartitioning\(cell_type#\w+, marker#\w+, paper_id#\w+, 37\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"hashpartitioning\(cell_type#\w+, marker#\w+, paper_id#\w+, \d+\), ENSURE_REQUIREMENTS", plan)
    assert view.first().json == before
