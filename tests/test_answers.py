"""Kept answers: no job the second time, stale after a load, too old after a while."""

import json

import pytest

from evidentia.config import Settings
from evidentia.plans import answers, store
from evidentia.plans.star import Filters

ROWS = "pmcid string, cell_type string, cell_subtype string, marker string, tissue string, disease string"


def load(spark, folder, pairs):
    entries = spark.createDataFrame([(p, "T cell", None, m, None, None) for p, m in pairs], ROWS)
    store.add_to_star(entries, entries.selectExpr("pmcid", "'1' as pmid", "'t' as title").distinct(), folder)


def jobs_of(spark, call):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        return call(), len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_kept_until_a_load(spark, tmp_path):
    folder = f"{tmp_path}/star"
    with pytest.raises(FileNotFoundError):
        answers.search_answer(spark, folder)
    load(spark, folder, [("P1", "A"), ("P2", "A")])
    clock = [1000.0]
    ask = lambda **x: answers.search_answer(spark, folder, Filters(marker="a"), now=lambda: clock[0], **x)
    total = lambda df: json.loads(df.first().json)["total"]
    first, n = jobs_of(spark, ask)
    assert n > 0 and total(first) == 2
    again, n = jobs_of(spark, ask)
    assert n == 0 and total(again) == 2
    other, n = jobs_of(spark, lambda: ask(page=2))
    assert n > 0 and total(other) == 2
    load(spark, folder, [("P3", "A")])
    fresh, n = jobs_of(spark, ask)
    assert n > 0 and total(fresh) == 3
    clock[0] += answers.TIME_TO_LIVE
    assert jobs_of(spark, ask)[1] > 0 and jobs_of(spark, ask)[1] == 0
    assert total(answers.search_answer(spark, folder, Filters(marker="zz"))) == 0
    assert answers.forget_old(spark, folder) == 1 and jobs_of(spark, ask)[1] == 0


def test_settings_bound_pages_and_exports(spark, tmp_path):
    folder = f"{tmp_path}/star"
    load(spark, folder, [(f"P{i}", f"M{i}") for i in range(9)])
    small = Settings(page_size=3, most_per_page=5, export_cap=4)
    assert len(json.loads(answers.search_answer(spark, folder, settings=small).first().json)["results"]) == 3
    assert len(json.loads(answers.search_answer(spark, folder, page_size=5, settings=small).first().json)["results"]) == 5
    with pytest.raises(ValueError):
        answers.search_answer(spark, folder, page_size=6, settings=small)
    assert answers.export_answer(spark, folder, settings=small).count() == 4
    assert set(json.loads(answers.initial_answer(spark, folder).first().json)) == {"filters", "search", "bubble"}


def test_keys():
    a = answers.question_key({"tissue": ["x", "y"], "page": 1, "marker": ""})
    assert a == answers.question_key({"page": 1, "tissue": ("x", "y")}) != answers.question_key({"page": 1, "tissue": ["y", "x"]})
