"""Pages and name searches from their tables, against the star's own answers, and what they read."""

import pytest
from pyspark.sql import functions as F

from evidentia.catalog import driver_star
from evidentia.plans.listing import Listing, NameIndex, grams_of
from evidentia.plans.star import Filters

TABLES = "/root/testdata/sf0.01"


def rows_read(df):
    """Rows that the file scans of a query gave on."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") else plan
    todo = [plan]
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith(("AdaptiveSparkPlan",)):
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return sum(found)


@pytest.fixture(scope="module")
def star(spark):
    return driver_star(spark, TABLES, cited=True)


@pytest.fixture(scope="module")
def listing(star, tmp_path_factory):
    return Listing.write(star, f"{tmp_path_factory.mktemp('listing')}/l", partitions=7)


def test_pages(star, listing):
    assert listing.total == star.entries.count() and len(listing.files) == 7
    whole = [tuple(r) for r in listing.rows.orderBy("place").select(*star.search().columns).collect()]
    edge = listing.before[3] // 20 + 1  # spans two files
    for page in (1, 2, edge, listing.total // 20 + 1):
        assert [tuple(r) for r in listing.page(page).collect()] == whole[20 * page - 20 : 20 * page]
    for page in (1, 4):
        assert [tuple(r) for r in listing.page(page, 200).collect()] == [tuple(r) for r in star.search(page=page, page_size=200).collect()]
    assert listing.page(10**9).count() == 0
    with pytest.raises(ValueError):
        listing.page(0)


def test_a_late_page_reads_no_more_than_an_early_one(listing):
    files = sorted(n for n in (listing.before[k + 1] - listing.before[k] for k in range(7)))
    read = [rows_read(listing.page(p)) for p in (1, listing.total // 40, listing.total // 20 - 1)]
    assert max(read) <= 2 * files[-1] and min(read) > 0


def test_continuation(star, listing):
    asked = Filters(cell_type=("NATION_0", "NATION_3"), marker="bolt")
    whole = [tuple(r) for r in star.search(asked, page_size=200).collect()]
    key, got = None, []
    for _ in range(5):
        rows = listing.after(key, asked, 40).collect()
        got += [tuple(r)[: len(whole[0])] for r in rows]
        key = rows[-1]
    assert got == whole
    last = listing.rows.orderBy(F.desc("place")).first()
    assert listing.after(last).count() == 0


def test_grams():
    assert grams_of("CD3") == ["cd3"] and grams_of("aB%cdEf_gh") == ["cde", "def"]
    assert grams_of("ab%cd") is None and grams_of("") is None and grams_of("abc\\%d") is None


def test_name_index(spark, star, tmp_path):
    index = NameIndex.write(star, f"{tmp_path}/names", ["marker", "cell_type"])
    for text in ("bolt 31", "BOLT%1_", "all gizmo", "no such", "t%9", "zz%zzz", "NATION"):
        asked = Filters(marker=text)
        few = index.narrowed(star, {"marker": text})
        key = lambda df: sorted(map(str, df.collect()))
        assert key(few.search(asked, page_size=200)) == key(star.search(asked, page_size=200)) and few.total(asked).first() == star.total(asked).first()
    few = index.narrowed(star, {"marker": "bolt 31"})
    like = star.markers.where("symbol ilike '%bolt 31%'").count()
    assert few.markers.count() == like < star.markers.count()
    counts = lambda s: [tuple(r)[:3] for r in s.ranking(20, cell_type="ation_1").collect()]
    assert counts(index.narrowed(star, {"cell_type": "ation_1"})) == counts(star)
    assert index.narrowed(star, {"marker": "t%9"}) is star
