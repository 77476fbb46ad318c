"""Every registered query of the library against its SQL on the smallest tables, and the entry file."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


def test_queries_match_their_sql(spark):
    from evidentia import catalog

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    wrong = []
    for name, query in catalog.QUERIES.items():
        df = query(spark, SF)
        got = _rows(df.columns, df.collect())
        if sql := catalog.ORACLE_SQL.get(name):
            done = con.execute(sql)
            names = [d[0] for d in done.description]
            if sorted(names) != sorted(df.columns) or got != _rows(names, done.fetchall()):
                wrong.append(name)
    assert wrong == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["marker", "cell_type"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_halves_hold_all_entries(spark):
    from evidentia import catalog

    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    old, new = catalog._halves(spark, SF)
    assert old.count() > 0 and new.count() > 0 and old.count() + new.count() == rows
    added = catalog.QUERIES["null_safe_dedup"](spark, SF).collect()
    assert len({r.cell_type for r in added}) > 1 and any(r.cell_subtype is None for r in added) and any(r.tissue is None for r in added)


def test_assembled_texts_are_whole(spark, tmp_path):
    from evidentia import catalog

    rows = [(1, "x" * 3000 + "y", "en", "s"), (2, "x" * 3000 + "z", "en", "s"), (3, "", "en", "s"), (4, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["assembled_texts"](spark, str(tmp_path)).collect()
    assert len(got) == 4 and len({r.digest for r in got}) == 4
