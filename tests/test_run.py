"""A run by settings: what is done is not done again."""

import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

from evidentia.config import Settings
from evidentia.plans.run import run
from evidentia.plans.store import read_star, versions

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Library:
    """Articles 0 to ``n`` - 1; a log of what is asked."""

    def __init__(self, folder, n):
        self.folder, self.n = str(folder), n

    def count(self, term):
        return self.n if term == "cells" else 0

    def page(self, term, start, size):
        return [str(i) for i in range(start, start + size)]

    def fetch(self, ids):
        with open(f"{self.folder}/log", "a") as log:
            log.write("\n".join(ids) + "\n")
        return "<set>" + "".join(f'<article><front><article-id pub-id-type="pmc">{i}</article-id><article-id pub-id-type="pmid">9{i}</article-id><article-title>T{i}</article-title><abstract><p>word {"long " * 300}</p></abstract></front></article>' for i in ids) + "</set>"


def test_run_and_run_again(spark, tmp_path):
    settings = Settings.from_environment({"EVIDENTIA_FOLDER": f"{tmp_path}/data", "EVIDENTIA_SEARCH_TERM": "cells", "EVIDENTIA_PAGE": "4", "EVIDENTIA_BATCH": "3", "EVIDENTIA_RATE": "1e6", "EVIDENTIA_WAIT": "0", "EVIDENTIA_MODEL": "m1", "EVIDENTIA_TEXT_TOKENS": "100", "EVIDENTIA_SAMPLE_SHARE": "0.3", "EVIDENTIA_KEEP_STATUS": "false"})
    calls = f"{tmp_path}/calls"

    def model(prompt):
        n = prompt.split("Title: T")[1].split("\n")[0]
        with open(calls, "a") as out:
            out.write(n + "\n")
        if n == "5" and not Path(f"{tmp_path}/mended").exists():
            raise ConnectionError(n)
        return json.dumps({"markers": [{"cell_type": "T cell", "marker": "cd3d" if int(n) % 2 else "X9", "tissue": "blood", "disease": None, "cell_subtype": None}]}), {"total_tokens": 7}

    genes = spark.createDataFrame([("CD3D", "Approved", "T3D", None)], "symbol string, status string, alias_symbol string, prev_symbol string")
    what = {"model": model, "validator": model, "nomenclature": genes}
    done = run(spark, settings, transport=Library(tmp_path, 10), **what)
    assert done == {"unanswered_pages": 0, "processed": 10, "answered": 9, "validation_asked": 3, "validation_answered": done["validation_answered"], "validation_failed": 3 - done["validation_answered"], "version": 1}
    text = spark.read.parquet(f"{settings.folder}/processed").first().clean_text
    assert len(text) <= 100 * 4 + 4 and spark.read.parquet(f"{settings.folder}/replies").first().model == "m1"
    star = read_star(spark, f"{settings.folder}/star")
    assert star.entries.count() == 9 and {r.symbol: r.citation_count for r in star.markers.collect()} == {"CD3D": 4, "X9": 5}
    assert {r.marker_status for r in star.entries.collect()} == {"approved"}

    Path(f"{tmp_path}/mended").touch()
    Path(f"{tmp_path}/log").write_text("")
    Path(calls).write_text("")
    done = run(spark, settings, transport=Library(tmp_path, 12), **{**what, "validator": None})
    assert (done["processed"], done["answered"], done["version"]) == (12, 12, 2)
    assert sorted(Path(calls).read_text().split()) == ["10", "11", "5"]
    assert {r.symbol: r.citation_count for r in read_star(spark, f"{settings.folder}/star").markers.collect()} == {"CD3D": 6, "X9": 6}
    assert run(spark, settings, stages=("load",), nomenclature=genes) == {"version": 3} and versions(spark, f"{settings.folder}/star").count() == 3
    assert read_star(spark, f"{settings.folder}/star").entries.count() == 12
    with pytest.raises(ValueError, match="fly"):
        run(spark, settings, stages=("fly",))
