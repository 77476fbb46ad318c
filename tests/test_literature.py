"""The data source against a transport in memory and a server on this machine."""

import json
import sys
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark import cloudpickle

from evidentia.config import Settings
from evidentia.sources import literature as lit

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't know this file
FAST = Settings(page=10, batch=4, rate=1e6, tries=2, wait=0.0)


def article(i):
    return f'<article><front><article-id pub-id-type="pmc">{i}</article-id></front><body>text {i}</body></article>'


class Memory:
    """Hits 0 to ``n`` - 1; every request is a line of a log in ``folder``; what ``broken`` names fails until a file ``mended`` is there."""

    def __init__(self, folder, n=203, broken=(), absent=()):
        self.folder, self.n, self.broken, self.absent = str(folder), n, set(broken), set(absent)

    def _asked(self, what):
        with open(f"{self.folder}/log", "a") as log:
            log.write(f"{what}\t{time.time()}\n")
        if what in self.broken and not Path(f"{self.folder}/mended").exists():
            raise ConnectionError(what)

    def count(self, term):
        return self.n

    def page(self, term, start, size):
        self._asked(f"page {start // 10}")
        return [str(i) for i in range(start, min(start + size, self.n))]

    def fetch(self, ids):
        self._asked(f"fetch {ids[0]}")
        return "<set>" + "".join(article(i) for i in ids if i not in self.absent) + "</set>"


def log(folder):
    return [line.split("\t")[0] for line in Path(f"{folder}/log").read_text().splitlines()]


def test_eight_partitions(spark, tmp_path):
    spark.dataSource.register(lit.LiteratureIds)
    rows = spark.read.format("literature_ids").options(transport=lit.as_option(Memory(tmp_path)), partitions=8, page=10, rate=1e6).load()
    assert rows.rdd.getNumPartitions() == 8
    got = rows.collect()
    assert sorted(int(r.pmcid) for r in got if r.pmcid) == list(range(203))
    assert sorted(r.page for r in got if r.pmcid is None) == list(range(21)) and {r.error for r in got} == {None} and {r.total for r in got} == {203}
    assert sorted(log(tmp_path)) == sorted(f"page {k}" for k in range(21))


def test_a_page_fails_and_is_asked_for_again(spark, tmp_path):
    source = Memory(tmp_path, broken={"page 3"})
    left = lit.harvest(spark, f"{tmp_path}/h", source, FAST, articles=False, partitions=8)
    assert [(r.page, r.error) for r in left.collect()] == [(3, "ConnectionError: page 3")]
    assert lit.ids_of(lit.harvested(spark, f"{tmp_path}/h")).count() == 193 and log(tmp_path).count("page 3") == 2
    (tmp_path / "mended").touch()
    (tmp_path / "log").write_text("")
    assert lit.harvest(spark, f"{tmp_path}/h", source, FAST, articles=False).count() == 0
    assert log(tmp_path) == ["page 3"]
    ids = lit.ids_of(lit.harvested(spark, f"{tmp_path}/h"))
    assert sorted(int(r.pmcid) for r in ids.collect()) == list(range(203))
    assert lit.harvest(spark, f"{tmp_path}/h", source, FAST, articles=False).count() == 0 and log(tmp_path) == ["page 3"]


def test_articles_of_broken_batches(spark, tmp_path):
    source = Memory(tmp_path, n=45, broken={"fetch 14"}, absent={"7"})
    assert [r.page for r in lit.harvest(spark, f"{tmp_path}/h", source, FAST).collect()] == [1]
    rows = lit.harvested(spark, f"{tmp_path}/h")
    assert {(r.pmcid, r.error) for r in rows.where("xml is null and pmcid is not null").collect()} == {("7", lit.MISSING), *((str(i), "ConnectionError: fetch 14") for i in range(14, 18))}
    (tmp_path / "mended").touch()
    assert lit.harvest(spark, f"{tmp_path}/h", source, FAST).count() == 0
    got = lit.articles_of(lit.harvested(spark, f"{tmp_path}/h")).collect()
    assert sorted(int(r.pmcid) for r in got) == [i for i in range(45) if i != 7] and {r.xml for r in got if r.pmcid == "3"} == {article(3)}


def test_strict_pages_fail_the_task(spark, tmp_path):
    spark.dataSource.register(lit.LiteratureIds)
    with pytest.raises(Exception, match="page 3"):
        spark.read.format("literature_ids").options(transport=lit.as_option(Memory(tmp_path, broken={"page 3"})), page=10, rate=1e6, wait=0, strict=True).load().collect()


def test_rate_is_shared(spark, tmp_path):
    lit.harvest(spark, f"{tmp_path}/h", Memory(tmp_path, n=240), Settings(page=10, rate=20.0, wait=0.0), articles=False)
    times = sorted(float(x.split("\t")[1]) for x in Path(f"{tmp_path}/log").read_text().splitlines())
    slots = spark.sparkContext.defaultParallelism
    assert len(times) == 24 and all(times[i + 20 + slots] - times[i] > 0.8 for i in range(len(times) - 20 - slots))


def test_other_number_of_hits(spark, tmp_path):
    lit.harvest(spark, f"{tmp_path}/h", Memory(tmp_path, n=30), FAST, articles=False)
    lit.harvest(spark, f"{tmp_path}/h", Memory(tmp_path, n=31), FAST, articles=False)
    assert len(log(tmp_path)) == 3 + 4 and lit.ids_of(lit.harvested(spark, f"{tmp_path}/h")).count() == 31
    none = lit.harvest(spark, f"{tmp_path}/n", Memory(tmp_path, n=0), FAST)
    assert none.count() == 0 and lit.ids_of(lit.harvested(spark, f"{tmp_path}/n")).count() == 0
    limited = Settings(page=10, rate=1e6, wait=0.0, batch_limit=15)
    lit.harvest(spark, f"{tmp_path}/l", Memory(tmp_path, n=300), limited, articles=False)
    assert lit.ids_of(lit.harvested(spark, f"{tmp_path}/l")).count() == 15


@given(st.sets(st.integers(0, 60)), st.integers(1, 9))
def test_pages_shared_out(pages, parts):
    text = lit.text_of(iter(sorted(pages)))
    runs = lit.pages_of(text)
    assert [p for r in runs for p in r] == sorted(pages)
    out = lit.shared_out(runs, parts)
    assert [p for x in out for r in x for p in r] == sorted(pages)
    sizes = [sum(map(len, x)) for x in out]
    assert not pages or (len(sizes) == min(parts, len(pages)) and max(sizes) - min(sizes) <= 1)


class Server(BaseHTTPRequestHandler):
    """The protocol over 57 articles: each first answer to a page is an error, a page without ids, or right."""

    seen: set = set()

    def do_GET(self):  # noqa: N802
        path, _, query = self.path.partition("?")
        asked = dict(urllib.parse.parse_qsl(query))
        if path.endswith("efetch.fcgi"):
            return self._say("<set>" + "".join(article(i) for i in asked["id"].split(",")) + "</set>")
        if "usehistory" in asked:
            return self._say(json.dumps({"esearchresult": {"count": "57", "webenv": "W" + asked["term"], "querykey": "1"}}))
        first = asked["retstart"] not in self.seen
        self.seen.add(asked["retstart"])
        if asked.get("WebEnv") != "Wcells" or (first and asked["retstart"] == "20"):
            return self.send_error(500)
        ids = {} if first and asked["retstart"] == "10" else {"idlist": [str(i) for i in range(int(asked["retstart"]), int(asked["retstart"]) + int(asked["retmax"]))]}
        return self._say(json.dumps({"esearchresult": ids}))

    def _say(self, text):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *args):
        pass


def test_over_http(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        transport = lit.HttpTransport(f"http://127.0.0.1:{server.server_port}/", key="k")
        settings = Settings(search_term="cells", page=10, batch=4, rate=1e6, wait=0.0)
        assert lit.harvest(spark, f"{tmp_path}/h", transport, settings).count() == 0
        assert sorted(int(r.pmcid) for r in lit.articles_of(lit.harvested(spark, f"{tmp_path}/h")).collect()) == list(range(57))
    finally:
        server.shutdown()
