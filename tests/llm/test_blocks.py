import threading
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import blocks


def test_hashes_of_long_data_are_those_of_short_data(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(r.integers(0, 4900, 300))
    ends = starts + r.integers(0, 100, 300)
    want = blocks.span_hashes(blocks.prefix_hashes(data), starts, ends)
    monkeypatch.setattr(blocks, "PIECE_BYTES", 256)
    assert (blocks.span_hashes(blocks.prefix_hashes(data), starts, ends) == want).all()
    assert (blocks.hashes_of(data, starts, ends) == want).all()
    ends[7] = 5000  # a span longer than a piece
    assert blocks.hashes_of(data, starts, ends)[7] == blocks.span_hashes(blocks.prefix_hashes(data), starts, ends)[7]


def test_a_long_text_takes_a_few_bytes_a_byte():
    text = ("some words in a long text, " * 40_000_0)[: 10_000_000]
    blocks.powers(blocks.PIECE_BYTES)
    column = pa.array([text])
    tracemalloc.start()
    (block,) = blocks.text_blocks(column)
    words = blocks.words_of(block)
    hashes = blocks.hashes_of(block.data, words.starts, words.ends)
    assert tracemalloc.get_traced_memory()[1] < 30 * len(text)
    tracemalloc.stop()
    assert len(hashes) == len(text.split()) and len(np.unique(hashes)) <= 8


def test_ids(spark):
    assert blocks.ids_of(pa.array([3, None, -1])).tolist() == [3, blocks.NO_ID, -1]
    with pytest.raises(TypeError):
        blocks.plain_texts(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "doc_id", "text")


def test_kept_tables_are_forgotten(spark):
    before = blocks.kept_so_far()
    first, second = (blocks.kept(spark.range(n)) for n in (3, 5))
    assert first.count() == 3
    blocks.forget(spark, before, 1)
    assert blocks.kept_so_far() == before + 1 and second.count() == 5
    with pytest.raises(Exception):
        first.count()


def test_threads_forget_their_own_tables(spark):
    """Two threads that keep and forget by turns leave each other's tables."""
    turn = threading.Barrier(2, timeout=60)

    def work(n):
        before = blocks.kept_so_far()
        first = blocks.kept(spark.range(n))
        turn.wait()
        second = blocks.kept(first.where("id > 0"))
        blocks.forget(spark, before, 1)
        turn.wait()
        return second.count(), blocks.kept_so_far() - before

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (5, 9))) == [(4, 1), (8, 1)]
