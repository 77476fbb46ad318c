"""Ranked search against plain counting in Python."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from evidentia.llm import lexical_search as ls

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, most):
    held = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, x in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(x))
    rows = []
    for item, own in asked.items():
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        rows += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:most])]
    return sorted(rows)


def table(spark, rows, name):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], f"{name} long, text string, score int, id int").repartition(5)


def hard_tables():
    r = random.Random(7)
    word = lambda: r.choice(["the", "Of", "É", "ñu", "x1", "a-b", "q_r", "z9", "東京", "İ", *[f"w{k}" for k in range(40)]])
    docs = [(i, r.choice([" ", "\n", "--"]).join(word() for _ in range(r.choice([0, 1, 3, 30, 300])))) for i in range(300)]
    docs += [(900 + k, "the same text w1 w2") for k in range(60)] + [(3, docs[3][1]), (None, "w1 the"), (None, "w1 the"), (1000, None), (1001, ""), (1002, "?! \x7f[]"), (-5, "W3 w3 W3")]
    items = [(k, " ".join(word() for _ in range(k % 9))) for k in range(30)] + [(5, "w7 w8"), (None, "the"), (77, None), (78, ""), (79, "absent"), (80, "the of"), (2, items_text(docs))]
    return docs, items


def items_text(docs):
    return docs[8][1]


def test_against_brute_force(spark, monkeypatch):
    docs, items = hard_tables()
    want = brute(docs, items, 20)
    same = lambda got: sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=lambda x: x[:2]) == want
    ask = lambda: ls.ranked_search(table(spark, docs, "doc_id"), table(spark, items, "item_id"), most=20)
    assert same(ask())
    monkeypatch.setattr(ls, "LOAD_PAIRS", 17)
    assert same(ask())


def test_small_chunks():
    """Chunks of few triples give the same, in one process."""
    import pyarrow as pa

    r = random.Random(1)
    pairs = pa.table({"item_id": [i for i in range(40) for _ in range(5)], "term": [5 * (i % 7) + k for i in range(40) for k in range(5)]})
    asked = ls.Asked.of(pairs)
    rows = [sorted(r.sample(range(len(asked.terms)), r.randrange(8))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([r.randrange(5, 50) for _ in rows], pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array([[r.randrange(1, 4) for _ in x] for x in rows], pa.list_(pa.int64()))], ["id", "n", "terms", "times"])
    weights = np.array([r.randrange(3000) for _ in asked.terms])
    found = []
    old = ls.CHUNK
    for chunk in (1, 37, old):
        ls.CHUNK = chunk
        found.append(sorted(map(tuple, next(ls._scored(asked, weights, 200, 5000, 9)(iter([batch, batch.slice(50, 60)]))).to_pandas().itertuples(index=False))))
    ls.CHUNK = old
    assert found[0] == found[1] == found[2] and found[0]


@given(st.lists(st.integers(0, 2**40 - 1), max_size=60))
def test_radix_order(values):
    keys = np.array(values, np.int64)
    bound = max(values, default=0) + 1
    assert keys[ls.radix_order(keys, bound)].tolist() == sorted(values) if values else True


def test_large_numbers():
    n = np.array([1, 10**7])
    assert ls.length_factors(n, 10**11, 10**13).tolist() == [50 + 50 * k * 10**11 // 10**13 for k in n.tolist()]


def test_no_rows(spark):
    docs, items = table(spark, [(1, "a b")], "doc_id"), table(spark, [(1, "a")], "item_id")
    assert ls.ranked_search(docs.limit(0), items).count() == ls.ranked_search(docs, items.limit(0)).count() == 0
    assert ls.ranked_search(table(spark, [(1, None), (2, "!")], "doc_id"), items).count() == 0
    assert ls.ranked_search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_text(spark):
    long = "ab cd éf " * 1_200_000
    got = ls.ranked_search(table(spark, [(1, long), (2, "ab"), (3, "xy")], "doc_id"), table(spark, [(1, "ÉF ab")], "item_id"))
    assert sorted(tuple(r) for r in got.collect()) == brute([(1, long), (2, "ab"), (3, "xy")], [(1, "ÉF ab")], 50)
