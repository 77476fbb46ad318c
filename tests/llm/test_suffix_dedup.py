import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import suffix_dedup as module
from evidentia.llm.blocks import text_blocks
from evidentia.llm.suffix_dedup import merge_runs, suffix_dedup


def brute(rows, length=200):
    seen = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for k, (_, b) in enumerate(texts):
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefgh ijé\n") for _ in range(n))
    shared = [noise(n) for n in (150, 199, 200, 201, 260, 500, 900)]
    rows = []
    for i in range(60):
        t = noise(r.randrange(0, 300))
        for _ in range(r.randrange(0, 4)):
            s = r.choice(shared)
            a = r.randrange(0, 60)
            t += s[a : len(s) - r.randrange(0, 60)] + noise(r.randrange(0, 120))
        rows.append((i * 3 - 7, t))
    rows += [(900, None), (901, ""), (902, rows[5][1]), (902, rows[5][1]), (903, "ab" * 300), (904, "x" * 450), (905, "x" * 230), (906, "\0" * 240 + "y"), (907, "\0" * 205)]
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, part string").repartition(6)
        got = suffix_dedup(df, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(module, "_PIECE", 700)
    import pyarrow as pa

    data = "".join(random.Random(3).choice("abc") for _ in range(5000))
    block = next(text_blocks(pa.array([data])))
    _, at, low, high = module.anchors(block)
    whole = module._piece_anchors(block.data, block.offsets)
    spread = lambda a, lo, hi: sorted((x, p) for x, b, e in zip(a, lo, hi, strict=True) for p in range(b, e + 1))
    assert spread(at, low, high) == spread(*whole[1:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), min_size=1, max_size=9))
def test_merge(runs):
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
    coded = [(s := sorted(r), [0] * bool(s) + [common(a, b) for a, b in zip(s, s[1:])]) for r in runs]  # noqa: B905
    run, place, shared = merge_runs(coded)
    merged = [coded[r][0][p] for r, p in zip(run, place, strict=True)]
    assert merged == sorted(x for r in runs for x in r)
    assert shared[1:] == [common(a, b) for a, b in zip(merged, merged[1:])]  # noqa: B905


def test_edges(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(map(str, range(200)))
    df = spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup(df).collect()] == [490, 490]
