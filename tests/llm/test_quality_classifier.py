"""The compression classifier: sizes and scores against plain zstandard, accuracy on made-up texts held out, hard cases."""

import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from evidentia.llm import quality_classifier as qc


def made_up(n, seed=5):
    """Good texts of syllables; bad ones with signs, in capitals, or one word again and again."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "ti", "on", "re", "sh", "ou", "é", "ing"]) for _ in range(r.randrange(1, 5)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.choice([3, 20, 100, 600]))]
        good = r.random() < 0.7
        if not good:
            kind = r.randrange(3)
            words = [w + r.choice(["###", "&&&", "%%%"]) for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * 80
        rows.append((i, " ".join(words), int(good)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, lang string, score int").repartition(3)
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


@pytest.fixture(scope="module")
def example(spark):
    rows = made_up(700)
    docs, labels = tables(spark, rows)
    return rows, docs, labels, qc.fit(docs, labels.where(~qc.held_out("doc_id")))


def test_scores_by_plain_compression(example):
    rows, docs, _, model = example
    level = {"level": qc.LEVEL, "write_content_size": False, "write_dict_id": False}
    good, bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **level) for d in (model.good, model.bad))
    got = {r.doc_id: r for r in model.score(docs).collect()}
    assert len(got) == len(rows)
    a, b, c = model.factors
    for i, text, _ in rows:
        data = text.encode()
        g, w = (sum(len(x.compress(data[k : k + qc.PIECE])) for k in range(0, len(data), qc.PIECE)) for x in (good, bad))
        z = a * (w - g) / (len(data) + 32) + b * np.log((min(g, w) + 4) / (len(data) + 32)) + c
        assert (got[i].n_bytes, got[i].good_bytes, got[i].bad_bytes) == (len(data), g, w)
        assert abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy_and_labels_not_seen(example, spark):
    rows, docs, labels, _ = example
    found = {r.doc_id: r for r in qc.score_quality(docs, labels).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r.held_out} == {i for i, _ in held}
    assert np.mean([found[i].predicted == q for i, q in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found.values())
    turned = labels.withColumn("quality", F.when(qc.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in qc.score_quality(docs.repartition(5), turned).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_sample_is_bounded(example):
    rows, docs, labels, _ = example
    model = qc.fit(docs, labels, train_rows=200, train_pieces=60, dictionary=2048)
    assert len(model.good) <= 2048 and len(model.bad) <= 2048
    scores = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert np.mean([(scores[i] >= 0.5) == q for i, _, q in rows]) > 0.8


def test_hard_rows(example, spark):
    _, _, _, model = example
    long = "the antion " * 1_000_000
    hard = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (None, "x"), (2, "!!"), (3, long)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.score) for r in model.score(hard).collect()))
    assert [x[:3] for x in got] == [(False, 1, 0), (False, 2, 0), (False, 2, 2), (False, 3, len(long)), (True, 0, 1), (True, 0, 1)]
    assert got[0][3] == got[1][3] and got[4] == got[5]
    assert model.score(hard.limit(0)).count() == 0


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0), (1, 0), (9, 1)], 0.25), ([(None, 1), (1, None), (2, 7)], 0.5)])
def test_without_examples_of_both(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    model = qc.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [round(r.score, 9) for r in model.score(docs).collect()] == [score] * 3


def test_few_examples(spark):
    """Too little for a dictionary to be trained; repeated rows and labels count once."""
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, "B@D!!"), (3, None)], "doc_id long, text string")
    model = qc.fit(docs, spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, quality int"))
    assert model.good == b"good words here" and model.bad == b"B@D!!"
    assert all(0 < r.score < 1 for r in model.score(docs).collect())


def test_logistic_finds_the_curve():
    r = np.random.default_rng(2)
    x = r.normal(size=(20_000, 2)) * [0.1, 3] + [1, -2]
    p = 1 / (1 + np.exp(-(8 * x[:, 0] - 0.5 * x[:, 1] - 9)))
    found = qc.logistic(x, (r.random(20_000) < p).astype(float), np.ones(20_000))
    assert np.allclose(found, [8, -0.5, -9], atol=0.6)
