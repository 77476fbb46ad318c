import random
import zlib

import numpy as np
import pyarrow as pa

from evidentia.llm.blocks import text_blocks
from evidentia.llm.toxicity import Decoder, character_model, rising_shares, score_toxicity


def corpus(seed=1, n=900):
    r = random.Random(seed)
    syllables = ["ta", "re", "mi", "so", "lo", "ven", "ker", "é", "na"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    bad = ["scoundrel", "blockhead", "nitwit"]
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randrange(5, 60))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    hidden = [(5000, "ta re sc0undr3l mi lo"), (5001, "ta re s c o u n d r e l mi"), (5002, "so lo bloooockheaaad na"), (5003, "mi so n1tw!t ta"), (5004, "ta 12 re 3.5 mi $$$ so"), (5005, None), (5006, "")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows + hidden + [rows[0], (None, "x")]], "doc_id long, text string, score double").repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (77777, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(hidden) + 2 and sum(r.doc_id is None for r in got) == 1
    by_id = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert [by_id[5000 + k].predicted for k in range(7)] == [1, 1, 1, 1, 0, 0, 0]


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in score_toxicity(docs, labels).collect()}) == 1
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_decoder(spark):
    texts = [(" ".join(["scoundrel", "total", "letter", "apple"] * 5),)]
    decoder = Decoder(character_model(spark.createDataFrame(texts, "__text string")))
    given = ["sc0undr3l s.c.o.u.n.d.r.e.l tooootal l3tt3r appllle", "", "plain words, 1234 and so on*** stay!!", "x s c o u n d r e l", "a b c", "l e t t e r"]
    block = next(text_blocks(pa.array(given)))
    done = decoder.restore(block)
    got = [done.doc_bytes(i).decode() for i in range(len(given))]
    assert got[:3] == ["scoundrel scoundrel total letter apple", "", given[2]] and got[3].endswith("scoundrel") and got[4:] == ["a b c", "letter"]


def test_short_phrases_and_signs_alone(spark):
    """Three letters set apart and words of signs alone are decoded beside what they are."""
    decoder = Decoder(character_model(spark.createDataFrame([(" ".join(["ass", "fag", "mass", "flag"] * 9),)], "__text string")))
    given = ["an a s s here", "f a g", "x 455 y", "@$$", "in 12 or 3 b", "a b"]
    block = next(text_blocks(pa.array(given)))
    _, pieces = decoder.both(block)
    got = [pieces.doc_bytes(i).decode().split("\n") for i in range(len(given))]
    assert "ass" in " ".join(got[0]).split() and "fag" in got[1] and "ass" in got[2] and "ass" in got[3] and got[4:] == [[""], [""]]
    done = decoder.restore(block)
    assert [done.doc_bytes(i).decode() for i in (1, 2, 3)] == given[1:4]


def test_rising_shares():
    got = rising_shares(np.array([[10, 0], [0, 0], [2, 2], [3, 1], [0, 9]]), 0.2)
    assert len(got) == 5 and (np.diff(got) >= 0).all() and got[0] < 0.1 and got[-1] > 0.8


def restored(texts, model_texts, spark):
    decoder = Decoder(character_model(spark.createDataFrame([(" ".join(model_texts * 5),)], "__text string")))
    done = decoder.restore(next(text_blocks(pa.array(texts))))
    given, pieces = decoder.both(next(text_blocks(pa.array(texts))))
    assert [given.doc_bytes(i).decode() for i in range(len(texts))] == texts
    return [done.doc_bytes(i).decode() for i in range(len(texts))], [pieces.doc_bytes(i).decode().split() for i in range(len(texts))]


def test_signs_at_the_end_long_words_and_letters_set_apart(spark):
    words = ["scoundrel", "hate", "mass", "bass", "total", "letter"]
    texts = ["hat3", "ma$$", "ma55 ba5s", "scoundr" + "e" * 60 + "l", "s. c. o. u. n. d. r. e. l", "s* c* o* u* n* d* r* e* l", "l -. e -. t -. t -. e -. r", "l 3 t t 3 r", "self-s. c. o. u. n. d. r. e. l", "(+otal"]
    got, pieces = restored(texts, words, spark)
    assert got[:8] == ["hate", "mass", "mass bass", "scoundrel", "scoundrel", "scoundrel", "letter", "letter"]
    assert got[8].endswith("scoundrel") and "total" in " ".join(pieces[9])
    wide = ["अच", "कख"]
    assert restored([wide[0] + "च" * 5], wide, spark)[0][0] in (wide[0], wide[0] + "च")


def test_marks_may_be_meant(spark):
    words = ["u", "ran", "scoundrel", "you", "stop", "hating", "self", "letter"]
    got, pieces = restored(["you-scoundrel", "stop.scoundrel", "self_hating", "l-e-t-t-e-r", "y o u  s c o u n d r e l", "", "plain"], words, spark)
    assert got == ["you-scoundrel", "stop.scoundrel", "self_hating", "letter", "you scoundrel", "", "plain"]
    assert pieces[5:] == [[], []]


def test_words_after_marks_are_features(spark):
    rows, labels = corpus()
    hidden = [(5000, "ta re mi-scoundrel so"), (5001, "ta so.blockhead lo"), (5002, "mi na_nitwit"), (5003, "re s. c. o. u. n. d. r. e. l na"), (5004, "ta " + "blockh" + "e" * 50 + "ad"), (5005, "ta so-lo mi.re na_ta")]
    docs = spark.createDataFrame(rows + hidden, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    by_id = {r.doc_id: r.predicted for r in score_toxicity(docs, marks).collect()}
    assert [by_id[5000 + k] for k in range(6)] == [1, 1, 1, 1, 1, 0]


def test_decoder_finds_the_best_of_all_paths(spark):
    """Against every path through the lattice of short tokens."""
    import itertools

    decoder = Decoder(character_model(spark.createDataFrame([(" ".join(["scoundrel", "hate", "total", "letter", "bliss", "été"] * 5),)], "__text string")))
    classes = lambda text: [ord(c) - 96 if "a" <= c <= "z" else 0 if ord(c) < 0xC0 else None for c in text]

    def score(path):
        at, total = [0, 0], sum(cost for _, cost in path)
        for c in classes("".join(x for x, _ in path)) + [0]:
            total += decoder.model[at[-2] * 64 + at[-1]][c]
            at.append(c)
        return total

    r = np.random.default_rng(11)
    tokens = ["h4te", "t0tal", "b1i55", "l.e.t", "sc0und", "haaate", "t+t", "$(8", "a-b.c", "l e  t", "!1|"] + ["".join(r.choice(list("aehlt04$.-! "), 5)).strip() or "a" for _ in range(60)]
    for token in tokens:
        paths = list(itertools.product(*Decoder.lattice(token)))
        best = max(map(score, paths))
        found = decoder.decode(token)
        assert any("".join(x for x, _ in p) == found and abs(score(p) - best) < 1e-9 for p in paths), token
