"""Fill-in-middle against plain slices of strings, and masks against single bits."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import fill_in_middle as fim

TEXT = st.text(st.sampled_from("ab \t\nñ😀́<PSM>"), max_size=40)


def units(text, unit):
    """Where each unit begins, in characters."""
    if unit == "character":
        return list(range(len(text)))
    return [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+" if unit == "word" else r"[^\n]*\n|[^\n]+", text)]


@given(st.integers(0, 2**90), st.integers(0, 200))
def test_ranked_bit(mask, more):
    places = [i for i in range(mask.bit_length()) if mask >> i & 1]
    for rank, place in enumerate(places):
        assert fim.ranked_bit(mask, mask.bit_length() + more, rank) == place


@given(TEXT, st.sampled_from(fim.UNITS), st.integers(1, 9))
def test_units_in_pieces(text, unit, piece):
    old, fim.PIECE = fim.PIECE, piece
    try:
        data = text.encode()
        marked = fim.Marked.of(data, unit)
        starts = units(text, unit)
        assert sum(marked.counts) == len(starts) and fim.characters(data) == len(text)
        places = [0, *[len(text[:s].encode()) for s in starts[1:]], *([len(data)] if starts else [])]
        assert [marked.place(k) for k in range(len(starts) + 1)] == places
    finally:
        fim.PIECE = old


def expected(key, text, unit="character", sentinels=fim.SENTINELS, seed="1", share=90, first=20):
    text = text or ""
    starts = units(text, unit)
    n = len(starts)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in sentinels) or c % 100 >= share:
        return key, n, "plain", None, None, text
    places = [0, *starts[1:], len(text)] if n else [0]
    i, j = sorted((places[a % (n + 1)], places[b % (n + 1)]))
    p, s, m = sentinels
    parts = text[:i], text[i:j], text[j:]
    if d % 100 < first:
        return key, n, "spm", i, j - i, s + parts[2] + p + parts[0] + m + parts[1]
    return key, n, "psm", i, j - i, p + parts[0] + s + parts[2] + m + parts[1]


def hard_texts():
    texts = [None, "", " ", "\n\n", "a", "é", "<P> in it", "<M", "S><P", "<" * 50, "a<S", "😀" * 30, "é" * 20, "one two\nthree  four\n", "x\r\ny"]
    texts += [f"w{i} ñandú 😀 <i>\n" * (i % 7) for i in range(200)]
    return [(i * 7 - 20, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "same id"), (5, "same id"), (5, "same id, other text")]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_all_forms(spark, unit):
    rows = hard_texts()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, output string, id string").repartition(3)
    made = fim.fill_in_middle(df, unit=unit, carry="row")
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back"), "row.id").collect()
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((*expected(i, t, unit), t or "", "y") for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_and_shares(spark):
    own = ("[pre]", "{suf}", "|mid>")
    rows = [(i, "abc def " * i + "<P>") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = fim.fill_in_middle(df, sentinels=own, share=100, suffix_first=50, seed="s").withColumn("back", fim.restored(F.col("output"), F.col("form"), own)).collect()
    assert sorted((r.doc_id, r.output, r.back) for r in got) == sorted((i, expected(i, t, sentinels=own, seed="s", share=100, first=50)[-1], t) for i, t in rows)
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("<P<", "a", "b"), ("ab", "abc", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, sentinels=bad)


def test_long_and_no_texts(spark):
    long = "ab ñ😀\n" * 1_500_000
    df = spark.createDataFrame([(1, long), (2, long[:-1])], "doc_id long, text string")
    got = {r.doc_id: r for r in fim.fill_in_middle_digests(df).collect()}
    for i, t in ((1, long), (2, long[:-1])):
        want = expected(i, t)
        assert tuple(got[i])[:5] == want[:5] and got[i].output_sha256 == hashlib.sha256(want[-1].encode()).hexdigest()
        assert got[i].restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert fim.fill_in_middle_digests(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([(1,)], "doc_id long").withColumn("text", F.lit(None))
    assert tuple(fim.fill_in_middle(nulls).first()) == (1, 0, "plain", None, None, "")
