import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import line_dedup as ld
from evidentia.llm.line_dedup import line_dedup, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.binary(max_size=14).map(lambda b: bytes(x % 3 for x in b)), st.binary(max_size=14).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 4))
def test_within(a, b, edits):
    assert within(a, b, edits) == (distance(a, b) <= edits)


def edited(r, text, times):
    t = list(text)
    for _ in range(times):
        k, at = r.randrange(3), r.randrange(len(t))
        if k == 0:
            t[at] = r.choice("abcxyz")
        elif k == 1:
            t.insert(at, r.choice("abcxyz"))
        else:
            del t[at]
    return "".join(t)


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdef é") for _ in range(r.choice([20, 38, 41, 45, 60, 61]))) for _ in range(14)]
    rows = []
    for i in range(50):
        lines = [edited(r, r.choice(base), r.randrange(0, 4)) if r.random() < 0.8 else "".join(r.choice("abcdefgh") for _ in range(50)) for _ in range(r.randrange(0, 9))]
        lines = [r.choice(["", "  ", "\t"]) + x for x in lines]
        rows.append((r.randrange(10**6), "\n".join(lines)))
    rows += [(5, None), (6, ""), (7, "\n\n"), (8, rows[0][1]), (8, rows[0][1])]
    return rows


def brute(rows, edits=2, least=40):
    strip = lambda x: x.encode().strip(b" \t\n\r\x0b\x0c")
    places = sorted({(i, k, strip(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if len(strip(x)) >= least})
    out = []
    for i, t in rows:
        kept, lines = [], (t or "").split("\n")
        for k, x in enumerate(lines):
            own = strip(x)
            if len(own) < least or not any(p[:2] < (i, k) and abs(len(p[2]) - len(own)) <= edits and distance(p[2], own) <= edits for p in places):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, part string, lines int").repartition(6)
        got = line_dedup(df, carry="row")
        assert sorted(tuple(x)[:4] for x in got.collect()) == brute(rows)
        assert sorted((x.doc_id, x.row.doc_id, x.row.part, x.row.lines) for x in got.collect()) == sorted((i, i, "p", 1) for i, _ in rows)


def test_edges(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = "x" * 50
    df = spark.createDataFrame([(None, line), (1, f"{line}\n{line}y\nshort\nshort"), (2, f" {line} ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup(df.where("doc_id > 0")).collect()) == [(1, 1, f"{line}\nshort\nshort"), (2, 1, "")]


def test_rows_without_an_id_come_last(spark):
    line = "x" * 50
    df = spark.createDataFrame([(None, line), (1, line), (None, "y" * 50), (None, "y" * 50)], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in line_dedup(df).collect()]
    assert sorted(got, key=str) == [(1, 0), (None, 0), (None, 0), (None, 1)]


def test_hot_segments(spark):
    """Thousands of lines with a common beginning, and some that also share the end, of which a few are near others."""
    r = random.Random(4)
    some = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    head, tail = "2024-05-06 ERROR no answer from host ", " in time, trying once more"
    rows = [(i, head + some(30)) for i in range(3000)] + [(i, head + some(12) + tail) for i in range(3000, 4500)]
    near = r.sample(rows, 40)
    rows += [(5000 + k, edited(r, t, r.randrange(3))) for k, (_, t) in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for whole in (False, True):
        got = {x.doc_id for x in line_dedup(df, with_text=False, whole=whole).where("n_removed = 1").collect()}
        assert got >= {i for i, _ in rows if i >= 5000}
        texts = dict(rows)
        assert all(any(j < i and distance(texts[j], texts[i]) <= 2 for j, t in rows if t[-8:] == texts[i][-8:] or t[37:45] == texts[i][37:45]) for i in got if i < 5000)


def test_within_characters():
    r = random.Random(5)
    for _ in range(600):
        a, b = ("".join(r.choice("aé漢") for _ in range(r.randrange(14))) for _ in range(2))
        assert within(a, b, 2) == (distance(a, b) <= 2)


def brute_whole(rows):
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    places = sorted({(i, k, strip(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if strip(x)})
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) * 2 // 40)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not strip(x) or not any(p[:2] < (i, k) and near(p[2], strip(x)) for p in places)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_short_lines_and_characters(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdé 漢字é") for _ in range(n)) for n in (1, 5, 18, 19, 20, 21, 30, 38, 39, 40, 41, 60)]
    vary = lambda t, n: edited(r, t, n) if len(t) > 4 else t
    rows = [(r.randrange(10**6), "\n".join(vary(r.choice(base), r.randrange(4)) for _ in range(r.randrange(1, 7)))) for _ in range(60)]
    rows += [(5, None), (6, "\n \n"), (7, "x\nx"), (8, "漢" * 45), (9, "漢" * 43 + "字字")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, line_dedup(df, with_text=False, whole=True).collect())) == brute_whole(rows)


def test_query_removes_short_copies(spark, tmp_path):
    from evidentia.llm.queries import op6_line_dedup

    spark.createDataFrame([(1, "All rights reserved."), (2, "All rights reserved.\nother")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((x.doc_id, x.n_removed) for x in op6_line_dedup(spark, str(tmp_path)).collect()) == [(1, 0), (2, 1)]


def test_drops_find_all_near_pairs(monkeypatch):
    """Two strings within the edits share a key of what they don't have for themselves, the shorter as an index."""
    r = random.Random(11)
    tiers = [(1, 0, 1 << 62), (2, 0, 1 << 62)]
    for _ in range(150):
        size, tier = r.randrange(4, 40), r.randrange(2)
        a = "".join(r.choice("abé") for _ in range(size))
        b = list(a)
        for _ in range(tiers[tier][0]):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "x", "a"])
        texts = sorted({a, "".join(b)}, key=len)
        if len(texts) < 2 or not within(*texts, tiers[tier][0]) or len(texts[0]) <= tiers[tier][0]:
            continue
        edits = tiers[tier][0]
        batch = pa.RecordBatch.from_arrays([pa.array([7, 7]), pa.array([t.encode() for t in texts]), pa.array([edits] * 2, pa.int32()), pa.array([0, 1])], ["group", "x", "edits", "own"])
        rows = [x for out in ld._drop(2, True)(iter([batch])) for x in out.to_pylist()]
        keys = [{x["key"] for x in rows if x["own"] == k and (k or x["role"] == 0)} for k in (0, 1)]
        assert keys[0] & keys[1], texts
        for x in rows:
            left = ld._stretches(texts[x["own"]].encode(), ld.drops(edits)[x["drop"]], edits, True)
            assert [n for _, n in left] == [len(t.decode()) for t, _ in left] and sum(n for _, n in left) < len(texts[x["own"]])


def template(n, seed=1, wide=False):
    """Lines of one template of 200 characters with an id, a few of them with other edits."""
    r = random.Random(seed)
    head, tail = "2024-01-01 INFO worker accepted the request with identifier ", " and passed it on to the next stage of processing without any further delay; see the manual for details, please"
    if wide:
        head, tail = head.replace("e", "é"), tail.replace("a", "ä")
    rows = []
    for i in range(n):
        line = head + f"{r.randrange(10**16):016d}" + tail
        if i % 10 == 3:
            line = rows[r.randrange(len(rows))]
            for _ in range(r.randrange(1, 4)):
                at = r.randrange(len(line))
                line = line[:at] + r.choice(["", "#", "7"]) + line[at + r.randrange(2) :]
        rows.append(line)
    return rows


@pytest.mark.parametrize("wide", [False, True])
def test_lines_of_one_template(spark, wide):
    lines = template(500, wide=wide)
    lines += [f"{x}{i % 7}" for i, x in enumerate(lines[:30])] + ["short line number %04d of a list" % i for i in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    tiers = ld.tiers_of(ld.EDITS, ld.LEAST, True)
    want = {i for i, x in enumerate(lines) if any(x == y or ld.alike(y, x, tiers) for y in lines[:i])}
    got = {r.doc_id for r in line_dedup(df, whole=True, with_text=False).where("n_removed > 0").collect()}
    assert got == want and len(want) > 40


def test_lines_that_differ_in_little(spark):
    """All but a few characters are the same in hundreds of lines, so that groups stay hot to the end."""
    lines = [f"the same beginning of a line that is long enough, then {a}{b}{c}{d}" for a in "abcdef" for b in "0123" for c in "xyz" for d in ["", "q", "rs"]]
    random.Random(3).shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    tiers = ld.tiers_of(ld.EDITS, ld.LEAST, True)
    want = {i for i, x in enumerate(lines) if any(ld.alike(y, x, tiers) for y in lines[:i])}
    assert {r.doc_id for r in line_dedup(df, whole=True, with_text=False).where("n_removed > 0").collect()} == want
