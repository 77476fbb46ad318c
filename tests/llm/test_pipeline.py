import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import test_decontamination as decontamination  # noqa: E402
import test_line_dedup as lines  # noqa: E402
import test_ngram_jaccard as jaccard  # noqa: E402
import test_quality_rules as quality  # noqa: E402


def tables(seed=11):
    """Documents in groups too small for estimates, so that the base rules alone decide the first stage."""
    r = random.Random(seed)
    _, items, _ = decontamination.corpus(seed, 10)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(r.randrange(8, 16)))
    common = [line() for _ in range(6)]
    rows = []
    for i in range(50):
        body = [line() for _ in range(r.randrange(1, 9))]
        if i % 3 == 0:
            body.insert(r.randrange(len(body)), lines.edited(r, r.choice(common), r.randrange(3)))
        if i % 8 == 1:
            body.append(r.choice(items)[1])
        text = "\n".join(body)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 6 == 2:
            near = text.split(" ")
            near[len(near) // 2] = "changed"
            rows.append((100 + i, " ".join(near), "en", None, len(text)))
        if i % 10 == 3:
            rows.append((200 + i, text, "de", "s1", len(text)))
    rows += [(300, None, "en", "s1", None), (301, "", None, None, 0), (302, "short text", "en", "s2", 10)]
    return rows, items


def without_near_lines(rows):
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    places = sorted({(i, k, strip(x)) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if strip(x)})
    near = lambda a, b: a == b or abs(len(a) - len(b)) <= 2 and lines.distance(a, b) <= min(2, min(len(a), len(b)) * 2 // 40)
    out = []
    for i, t, lang, source, n, *more in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if not strip(x) or not any(p[:2] < (i, k) and near(p[2], strip(x)) for p in places)]
        text = "\n".join(kept)
        if text == (t or ""):
            out.append((i, t, lang, source, n, *more))
        elif text.strip():
            out.append((i, text, lang, source, len(text), *more))
    return out


def test_every_stage(spark, tmp_path):
    rows, items = tables()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def passes(t):
        n, _, _, _, repeated = quality.counts(t)
        return n >= 20 and 100 * repeated <= 30 * n

    want = [x for x in rows if passes(x[1])]
    assert len(want) < len(rows)
    steps = [want]
    steps.append(without_near_lines(steps[-1]))
    components = {i: c for i, _, c in jaccard.brute([x[:2] for x in steps[-1]])}
    steps.append([x for x in steps[-1] if components[x[0]] == x[0]])
    leaks = {d for d, _ in decontamination.score_all([x[:2] for x in steps[-1]], items)}
    steps.append([x for x in steps[-1] if x[0] not in leaks])
    assert len({len(x) for x in steps}) >= 3 and leaks
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(out := f"{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert sorted(map(tuple, docs.collect()), key=str) == sorted(steps[k], key=str), name
    words = {x[0]: len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in steps[-1]}
    taken = {r.doc_id: r.taken for r in docs.collect()}
    assert set(taken) <= set(words) and all(0 < taken[i] <= 3 * words[i] for i in taken)
    assert abs(sum(taken.values()) - sum(words.values())) <= 8


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_are_judged_each(spark, tmp_path):
    """Rows with one id or none, repeated rows, and extra columns with names of the operators' own."""
    some = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, part int, `kept text` string, row struct<a: int>"
    full = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, k, "x", (k,)) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(1, some("item", 12) + ". The answer is " + some("ans", 4))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = some("item", 12) + ". The answer is " + some("ans", 4)

    def left(stage, docs):
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes
        return sorted((x.part for x in got.select("part").collect()))

    docs = full([(1, some("a", 30)), (1, "few words"), (None, some("b", 30)), (None, None), (2, "")])
    assert left(pipeline.drop_low_quality, docs) == [0, 2]
    docs = full([(1, some("a", 30)), (1, leak + " " + some("c", 9)), (None, some("b", 30)), (None, leak), (2, None)])
    assert left(pipeline.drop_contaminated, docs) == [0, 2, 4]
    docs = full([(1, some("a", 30)), (1, some("a", 30) + " x"), (None, some("b", 30)), (None, some("b", 30)), (5, some("b", 31)), (None, some("c", 30)), (2, None), (2, None), (None, "")])
    assert left(pipeline.drop_near_duplicates, docs) in ([0, 4, 5, 6, 7, 8], [1, 4, 5, 6, 7, 8])
    same = full([(1, some("a", 30))])
    assert left(pipeline.drop_near_duplicates, same.union(same).union(same)) == [0]
    docs = full([(1, "one line of it\nother"), (2, "one line of it\nmore"), (None, "one line of it"), (3, None), (4, "")])
    got = pipeline.drop_repeated_lines(spark, docs, str(tmp_path))
    assert got.dtypes == docs.dtypes and sorted(map(tuple, got.select("part", "text", "n_chars").collect())) == [(0, "one line of it\nother", 20), (1, "more", 4), (3, None, 0), (4, "", 0)]
    assert sorted({x.doc_id for x in pipeline.mix(spark, docs, str(tmp_path)).collect()}, key=str) == [1, 2, None]
