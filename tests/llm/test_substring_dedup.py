import hashlib
import random
import re

from evidentia.llm.substring_dedup import substring_dedup


def brute(rows, width):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < i:
                gone |= set(range(k, k + width))
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["a", "b", "ç", "Word", "x.", "日本"]
    passage = [r.choice(words) + str(r.randrange(9)) for _ in range(30)]
    rows = []
    for i in range(n):
        t = [r.choice(words) + str(r.randrange(30)) for _ in range(r.randrange(0, 80))]
        if i % 3:
            t[5:5] = passage[r.randrange(10) : r.randrange(12, 30)]
        if i % 5 == 0:
            t = t + t
        rows.append((i * 7 - 20, r.choice([" ", "\n", "  \t"]).join(t)))
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, rows[3][1]), (1004, " ".join(passage * 400))]
    return rows


def test_matches_brute_force(spark):
    for width in (4, 13):
        rows = corpus(width)
        df = spark.createDataFrame([(i, t, "s", t) for i, t in rows], "doc_id long, text string, part string, hashes string").repartition(5)
        got = substring_dedup(df, width=width)
        assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute(rows, width)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0
    same = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, same), (1, same), (1, same), (2, same)], "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup(df).select("doc_id", "n_removed", "n_spans").collect()), key=str)
    assert got == [(1, 0, 0), (1, 0, 0), (2, 20, 1), (None, 20, 1)]
    nameless = spark.createDataFrame([(None, same), (None, same)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(nameless).collect()] == [0, 0]
