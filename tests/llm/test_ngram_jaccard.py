import random
import re

from evidentia.llm.ngram_jaccard import ngram_jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed, bases=12, each=14):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abçDE" for b in range(40)]
    passage = [r.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 4, 5, 6, 12, 40, 90, 200]))]
        if r.random() < 0.5:
            base[2:2] = passage
        for _ in range(each):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 12)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t) if r.random() < 0.8 else "\t".join(t).upper())
    texts += [None, "", " \n", "one", "One", "ONE two", " ".join(passage)]
    ids = r.sample(range(-500, 5000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_matches_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, sid int, part string").repartition(6)
        got = ngram_jaccard(df).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_late_links_find_what_the_rounds_miss(spark, monkeypatch):
    from evidentia.llm import ngram_jaccard as module

    monkeypatch.setattr(module, "LEADERS", 1)
    monkeypatch.setattr(module, "ROUNDS", 1)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ngram_jaccard(df).collect())) == brute(rows)


def test_edges(spark):
    assert ngram_jaccard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (1, "A B"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard(df).collect()), key=str) == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (3, 1, 1), (None, 1, 1)]
    alone = spark.createDataFrame([(None, "a b c"), (7, "d e f"), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard(alone).collect()), key=str) == [(7, 1, 7), (None, 0, None), (None, 1, None)]


def test_hot_tokens_are_dealt_by_block(spark):
    """A passage that all documents hold, and documents that link beside it."""
    r = random.Random(8)
    some = lambda n: [f"{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = some(30), []
    for i in range(300):
        own = some(r.choice([2, 20, 200]))
        rows.append((i, " ".join(own + passage)))
        if i % 5 == 0:
            own[len(own) // 2] = "other"
            rows.append((1000 + i, " ".join(own + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_jaccard(df).collect())) == brute(rows)
