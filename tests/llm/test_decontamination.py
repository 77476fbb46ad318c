import random
import re

import numpy as np

from evidentia.llm import decontamination as module
from evidentia.llm.decontamination import find_contamination


def corpus(seed, n_items=40):
    r = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    rare = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ron", "lix", "émo", "tt")]
    word = lambda: r.choice(common) if r.random() < 0.5 else r.choice(rare) + r.choice("aeiou") * r.randrange(2)
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(sentence(r.randrange(4, 14)) for _ in range(r.randrange(1, 4)))) for i in range(n_items)]
    docs, planted = [], set()
    for d in range(120):
        words = sentence(r.randrange(0, 400)).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            i, text = r.choice(items)
            words += (text.upper() if r.random() < 0.3 else text).split() + sentence(r.randrange(0, 100)).split()
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, planted


def score_all(docs, items):
    """All pairs by plain BM25 over every window, with the same verification."""
    import math

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = {i: words(t) for i, t in items}
    count, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {}
    for b in bags.values():
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    widths = {i: max(16, 1 << (len(b) - 1).bit_length()) if b else 16 for i, b in bags.items()}
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    found = set()
    for i, text in items:
        own, width = bags[i], widths[i]
        impact = {w: math.log1p((count - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in set(own)}
        total = sum(impact.values())
        m = re.match(r"(?s)^(.*[.!?])\s+(\S.*)$", text.strip())
        head = math.ceil(len(text.split()) * 2 / 3)
        q, a = m.groups() if m else (" ".join(text.split()[:head]), " ".join(text.split()[head:]))
        for d, t in docs:
            w = words(t)
            for s in range(0, max(len(w), 1), width):
                window = w[s : s + 2 * width]
                if sum(impact.get(x, 0) for x in set(window)) / total >= 0.5:
                    near = w[max(s - 2, 0) : s + 2 * width + 2]
                    sides = [(min(3, len(x)), grams(x, min(3, len(x)))) for x in (words(q), words(a))]
                    if all(not g or len(g & grams(near, n)) / len(g) >= 0.5 for n, g in sides):
                        found.add((d, i))
    return found


def test_matches_scoring_of_all_windows(spark, monkeypatch):
    for seed, each, load in ((1, 20_000, 64 << 20), (2, 7, 64 << 20), (3, 7, 9_000)):
        monkeypatch.setattr(module, "SLICE_ITEMS", each)
        monkeypatch.setattr(module, "LOAD_BYTES", load)
        docs, items, planted = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, item_id int").repartition(4)
        tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
        got = {(r.doc_id, r.item_id) for r in find_contamination(df, tests).collect()}
        assert got == score_all(docs, items)
        assert planted <= got


def test_signs_beyond_ascii_and_one_long_item(spark):
    """Curly quotes, dashes and wide spaces between words, other scripts, and an item of 10,000 words beside short ones."""
    r = random.Random(5)
    rare = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ron", "lix", "émo", "जल", "tt")]
    some = lambda n: [r.choice(rare) + r.choice("aeiouxyz") * r.randrange(3) for _ in range(n)]
    items = [(i, " ".join(some(9)) + ". " + " ".join(some(4)) + ".") for i in range(12)] + [(99, " ".join(some(9_990)) + ". " + " ".join(some(10)))]
    signed = lambda t: "“" + t.replace(" ", "—", 2).replace(" ", "\u00a0… ", 3) + "”"
    docs = [(i, " ".join(some(30)) + " " + signed(t) + " " + " ".join(some(50))) for i, t in items[:8]] + [(50, " ".join(some(300)) + " " + items[12][1] + " " + " ".join(some(20)))]
    docs += [(100 + k, " ".join(some(200))) for k in range(20)]
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in find_contamination(df, tests).collect()}
    assert got >= {(i, i) for i in range(8)} | {(50, 99)}
    spaced = lambda t: re.sub("[“”—…\u00a0]", " ", t)
    assert {x for x in got if x[1] < 99} == {x for x in score_all([(i, spaced(t)) for i, t in docs], items) if x[1] < 99}


def test_wand_opens_what_the_maxima_allow():
    r = np.random.default_rng(7)
    for _ in range(25):
        rows = [{"item": i, "question": (q := r.integers(1, 60, 8).tolist()), "answer": [], "terms": sorted(set(q)), "counts": [int(r.integers(1, 9)) for _ in set(q)]} for i in range(120)]
        index = module.build_index(rows, 120, 8.0, 16, 0.25)
        driving = np.flatnonzero(np.diff(index.block_cuts))
        queries = [np.sort(r.choice(driving, k, replace=False)) for k in (1, 3, 8, 12, 20)]
        want = []
        for q, terms in enumerate(queries):
            for b in range(len(index.tails)):
                x = sum(float(index.block_most[k]) for t in terms for k in range(index.block_cuts[t], index.block_cuts[t + 1]) if index.blocks[k] == b)
                want += [(q, b)] * bool(x > 0 and x + index.tails[b] >= 0.5)
        found = module.wand(index, np.repeat(np.arange(5), [len(x) for x in queries]), np.concatenate(queries), 0.5)
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma delta"), (3, "Alpha, beta; gamma delta!"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, " . "), (None, "alpha beta gamma delta")], "item_id long, text string")
    assert sorted((tuple(r)[:2] for r in find_contamination(docs, items).collect()), key=lambda x: x[0] or 0) == [(None, 1), (3, 1)]
    assert find_contamination(docs, items.limit(0)).count() == 0
    assert find_contamination(docs.limit(0), items).count() == 0
