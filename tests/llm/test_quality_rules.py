import random
import re

import numpy as np

from evidentia.llm import quality_rules as module
from evidentia.llm.quality_rules import quality_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def corpus(n=260):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéü") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(r.randrange(5, 20))) for _ in range(r.randrange(2, 12))]
        if i % 7 == 0:
            lines += lines[:1]
        if i % 31 == 0:
            lines = [x.replace(" ", "$$$ #") for x in lines] * 1
        rows.append((i, "\n".join(lines), r.choice(["en", "de"]), r.choice(["a", "b", None])))
    w = [word() for _ in range(30)]
    rows += [(900, None, "en", "a"), (901, "", None, None), (902, "few words", "en", "a"), (903, " ".join(w * 5), "en", "a"), (904, "Bla " * 50, "de", "b"), (905, " ".join(w + w[:9]), "fr", "z"), (906, " ".join(w), "fr", "z"), (907, " ".join(w[:25]), "fr", "z")]
    return rows


def robust(x):
    """Estimates as the operator makes them, for one group of rows in cells of the grid."""
    deviations, grid = np.array(list(module.STATISTICS.values())), module.GRID
    floor = np.diag(deviations**2)
    rank = lambda v, share: np.sort(v)[int(np.ceil(len(v) * share)) - 1]
    median = np.array([rank(c, 0.5) for c in x.T])
    spread = np.array([rank(np.abs(c - m), 0.5) for c, m in zip(x.T, median, strict=True)])
    far = lambda mean, cov: np.einsum("ij,jk,ik->i", x / grid - mean, np.linalg.inv(cov), x / grid - mean)
    moments = lambda some, grown: (some.mean(axis=0) / grid, np.cov(some.T / grid, bias=True) * grown + floor)
    scale = np.maximum(spread * 1.4826, deviations * grid)
    z = (x - median) / scale
    size = np.sqrt((z**2).sum(axis=1, keepdims=True))
    signs = np.round(np.divide(z, size, out=np.zeros_like(z), where=size > 0) * module._SIGN)
    shape = signs.T @ signs / len(x) / module._SIGN**2 * len(deviations) * np.outer(scale, scale) / grid**2
    best = None
    for mean, cov in ((median / grid, np.diag((spread / grid * 1.4826) ** 2) + floor), moments(x, 1.0), (median / grid, shape + floor)):
        for _ in range(module.STEPS):
            bins = np.minimum(np.floor(np.sqrt(far(mean, cov)) * module._FINE), module.CELLS)
            mean, cov = moments(x[bins <= rank(bins, module.SHARE)], module._GROWN)
        spread_of = round(np.linalg.slogdet(cov)[1] / 2, 6)
        if best is None or spread_of < best[0]:
            best = (spread_of, mean, cov)
    return far(*moments(x[far(*best[1:]) <= module._NEAR], 1.0))


def test_matches_numpy(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, g, s, 1) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(5)
    got = quality_rules(df).collect()
    want = {(i, *counts(t)) for i, t, _, _ in rows}
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want and len(got) == len(rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed and not (r.distance or 0) > module.CUTOFF) for r in got)
    texts = {i: t for i, t, _, _ in rows}
    by_group = {}
    for r in got:
        if not r.base_failed:
            n, chars, symbols, dup, rep = counts(texts[r.doc_id])
            lines = len([x for x in texts[r.doc_id].split("\n") if x.strip()])
            cells = [np.log1p(n), np.log((chars + 1) / n), np.log((symbols + 1) / (n + 20)), 5 * dup / max(lines, 1), 5 * rep / n]
            lang, source = next((g, s) for i, _, g, s in rows if i == r.doc_id)
            by_group.setdefault((lang, source), []).append((r.distance, np.floor(np.array(cells) * module.GRID + 0.5)))
    small = {k for k, v in by_group.items() if len(v) < module.LEAST}
    name = lambda x: "-" if x is None else f"={x}"
    groups = {f"{name(g)}/{name(k)}": v for (g, k), v in by_group.items() if (g, k) not in small}
    rest = []
    for lang in sorted({k[0] for k in small}, key=str):
        pooled = [x for k in small if k[0] == lang for x in by_group[k]]
        if len(pooled) >= module.LEAST:
            groups[f"{name(lang)}//"] = pooled
        else:
            rest += pooled
    assert len(groups) >= 2 and 0 < len(rest) < module.LEAST
    groups[max(groups, key=lambda k: (len(groups[k]), k))].extend(rest)
    for g in groups.values():
        np.testing.assert_allclose([x[0] for x in g], robust(np.array([x[1] for x in g])), atol=2e-3, rtol=1e-6)
    assert all((r.distance is None) == r.base_failed for r in got)
    assert any(not r.kept and not r.base_failed for r in got)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules(empty).count() == 0


def test_planted_junk(spark):
    """Junk of five kinds, a tenth of a hot source: caught, and clean texts are left alone."""
    r = random.Random(21)
    vocabulary = ["".join(r.choice("aeioubdkmnrst") for _ in range(r.randrange(2, 11))) for _ in range(900)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    text = lambda n: "\n".join(" ".join(some(min(12, n - k))) for k in range(0, n, 12))
    size = lambda: int(np.exp(r.gauss(5.3, 0.8))) + 25
    junk = [
        lambda: " ".join(x + r.choice(["##", "$%", "|&*", "<>"]) for x in some(size())),
        lambda: " ".join("".join(r.choice("0123456789abcdef") for _ in range(60)) for _ in range(size())),
        lambda: "\n".join(r.choice(["read more", "share this", "log in"]) if r.random() < 0.8 else " ".join(some(3)) for _ in range(60)),
        lambda: " ".join("a" for _ in range(20)) + " " + " ".join(r.choice("abcdefghij") for _ in range(size())),
        lambda: text(60_000),
    ]
    rows = [(i, text(size()), "en", "hot" if i % 4 else f"s{i % 3}") for i in range(1200)]
    planted = [(5000 + i, junk[i % 5](), "en", "hot" if i % 4 else "s0") for i in range(100)]
    got = {x.doc_id: x.kept for x in quality_rules(spark.createDataFrame(rows + planted, "doc_id long, text string, lang string, source string").repartition(6)).collect()}
    assert sum(got[i] for i, *_ in rows) >= 0.99 * len(rows)
    assert sum(not got[i] for i, *_ in planted) >= 0.9 * len(planted), [(k, sum(not got[5000 + i] for i in range(k, 100, 5))) for k in range(5)]
