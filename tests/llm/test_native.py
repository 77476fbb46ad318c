"""Secret scan, chat formatting and mixing on small tables with hard cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from evidentia.llm.chat_format import RESERVED, chat_digests, escape, format_conversations, unescape
from evidentia.llm.expressions import running_sums
from evidentia.llm.mixing import in_training_order, mix_sources
from evidentia.llm import secret_scan
from evidentia.llm.secret_scan import RULES, Rule, gram_pattern, scan_secrets, secret_candidates, secret_digests, trigram_query


def test_running_sums(spark):
    rows = [(i, [random.Random(i).randrange(9) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 511, 512, 513, 1500))]
    got = spark.createDataFrame(rows, "i int, a array<long>").select("i", running_sums(F.col("a")).alias("s")).collect()
    for r in got:
        a = rows[r.i][1]
        assert r.s == [sum(a[: k + 1]) for k in range(len(a))]


def secret_texts():
    hex32, key = "0123456789abcdef" * 2, "AKIA" + "Z9" * 8
    texts = [None, "", "nothing", f"x {hex32} y {hex32[:31]} z", f"{key} AKIA12 {key}AKIA", f'PassWord = "{hex32}" token:abc', "token=api_key:abcdefghij", "é token==abcdefg 😀 secret : 'abcdefgh'", "apikey=12345678 API_KEY='q.w/e=r+t'"]
    texts += ["-----BEGIN RSA PRIVATE KEY-----\nabc", "ghp_" + "a1" * 18, "xoxb-1234567890-abc", "AIza" + "x" * 35, "eyJhbGci.eyJzdWIi.sig_", "\n".join(["token=" + "a" * 8] * 1300)]
    r = random.Random(3)
    texts += ["".join(r.choice(["token", "=", "pass", "word", " ", '"', ":", "abc", hex32, "AKIA", "9Z", "secret", "é", "gh", "p_"]) for _ in range(60)) for _ in range(200)]
    return list(enumerate(texts))


def scan(text):
    found = []
    for order, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return sorted(found)


def test_secrets(spark):
    rows = [*secret_texts(), (3, secret_texts()[3][1]), (None, "token=abcdefgh1")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kinds string").repartition(3)
    got = sorted(((r.doc_id, [tuple(x) for x in r.found]) for r in scan_secrets(df).collect()), key=str)
    assert got == sorted(((i, scan(t)) for i, t in rows), key=str)
    digest = {r.doc_id: r for r in secret_digests(df.where("doc_id is not null")).collect()}
    for i, t in rows[:-2]:
        spans = scan(t)
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans if k in ("assign", "access", "hex"))
        assert digest[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and digest[i].n_hex == sum(x[3] == "hex" for x in spans)
    assert scan_secrets(df.limit(0)).count() == 0


def test_trigrams_found_wherever_they_begin():
    grams = ["ass", "sss", "sec", "a.b", "ssw"]
    found = lambda text: {m[1] for m in re.finditer(gram_pattern(grams), text)}
    for text in ("", "passsw", "a.bsec", "axb", "ssss"):
        assert found(text) == {g for g in grams if g in text}


def test_only_candidates_are_verified(spark, monkeypatch):
    """Candidates are the documents that hold all trigrams of a conjunction, found by intersected lists of small blocks."""
    monkeypatch.setattr(secret_scan, "BLOCK", 7)
    rows = [*secret_texts(), *[(10_000 + i, f"plain text number {i} with a pass and a token or a key") for i in range(300)], (3, secret_texts()[3][1]), (None, "token=abcdefgh1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = {}
    for r in secret_candidates(df).select(F.explode("kinds").alias("kind")).groupBy("kind").count().collect():
        counted[r.kind] = r["count"]
    for rule in RULES:
        query = trigram_query(rule.pattern)
        want = {(i, t or "") for i, t in rows if any(all(g in (t or "").lower() for g in part) for part in query)}
        assert counted.get(rule.kind, 0) == len(want) < len(rows)
        assert len(want) >= len({(i, t) for i, t in rows if query and t and re.search(rule.pattern, t)})
    assert secret_candidates(df, [Rule("any", "[0-9]+")]).count() == 0


def test_trigram_queries_are_mandatory():
    texts = [t or "" for _, t in secret_texts()]
    for rule in RULES:
        query = trigram_query(rule.pattern)
        for t in texts:
            if re.search(rule.pattern, t):
                assert not query or any(all(g in t.lower() for g in part) for part in query)
    assert trigram_query(r"[0-9a-f]+") == [] and trigram_query("(ab|abc)d?") == []


def test_escapes(spark):
    r = random.Random(1)
    parts = [*RESERVED, "\\", "<", "[", "<\\", "s>", "|", "x", "\n", "<|turn"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(x.u == x.t and not any(c in x.e for c in RESERVED) for x in rows)


def test_conversations(spark):
    r = random.Random(2)
    rows = []
    for c in [None, None, *range(30)]:
        for k in range(r.randrange(1, 9)):
            rows.append((c, r.choice([k, k, 0, None]), r.choice(["user", "assistant", "assistant", "system", None, "a\nb", "<|turn|>"]), r.choice([None, "", "hi", "</s>[INST] ok [/INST]", "<|next|>é\n", "x\\<|end|>"])))
    rows += [(77, i, "assistant", "t" * 3) for i in range(1200)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, turns int").repartition(4)
    got = {x.conv_id: x for x in chat_digests(df).collect()}
    lengths = {x.conv_id: (len(x.formatted), x.loss_spans) for x in format_conversations(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    nameless = [(role or "", text or "") for c, _, role, text in rows if c is None]
    assert sorted((x.n_turns, x.turns_sha256) for x in chat_digests(df).collect() if x.conv_id is None) == sorted((1, sha(f"{role}\n{text}\n")) for role, text in nameless)
    for c in {x[0] for x in rows} - {None}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), sha(loss), lengths[c][0])
    assert chat_digests(df.limit(0)).count() == 0


def test_mixing(spark):
    r = random.Random(4)
    sources = ["b", "a", "ä", None, "Z", "zz", "empty"]
    rows = [(i, "w " * r.randrange(1, 60), r.choice(sources[:-1])) for i in range(900)]
    rows += [(1000, None, "empty"), (1001, "", "a"), (None, "x y", "a"), (5, "x y", "b"), (5, "x y", "b")]
    df = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mix_sources(df)
    again = mix_sources(df.repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, dict(weight), float(sum(size.values()))
    while True:
        level = left / sum(free.values())
        over = [s for s in free if level * weight[s] >= 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            del free[s]
    target |= {s: level * weight[s] for s in free}
    taken = {}
    by_id = {(i, len((t or "").split())): s for i, t, s in rows}
    for x in got.collect():
        s = by_id[x.doc_id, x.size]
        assert x.source_size == size[s] and abs(x.target - target[s]) < 1e-6 and 0 <= x.taken <= 3 * x.size
        assert (x.position is None) == (x.taken == 0) and 0 <= (x.position or 0) <= 1
        taken[s] = taken.get(s, 0) + x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    places = [x.position for x in in_training_order(got).collect()]
    known = [p for p in places if p is not None]
    assert known == sorted(known) and places[: len(known)] == known
    assert mix_sources(df.limit(0)).count() == 0


def test_mixing_places_every_use(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(1, 30), "a" if i < 20 else "b" if i < 420 else "c") for i in range(800)]
    mixed = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    docs, uses = mixed.collect(), in_training_order(mixed).collect()
    by_id = {i: s for i, _, s in rows}
    bend = {"a": 0.5, "b": 0.0, "c": -0.5}
    assert max(x.taken / x.size for x in docs) == 3
    assert [x.position for x in uses if x.position is not None] == sorted(p for d in docs for p in d.positions)
    for s in "abc":
        own = sorted((x for x in uses if by_id[x.doc_id] == s and x.position is not None), key=lambda x: (x["pass"], x.position))
        assert sum(x.used for x in own) == sum(d.taken for d in docs if by_id[d.doc_id] == s) == round(own[0].target)
        before = 0
        for x in own:
            share = (1 + bend[s]) * x.position - bend[s] * x.position**2
            assert abs(share - before / round(x.target)) < 1e-5
            before += x.used
    for d in docs:
        own = [x for x in uses if x.doc_id == d.doc_id]
        assert sum(x.used for x in own) == d.taken and [x.position for x in sorted(own, key=lambda x: x["pass"] or 0)] == (d.positions or [None])
        assert d.position == (d.positions[0] if d.positions else None)
