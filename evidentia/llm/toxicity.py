"""Operator 9: toxicity of texts, scored after deobfuscation by a noisy-channel decoder.

Channel.  Words written with digits and signs for letters, with letters set
apart, or with letters repeated become lattices: each sign may be itself, one
of the letters it looks like, or nothing.  The Viterbi path under a character
trigram model gives the word that was meant.  The model is counted over all
texts (by class of letter) and has the size of its alphabet.

Scorer.  Words and beginnings of words, of the text as given and of what was
decoded in it, are features.  Those that occur in at
least ``MIN_TOXIC`` toxic documents of a bounded sample of labelled documents
are kept.  A text's evidence is the
largest lower confidence limit of the share of toxic documents among those with
a feature of it, so that a feature seen a few times proves little; its score is
the share of toxic documents in the sample at that evidence, made to rise with
it.  For these shares a document's evidence comes from the other ``FOLDS`` - 1
parts of the sample (copies of a text are in one part), so that features which
only this document has don't prove what they were made from.

Scale.  One pass over the texts counts characters, one scores; neither
exchanges a text.  Labels are sampled to ``TRAIN_ROWS`` rows before they are
joined, which bounds what is fitted and, as a feature needs some of its toxic
documents, what is broadcast; what is scored is every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_LETTER, Block, hashes_of, kept, mix, partitions_of, plain_texts, starts_of, text_blocks, words_of

#: Labelled documents that the scorer is fitted on, and toxic documents a feature needs.
TRAIN_ROWS, MIN_TOXIC = 40_000, 5
#: Score from which a text is called toxic.
LIMIT = 0.3
#: Steps of evidence for which shares are counted.
STEPS = 100
#: Parts of the sample, each judged by the others.
FOLDS = 4
#: Lengths in bytes of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6)
#: Classes of characters in the model: 0 for what is no letter, 1-26 for a-z, the others for all other letters.
_CLASSES = 64
#: Signs and the letters they may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log probabilities that a letter is written by a sign that looks like it, that a mark is put between letters, that a repeated
#: letter was meant once, and that a mark, white space, two or more white space, or a sign that looks like a letter is meant itself.
_SIGN, _MARK, _ONCE, _BREAK, _SPACE, _SPACES, _ITSELF = -1.5, -0.7, -0.3, -1.5, -1.5, -0.2, -3.0
#: Letters set apart that make a phrase, marks that may stand between two of them beside white space, and signs that make a word without a letter.
_APART, _BETWEEN, _ALONE = 3, 2, 3
#: Tokens up to this length are decoded once and remembered; longer ones are decoded each time.
_REMEMBERED = 64
_OUTER = ".,;:?!*_-~\"'`()[]{}<>|&%#+=/\\"
_OUTER_MARKS = "".join(c for c in _OUTER if c not in LOOKS)
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of ASCII signs that look like letters, of marks, and of what may stand between letters set apart.
_SIGNS = np.array([chr(b) in LOOKS for b in range(256)])
_MARKS = np.array([chr(b) in "*._~`-" for b in range(256)])
_WHITE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


def _signs(d: np.ndarray) -> np.ndarray:
    """Which bytes are, or end, a sign that looks like a letter."""
    out = _SIGNS[d]
    for sign in (c.encode() for c in LOOKS if not c.isascii()):
        n = len(sign)
        own = d[n - 1 :] == sign[-1]
        for k in range(n - 1):
            own &= d[k : len(d) - n + 1 + k] == sign[k]
        out[n - 1 :] |= own
    return out


def _thrice(d: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Where a letter of one to four bytes stands three times in a row."""
    out = []
    for n, low, high in ((1, 0, 0x80), (2, 0xC3, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        if len(d) < 3 * n:
            continue
        head, last = d[: len(d) - 3 * n + 1], len(d) - 3 * n + 1
        at = np.flatnonzero((head >= low) & (head < high) & letter[:last] & (head == d[n : n + last]) & (head == d[2 * n : 2 * n + last]))
        for k in range(1, n):
            at = at[(d[at + k] == d[at + n + k]) & (d[at + k] == d[at + 2 * n + k])]
        out.append(at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _runs(block: Block, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the longest runs of marked bytes, which never cross documents."""
    before, cut = np.zeros(len(solid), bool), np.zeros(len(solid) + 1, bool)
    before[1:] = solid[:-1]
    cut[block.offsets] = True
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    ends = np.flatnonzero(solid & (np.append(~solid[1:], True) | cut[1:])) + 1
    return starts, ends, np.searchsorted(block.offsets, starts, "right")


def _totals(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags, dtype=np.int64))


def _class_of(code: np.ndarray) -> np.ndarray:
    """Class of each lower-case code point."""
    out = np.where(code >= 0xC0, 27 + (code * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(_CLASSES - 27), 0)
    return np.where((code >= 97) & (code <= 122), code - 96, out).astype(np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams of character classes, words being set off by class 0."""
    counts = np.zeros(_CLASSES**3, np.int64)
    for batch in batches:
        for block in text_blocks(batch.column(0)):
            text = "\n".join(block.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True))
            c = _class_of(np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32))
            counts += np.bincount(c[:-2] * _CLASSES**2 + c[1:-1] * _CLASSES + c[2:], minlength=len(counts)) if len(c) > 2 else 0
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["gram", "n"])


def character_model(texts: DataFrame) -> np.ndarray:
    """Log probability of each class after each two, from a column ``__text`` of all texts; smoothed by the shorter contexts."""
    rows = texts.select(F.lower("__text")).mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    tri = np.zeros(_CLASSES**3)
    tri[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    tri = tri.reshape(_CLASSES, _CLASSES, _CLASSES)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + _CLASSES)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


class _Classes(dict):
    """Class of a character, looked up once."""

    def __missing__(self, c: str) -> int:
        self[c] = int(_class_of(np.array([ord(c)], np.uint32))[0])
        return self[c]


class Decoder:
    """Viterbi decoding of character lattices under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.reshape(-1, _CLASSES).tolist()  # by the last two classes, then the next
        self._classes = _Classes()
        self._known = lru_cache(1 << 16)(self._decode)

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each sign its readings: letters (or none, in a token that has letters) and their log probability."""
        out: list[list[tuple[str, float]]] = []
        i, lettered = 0, any(c.isalpha() for c in token)
        while i < len(token):
            c, n = token[i], 1
            if c.isalpha():
                while i + n < len(token) and token[i + n] == c:
                    n += 1
                options = [(c * n, 0.0)] if n < 3 else [(c, _ONCE), (c * 2, _ONCE - 1.0)]
            elif c.isspace():
                while i + n < len(token) and token[i + n].isspace():
                    n += 1
                options = [("", _MARK), (" ", _SPACE if n == 1 else _SPACES)]
            elif c in LOOKS:
                options = [(x, _SIGN) for x in LOOKS[c]]
                if lettered and not c.isdigit():
                    options.append(("", _MARK))
                options.append((c, _ITSELF))
            else:
                options = [("", _MARK), (c, _BREAK)]
            out.append(options)
            i += n
        return out

    def decode(self, token: str) -> str:
        return self._known(token) if len(token) <= _REMEMBERED else self._decode(token)

    def _decode(self, token: str) -> str:
        model, classes = self.model, self._classes
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last two classes
        for options in self.lattice(token):
            read = [(letters, cost, [classes[c] for c in letters]) for letters, cost in options]
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, text) in paths.items():
                for letters, cost, numbers in read:
                    x, s = state, score + cost
                    for z in numbers:
                        s += model[x][z]
                        x = x % _CLASSES * _CLASSES + z
                    old = after.get(x)
                    if old is None or s > old[0]:
                        after[x] = (s, (text, letters))
            paths = after
        text = max(((score + model[state][0], text) for state, (score, text) in paths.items()), key=lambda x: x[0])[1]
        out = []
        while text is not None:
            text, letters = text
            out.append(letters)
        return "".join(reversed(out))

    def readings(self, token: str) -> list[str]:
        """A token (or phrase of letters set apart) as it was meant, marks around it left; then with signs around it that look like letters read too.

        Signs without a letter, and three letters set apart, may well be meant
        as they stand; this is their first reading.
        """
        letters = sum(c.isalpha() for c in token)
        out = [token] if not letters or letters <= _APART and len(token.split()) > 1 else []
        for outer in (_OUTER, _OUTER_MARKS):
            core = token.strip(outer)
            if not core or core.isalpha() and not _TRIPLE.search(core) or not any(c.isalpha() or c in LOOKS for c in core):
                new = token
            else:
                at = token.index(core)
                new = f"{token[:at]}{self.decode(core)}{token[at + len(core):]}"
            if new not in out:
                out.append(new)
        return out

    def changes(self, block: Block) -> list[tuple[int, int, list[str]]]:
        """Start, end and readings of suspicious tokens and phrases of a block of lower-case texts, in order and apart.

        Suspicious are tokens with a letter and a sign that looks like one, of
        three such signs or more, with a mark before a letter or with a letter
        three times in a row, and three letters (or signs for them) or more in a
        row that only white space and up to two marks set apart.
        """
        d, words = block.data, words_of(block)
        if not len(words.starts):
            return []
        letter, sign = _LETTERS[d], _signs(d)
        letters, signs = _totals(letter), _totals(sign)
        looks = signs[words.ends] - signs[words.starts]
        own = (looks > 0) & (letters[words.ends] > letters[words.starts]) | (looks >= _ALONE)
        places = np.concatenate([np.flatnonzero(_MARKS[d[:-1]] & letter[1:]), _thrice(d, letter)])
        at = np.searchsorted(words.starts, places, "right") - 1
        own[at[at >= 0]] = True
        spans = [(int(words.starts[k]), int(words.ends[k])) for k in np.flatnonzero(own)]
        spans = sorted([*spans, *self._phrases(block, letter, sign)])
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        raw = d.tobytes()
        return [(a, b, self.readings(raw[a:b].decode("utf-8", "replace"))) for a, b in out]

    @staticmethod
    def _phrases(block: Block, letter: np.ndarray, sign: np.ndarray) -> list[tuple[int, int]]:
        """Start and end of letters set apart, with the tokens that they begin and end in."""
        starts, ends, doc = _runs(block, letter | sign)
        if len(starts) < _APART:
            return []
        d = block.data
        heads = _totals((d & 0xC0) != 0x80)
        single = heads[ends] - heads[starts] == 1
        other, marks, letters = _totals(~(_WHITE[d] | _MARKS[d])), _totals(_MARKS[d]), _totals(letter & ~sign)
        joined = single[1:] & single[:-1] & (doc[1:] == doc[:-1]) & (other[starts[1:]] == other[ends[:-1]]) & (marks[starts[1:]] - marks[ends[:-1]] <= _BETWEEN)
        edges = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        out = []
        words = words_of(block)
        for i, j in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            if j - i + 1 >= _APART and letters[ends[j]] > letters[starts[i]]:
                a, b = np.searchsorted(words.starts, [starts[i], starts[j]], "right") - 1
                out.append((int(words.starts[a]), int(words.ends[b])))
        return out

    def restore(self, block: Block) -> Block:
        """A block of lower-case texts with suspicious tokens and phrases decoded."""
        raw, pieces, last, grown = block.data.tobytes(), [], 0, np.zeros(len(block.offsets), np.int64)
        for a, b, readings in self.changes(block):
            new = readings[0].encode()
            pieces += [raw[last:a], new]
            grown[np.searchsorted(block.offsets, a, "right")] += len(new) - (b - a)
            last = b
        pieces.append(raw[last:])
        return Block(block.rows, np.frombuffer(b"".join(pieces), np.uint8), block.offsets + np.cumsum(grown)) if last else block

    def both(self, block: Block) -> tuple[Block, Block]:
        """A block of lower-case texts as given, and all readings of its suspicious tokens and phrases, one a line."""
        pieces, size = [], np.zeros(len(block.offsets), np.int64)
        for a, _, readings in self.changes(block):
            new = ("\n".join(readings) + "\n").encode()
            pieces.append(new)
            size[np.searchsorted(block.offsets, a, "right")] += len(new)
        return block, Block(block.rows, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size))


class _Finder:
    """Whether hashes are among the wanted ones, by a table of low bits first."""

    def __init__(self, wanted: np.ndarray):
        self.wanted, self.mask = wanted, np.uint64((1 << max(12, len(wanted).bit_length() + 3)) - 1)
        self.some = np.zeros(int(self.mask) + 1, bool)
        self.some[(wanted & self.mask).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes``, and positions among the wanted."""
        at = np.flatnonzero(self.some[(hashes & self.mask).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.wanted, hashes[at]), max(len(self.wanted) - 1, 0))
        own = self.wanted[k] == hashes[at] if len(self.wanted) else np.zeros(len(at), bool)
        return at[own], k[own]


def _hashed(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words, and of their beginnings, with the document of each."""
    words = words_of(block, NO_LETTER)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    yield hashes_of(block.data, words.starts, words.ends), doc
    for n in BEGINNINGS:
        own = words.ends - words.starts >= n
        yield mix(hashes_of(block.data, words.starts[own], words.starts[own] + n), 50 + n), doc[own]


def _features(blocks: tuple[Block, ...], finder: _Finder | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each document in any of the blocks, every one once for a document, and the document; of the wanted ones if a finder is given."""
    parts = []
    for found, doc in (x for block in blocks for x in _hashed(block)):
        own = slice(None) if finder is None else finder(found)[0]
        parts.append((found[own], doc[own]))
    found, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.lexsort((found, docs))
    o = o[starts_of(docs[o], found[o])]
    return found[o], docs[o]


def _restored(batches: Iterator[pa.RecordBatch], decoder: Decoder, column: int) -> Iterator[tuple[pa.RecordBatch, tuple[Block, Block]]]:
    for batch in batches:
        for block in text_blocks(batch.column(column)):
            yield batch.slice(block.rows.start, block.rows.stop - block.rows.start), decoder.both(block)


def _count(model: np.ndarray, wanted: np.ndarray | None):
    """Number of documents of each fold with each feature; of the wanted ones if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None if wanted is None else _Finder(wanted)
        for rows, blocks in _restored(batches, Decoder(model), 0):
            features, docs = _features(blocks, finder)
            folds = rows.column(1).to_numpy()[docs]
            for fold in np.unique(folds):
                found, n = np.unique(features[folds == fold], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), fold, np.int32)), pa.array(n, pa.int64())], ["feature", "fold", "n"])

    return run


def fit(texts: DataFrame, labels: DataFrame, model: np.ndarray, *, train_rows: int = TRAIN_ROWS) -> Scorer:
    """A scorer fitted on labels ``id``, ``toxic``."""
    sample = labels.where("id is not null and toxic is not null").orderBy(F.xxhash64("id"), "id", "toxic").limit(train_rows)
    sample = kept(sample.withColumnRenamed("id", "__id"))
    rows = texts.join(F.broadcast(sample), "__id").select(F.lower("__text").alias("text"), "toxic")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    rows = kept(rows.withColumn("fold", fold).repartition(partitions_of(texts.sparkSession)))
    toxic, clean = rows.where("toxic > 0").select("text", "fold"), rows.where("toxic <= 0").select("text", "fold")
    n = {r["t"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (n.get(True, 0) + 1) / (sum(n.values()) + 20)

    def count(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        each = texts.mapInArrow(_count(model, wanted), "feature long, fold int, n long").groupBy("feature")
        return each.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)])

    parts = lambda table: np.stack([table.column(c).to_numpy().astype(float) for c in ("n", *[f"n{k}" for k in range(FOLDS)])])
    counted = kept(count(toxic, None).where(F.col("n") >= MIN_TOXIC))
    counted = counted.toArrow()  # a row for each feature of MIN_TOXIC documents of the sample
    features = counted.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(features)
    features, a = features[order], parts(counted)[:, order]
    others = count(clean, features).toArrow()
    b = np.zeros_like(a)
    b[:, np.searchsorted(features, others.column("feature").to_numpy().view(np.uint64))] = parts(others)
    a[1:], b[1:] = a[0] - a[1:], b[0] - b[1:]  # of all documents, then of all but each fold's
    p = (a + 10 * share) / (a + b + 10)
    limits = p - 3 * np.sqrt(p * (1 - p) / (a + b + 10))
    useful = limits[0] > share
    scorer = Scorer(model, features[useful], limits[0][useful])
    judged = rows.select("text", "fold", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(_judge(scorer, limits[1:][:, useful]), "toxic int, evidence double")
    counts = np.zeros((STEPS + 1, 2))
    for r in judged.groupBy("toxic", F.floor(F.col("evidence") * STEPS).cast("int").alias("step")).count().collect():
        counts[r["step"], r["toxic"]] = r["count"]
    scorer.shares = rising_shares(counts, share)
    return scorer


def rising_shares(counts: np.ndarray, share: float) -> np.ndarray:
    """Share of the second column in each row, pooled with neighbours until it rises throughout."""
    pools: list[list[float]] = []
    for clean, toxic in counts:
        pools.append([toxic + 2 * share if clean + toxic else 0.0, clean + toxic + 2 if clean + toxic else 0.0, 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][1] == 0 or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            x = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], x, strict=True)]
    return np.repeat([x[0] / x[1] if x[1] else share for x in pools], [int(x[2]) for x in pools])


class Scorer:
    """Evidence and score of texts."""

    def __init__(self, model: np.ndarray, features: np.ndarray, limits: np.ndarray):
        self.model, self.features, self.limits = model, features, limits
        self.shares = np.linspace(0, 1, STEPS + 1)

    def evidence(self, blocks: tuple[Block, ...], limits: np.ndarray | None = None, fold: np.ndarray | None = None) -> np.ndarray:
        """The largest limit of each document's features; with ``limits``, a row for each fold, that of its fold."""
        best = np.zeros(len(blocks[0].offsets) - 1)
        finder = _Finder(self.features)
        for found, doc in (x for block in blocks for x in _hashed(block)):
            at, k = finder(found)
            np.maximum.at(best, doc[at], self.limits[k] if limits is None else limits[fold[doc[at]], k])
        return np.clip(best, 0, 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """The share at the evidence; a hundredth of it is the evidence itself, which orders texts of one step."""
        return 0.99 * self.shares[np.floor(evidence * STEPS).astype(np.int64)] + 0.01 * evidence


def _judge(scorer: Scorer, limits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, blocks in _restored(batches, Decoder(scorer.model), 0):
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(scorer.evidence(blocks, limits, rows.column(1).to_numpy()))], ["toxic", "evidence"])

    return run


def _score(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, blocks in _restored(batches, Decoder(scorer.model), 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(scorer.score(scorer.evidence(blocks)))], ["__id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, limit: float = LIMIT) -> DataFrame:
    """One row for each input row: the id, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Labels of the fold whose crc32 of the id is 2 modulo 4 are held out.  The
    score depends on the text alone.  Null and empty texts have the score of a
    text without a telling word, below ``limit``.  Equal texts have equal scores,
    and of readings that are equally likely the decoder takes the first.
    Repeated labels count each as often as they stand; labels without a
    document, an id or a value are ignored.  Without toxic labels all scores are
    alike.  Rows without an id are scored, and not held out.  Texts may have any
    length.  Other columns are ignored, whatever their names.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2
    own = plain_texts(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("toxic")).where(~fold("id"))
    model = character_model(own)
    scorer = fit(own, known, model, train_rows=train_rows)
    scored = own.select("__id", F.lower("__text").alias("__text"), F.coalesce(fold("__id"), F.lit(False)).alias("held_out")).mapInArrow(_score(scorer), "__id long, held_out boolean, score double")
    return scored.select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= limit).cast("int").alias("predicted"))
