"""Operator 13: quality of texts by how well good and bad examples help to compress them.

Two zstandard dictionaries are trained, on texts labelled good and on texts
labelled bad.  A text is compressed in pieces of ``PIECE`` bytes with either; the
difference of both sizes, divided by the length of the text, says which examples
it is like.  A text that says next to nothing (one word again and again)
compresses to nothing with either, so the smaller size by length counts too.  A
logistic curve over both, fitted on labels, makes the score.

For that fit a labelled text is compressed with dictionaries of the other
``FOLDS`` - 1 parts of the sample (copies of a text are in one part), since its
own would flatter it.

Scale.  One pass over the texts, without an exchange; a piece has no state, so
memory doesn't grow with a text.  What is learned from is bounded: about
``TRAIN_ROWS`` labelled documents, half of them of either label where there are
so many, and about ``TRAIN_PIECES`` pieces of theirs for each label, drawn by
hash.  The dictionaries are trained in tasks, one for each part and label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, Block, ids_of, kept, plain_texts, text_blocks

#: Bytes of a dictionary and of a piece, and the level of compression.
DICTIONARY, PIECE, LEVEL = 256 << 10, 2048, 3
#: Labelled documents and pieces for each label that are learned from, at most (about, as they are drawn by hash).
TRAIN_ROWS, TRAIN_PIECES, FOLDS = 40_000, 8_192, 3
#: Bytes that are added to a text's length, and to its compressed size, so that a few characters prove little.
_LENGTH, _SIZE = 32, 4
_GRAIN = 1 << 30


def trained(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of samples; where they are too few or too small to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
    if len(dictionary) < 8:  # less is no dictionary
        return zstandard.ZstdCompressor(**how)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **how)


class Sizes:
    """Compressed sizes of texts with a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = _compressor(good), _compressor(bad)

    def of(self, block: Block) -> np.ndarray:
        """For each document its bytes and both compressed sizes."""
        data = memoryview(np.ascontiguousarray(block.data))
        out = np.zeros((len(block.offsets) - 1, 3), np.int64)
        for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)):
            out[i, 0] = b - a
            for k, compressor in enumerate(self.both):
                out[i, k + 1] = sum(len(compressor.compress(data[c : min(c + PIECE, b)])) for c in range(a, b, PIECE))
        return out


def features(sizes: np.ndarray) -> np.ndarray:
    """Difference of the compressed sizes, and logarithm of the smaller one, both by length."""
    n, good, bad = sizes.T.astype(float)
    return np.stack([(bad - good) / (n + _LENGTH), np.log((np.minimum(good, bad) + _SIZE) / (n + _LENGTH))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Factors of the features and the constant that make the labels likeliest (Newton's method, slightly held back)."""
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(b)), a.T @ (weight * (y - p)) - 1e-2 * b)
        b += step
        if abs(step).max() < 1e-9:
            break
    return np.append(b[:-1] / spread, b[-1] - (b[:-1] * middle / spread).sum())


@dataclass(frozen=True)
class Classifier:
    """Dictionaries and the curve.  Without examples of both labels there are no dictionaries and the score is a constant."""

    good: bytes
    bad: bytes
    factors: tuple[float, ...]

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        z = features(sizes) @ np.array(self.factors[:-1]) + self.factors[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """For each row its id, ``n_bytes``, ``good_bytes`` and ``bad_bytes`` (compressed with either dictionary) and ``score``.

        A null text is an empty one, which has the score of no evidence.  Rows
        without an id, or with the same, are scored each for itself.  Other
        columns are ignored.
        """
        found = plain_texts(docs, id_col, text_col).mapInArrow(_score(self), "id long, n_bytes long, good_bytes long, bad_bytes long, score double")
        return found.withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumnRenamed("id", id_col)


def _score(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            ids = ids_of(batch.column(0))
            for block in text_blocks(batch.column(1)):
                found = sizes.of(block)
                yield pa.RecordBatch.from_arrays([pa.array(ids[block.rows]), *[pa.array(c) for c in found.T.copy()], pa.array(model.scores(found))], ["id", "n_bytes", "good_bytes", "bad_bytes", "score"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts (``text``, ``label``, ``fold``), each with its place."""
    for batch in batches:
        label, fold, key = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for block in text_blocks(batch.column(0)):
            rows = [(block.rows.start + i, a - block.offsets[i], block.data[a : min(a + PIECE, block.offsets[i + 1])].tobytes()) for i in range(len(block.offsets) - 1) for a in range(block.offsets[i], block.offsets[i + 1], PIECE)]
            names, kinds = ["label", "fold", "key", "place", "piece"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [[label[r[0]] for r in rows], [fold[r[0]] for r in rows], [key[r[0]] for r in rows], [int(r[1]) for r in rows], [r[2] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _dictionary(size: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("draw", "ascending"), ("key", "ascending"), ("place", "ascending")])
        data = trained(rows.column("piece").to_pylist(), size)
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "label": pa.array([rows.column("label")[0].as_py()], pa.int32()), "dictionary": pa.array([data], pa.binary())})

    return run


def _compared(dictionaries: dict[tuple[int, int], bytes]):
    """Sizes of labelled texts with the dictionaries of the other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: Sizes(dictionaries.get((k, 1), b""), dictionaries.get((k, 0), b"")) for k in range(FOLDS)}
        for batch in batches:
            label, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for block in text_blocks(batch.column(0)):
                found = np.zeros((block.rows.stop - block.rows.start, 3), np.int64)
                for i in range(len(found)):
                    one = Block(slice(0, 1), block.data[block.offsets[i] : block.offsets[i + 1]], np.array([0, block.offsets[i + 1] - block.offsets[i]]))
                    found[i] = own[int(fold[block.rows][i])].of(one)
                yield pa.RecordBatch.from_arrays([pa.array(label[block.rows]), *[pa.array(c) for c in found.T.copy()]], ["label", "n", "good", "bad"])

    return run


def _drawn(share: float, *key: Column) -> Column:
    """Rows that a draw by hash takes, about ``share`` of them."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(*key), F.lit(_GRAIN)) < int(share * _GRAIN)


def _by_label(shares: dict[int, float], *key: Column) -> Column:
    return F.coalesce(*[F.when(F.col("label") == k, _drawn(s, *key)) for k, s in shares.items()], F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_pieces: int = TRAIN_PIECES, dictionary: int = DICTIONARY) -> Classifier:
    """A classifier out of labels 1 (good) and 0 (bad) of documents.

    Other labels, labels without an id and labels of no document are ignored;
    equal labels of one id count once, as do rows of documents with the same id
    and text; a document with both labels counts for both.
    """
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label")).where("__id is not null and label in (0, 1)").distinct()
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    shares = {k: min(1.0, train_rows / 2 / n) for k, n in counts.items()}
    chosen = known.where(_by_label(shares, F.col("__id"), F.lit(1))) if shares else known
    texts = plain_texts(docs, id_col, text_col).select("__id", F.coalesce("__text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "__id").dropDuplicates(["__id", "label", "text"])  # about train_rows ids
    sample = kept(sample.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("__id").alias("key")))
    about = {r["label"]: r for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.octet_length("text") / PIECE)).alias("pieces")).collect()}
    if set(about) != {0, 1}:
        share = (sum(about) + 0.5) / (len(about) + 1)
        return Classifier(b"", b"", (0.0, 0.0, float(np.log(share / (1 - share)))))
    cut = sample.mapInArrow(_cut, "label int, fold int, key long, place long, piece binary")
    taken = {k: min(1.0, train_pieces / max(r["pieces"], 1)) for k, r in about.items()}
    cut = cut.where(_by_label(taken, F.col("key"), F.col("place"), F.lit(2))).withColumn("draw", F.xxhash64("key", "place", F.lit(3)))
    every = F.array(*[F.lit(k) for k in range(FOLDS + 1)])
    dealt = cut.select("*", F.explode(F.filter(every, lambda k: k != F.col("fold"))).alias("part"))  # part FOLDS has all
    made = kept(dealt.groupBy("part", "label").applyInArrow(_dictionary(dictionary), "part int, label int, dictionary binary")).collect()  # a row for each part and label
    dictionaries = {(r["part"], r["label"]): bytes(r["dictionary"]) for r in made}
    seen = sample.select("text", "label", "fold").mapInArrow(_compared(dictionaries), "label int, n long, good long, bad long").toPandas()  # about train_rows rows of numbers
    seen = seen.sort_values(list(seen.columns))
    weight = seen["label"].map({k: counts[k] / about[k]["n"] for k in about}).to_numpy(float)
    factors = logistic(features(seen[["n", "good", "bad"]].to_numpy()), seen["label"].to_numpy(float), weight / weight.mean())
    return Classifier(dictionaries.get((FOLDS, 1), b""), dictionaries.get((FOLDS, 0), b""), tuple(factors.tolist()))


def held_out(id_col: str, folds: int = 5, rest: int = 0) -> Column:
    """Ids whose CRC, as text, leaves this remainder; null is none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == rest, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, rest: int = 0, least: float = 0.3, **how) -> DataFrame:
    """``held_out``, ``score`` (higher: likelier good) and ``predicted`` of every document.

    The classifier learns only from labels of documents that are not held out.
    See ``fit`` and ``Classifier.score`` for nulls, repeated rows and other columns.
    """
    model = fit(docs, labels.where(~held_out(id_col, folds, rest)), id_col=id_col, text_col=text_col, label_col=label_col, **how)
    found = model.score(docs, id_col=id_col, text_col=text_col)
    return found.select(id_col, held_out(id_col, folds, rest).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
