"""Texts of Arrow batches as flat numpy arrays, and where intermediate tables are kept.

The operators on bytes, words and windows read each Arrow batch as one run of
bytes plus document offsets, so that hashing, splitting and window minima are
array operations over many documents at once and no Python string is built.
A block holds about ``BLOCK_BYTES`` of text (or one longer document), which
bounds the memory of a task whatever the size of its partition.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, NullType, StructField, StructType

from ..session import scratch

BLOCK_BYTES = 2 << 20
#: Bytes of text that hashes are computed over at once; a longer text is hashed piece by piece.
PIECE_BYTES = 4 << 20
#: Bytes of text in one part of the documents (one task holds it in memory) and for which one more bucket of an exchange is made.
PART_BYTES, BUCKET_BYTES = 8 << 20, 128 << 20
#: The place of rows without an id in the order of ids: after all others.
NO_ID = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20_240_917)
#: One random 64-bit value for each byte, so that equal sums of bytes don't collide.
BYTE_VALUES = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no part of a word of letters and digits; all bytes of characters beyond ASCII are.
NO_LETTER = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_powers: dict[str, np.ndarray] = {}


@dataclass
class Block:
    """Documents laid end to end: document i is ``data[offsets[i]:offsets[i + 1]]``."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def doc_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks; a null is an empty text."""
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column))
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:  # Arrow leaves it open what lies under a null
        column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Block(slice(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def ids_of(column: pa.Array) -> np.ndarray:
    """A column of ids as int64; rows without an id come last."""
    column = column.cast(pa.int64())
    return (column.fill_null(NO_ID) if column.null_count else column).to_numpy(zero_copy_only=False)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + (64 << 10))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (the splitmix64 finaliser); works on a copy."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse_powers(at: np.ndarray, upto: int) -> np.ndarray:
    """Powers of the inverse of the hash base at places below ``upto``, from one table of a piece and one of pieces."""
    down = powers(min(upto, PIECE_BYTES))[1]
    if upto <= PIECE_BYTES:
        return down[at]
    far = np.full(upto // PIECE_BYTES + 1, down[-1:] * _INVERSE, np.uint64)
    far[0] = 1
    return down[at % PIECE_BYTES] * np.multiply.accumulate(far)[at // PIECE_BYTES]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte value times power up to each position; differences of two give the hash of what lies between."""
    sums = np.zeros(len(data) + 1, np.uint64)
    up = powers(min(len(data), PIECE_BYTES))[0]
    scale = np.uint64(1)
    for a in range(0, len(data), PIECE_BYTES):
        piece = data[a : a + PIECE_BYTES]
        part = sums[a + 1 : a + 1 + len(piece)]
        np.cumsum(BYTE_VALUES[piece] * up[: len(piece)], out=part)
        if a:
            part *= scale
            part += sums[a]
        if a + PIECE_BYTES < len(data):
            with np.errstate(over="ignore"):
                scale = scale * up[-1] * _BASE
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, independent of where they lie."""
    x = (sums[ends] - sums[starts]) * _inverse_powers(starts, len(sums))
    return mix(x ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of spans sorted by start, in pieces of the data, so that sums and powers don't grow with the longest text."""
    if len(data) <= PIECE_BYTES:
        return span_hashes(prefix_hashes(data), starts, ends)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + PIECE_BYTES)))
        high = int(ends[i:j].max())
        out[i:j] = span_hashes(prefix_hashes(data[low:high]), starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


@dataclass
class Words:
    """Word i is ``data[starts[i]:ends[i]]``; document d has the words ``first[d]:first[d + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(block: Block, between: np.ndarray = _SPACE) -> Words:
    """The runs of bytes other than those marked in ``between`` (space and 0x09-0x0D), which never cross documents."""
    n = len(block.data)
    solid = np.zeros(n + 1, bool)
    np.logical_not(between[block.data], out=solid[:n])
    heads = block.offsets[:-1][np.diff(block.offsets) > 0]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[heads] = solid[heads]
    closes = np.zeros(n + 1, bool)
    closes[1:] = solid[:-1] & ~solid[1:]
    inner = heads[heads > 0]
    closes[inner] = solid[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def word_windows(hashes: np.ndarray, first: np.ndarray, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``width`` words and the index of their first words.

    Only windows within one document are returned, in order.  The two lanes
    are independent hashes of the same windows.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    base = np.uint64((0xD1342543DE82EF95, 0xDA942042E4DD58B5)[lane])
    hashes = hashes if lane == 0 else mix(hashes, 77)
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= base
        total += hashes[k : n + k]
    doc_end = np.repeat(first[1:], np.diff(first))
    whole = np.flatnonzero(np.arange(n) + width <= doc_end[:n])
    return mix(total[whole], width), whole


def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the places where each list begins, with the end added."""
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, kind))


class _Made(threading.local):
    """Tables that this thread has kept and not forgotten, so that threads can't delete each other's."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def kept(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    Unlike a cached table it outlives the executors that made it.  It stays
    until ``forget`` is called or the program ends.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    _made.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_so_far() -> int:
    """How many tables this thread has kept and not forgotten."""
    return len(_made.paths)


def forget(spark: SparkSession, since: int = 0, spare: int = 0) -> None:
    """Delete tables that this thread has kept, but for the first ``since`` and the last ``spare``; nothing that is still to be computed may read them."""
    stop = len(_made.paths) - spare
    for path in _made.paths[since:stop]:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made.paths[since:stop]


def partitions_of(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def deal_of(own: DataFrame) -> tuple[int, int]:
    """Buckets of an exchange of hashes, and parts into which documents are dealt for cogroups, by the bytes of the texts.

    There are as many buckets as shuffle partitions, and more where one would
    have to take over ``BUCKET_BYTES`` of text; a part has about ``PART_BYTES``
    whatever the session's settings.
    """
    n = own.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    return max(partitions_of(own.sparkSession), -(-n // BUCKET_BYTES)), max(1, -(-n // PART_BYTES))


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The group of each document id; the same as the column ``part`` of ``dealt_texts``."""
    return (mix(ids.astype(np.int64).view(np.uint64), 3) % np.uint64(parts)).astype(np.int32)


def _with_part(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(part_of(ids_of(batch.column(0)), parts), pa.int32())
            yield pa.RecordBatch.from_arrays([part, *batch.columns], ["part", *batch.schema.names])

    return run


def plain_texts(docs: DataFrame, id_col: str, text_col: str, carry: str | None = None) -> DataFrame:
    """``__id``, ``__text``, and if asked a struct of all columns but the text; whatever the names of other columns.

    Ids are whole numbers or null.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias(carry)] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *rest)


def dealt_texts(own: DataFrame, parts: int) -> DataFrame:
    """The rows of ``plain_texts`` with ``part``, the key of the cogroups that bring findings back to their documents.

    A plan that cogroups by ``part`` several times exchanges the texts once
    (equal exchanges are reused within a query).
    """
    return own.mapInArrow(_with_part(parts), StructType([StructField("part", IntegerType()), *own.schema.fields]))


def column_of(table: pa.Table, name: str) -> pa.Array:
    """A table's column as one array."""
    x = table.column(name).combine_chunks()
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in columns that are sorted together."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pieces(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut sorted keys into slices of about ``most`` rows; a key's rows may span slices."""
    for a in range(0, len(keys), most):
        yield a, min(a + most, len(keys))
