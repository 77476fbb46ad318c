"""Operator 11: texts rearranged so that a model learns to fill in their middle.

A text of n units is cut at two of its n + 1 places and, unless it stays plain,
written with sentinels as prefix, suffix, middle (``psm``) or suffix, prefix,
middle (``spm``).  Units are characters (code points), words with the white
space that follows, or lines with their end.

Big-integer bit-parallelism.  The bytes of a text are translated into the digits
of class masks (bytes that begin a code point, white space, line ends), each read
as one integer whose bit i is byte i.  Shifts and Booleans of masks mark where
units begin, ``bit_count`` gives their number, and halving the mask again and
again finds the place of the bit with a given rank.  A long text has a mask for
each ``PIECE`` bytes, the last byte of one carried into the next.

Scale.  Every row is rewritten where it lies: no exchange, no state between
rows, and memory follows the longest text.  The cuts and the form follow from
hashes of the id, so reruns, retried tasks and other partitions agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import plain_texts, text_blocks

#: Bytes in one mask.
PIECE = 1 << 20
#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are rearranged, and of these per cent with the suffix first.
SHARE, SUFFIX_FIRST = 90, 20
UNITS = ("character", "word", "line")


def _digits(chosen) -> bytes:
    return bytes(0x31 if chosen(b) else 0x30 for b in range(256))


_LEADS = _digits(lambda b: b & 0xC0 != 0x80)
_SOLID = _digits(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_ENDS = _digits(lambda b: b == 0x0A)


def mask_of(data: bytes, digits: bytes) -> int:
    """The class of each byte as a bit, the first byte's lowest."""
    return int(data.translate(digits)[::-1], 2) if data else 0


def unit_starts(piece: bytes, unit: str, carry: int) -> tuple[int, int]:
    """Where units begin, as a mask, and the carry for the next piece.

    The carry says of the byte before: part of a word, end of a line.
    """
    if unit == "character":
        return mask_of(piece, _LEADS), 0
    own = mask_of(piece, _SOLID if unit == "word" else _ENDS)
    before = own << 1 | carry
    starts = own & ~before if unit == "word" else before & (1 << len(piece)) - 1
    return starts, own >> len(piece) - 1


def ranked_bit(mask: int, width: int, rank: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it, by halving."""
    place = 0
    while width > 1:
        half = width >> 1
        low = mask & (1 << half) - 1
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, place = mask >> half, width - half, rank - below, place + half
    return place


@dataclass
class Marked:
    """A text with the masks of its pieces."""

    data: bytes
    masks: list[int]
    counts: list[int]

    @classmethod
    def of(cls, data: bytes, unit: str) -> Marked:
        masks, carry = [], int(unit == "line")
        for a in range(0, len(data), PIECE):
            starts, carry = unit_starts(data[a : a + PIECE], unit, carry)
            masks.append(starts)
        return cls(data, masks, [m.bit_count() for m in masks])

    def place(self, rank: int) -> int:
        """The byte at which the unit of this rank begins: 0 for the first, the end of the text after the last."""
        if rank == 0:
            return 0
        for k, n in enumerate(self.counts):
            if rank < n:
                return k * PIECE + ranked_bit(self.masks[k], min(PIECE, len(self.data) - k * PIECE), rank)
            rank -= n
        return len(self.data)


def characters(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return sum(mask_of(data[a : a + PIECE], _LEADS).bit_count() for a in range(0, len(data), PIECE))


def draws(seed: str, key: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 out of the hash of seed and id; no id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(data: bytes, key: int | None, unit: str, sentinels: tuple[bytes, ...], seed: str, share: int, suffix_first: int) -> tuple:
    """``n``, form, characters of prefix and middle (None if plain), and the output."""
    text = Marked.of(data, unit)
    n = sum(text.counts)
    a, b, c, d = draws(seed, key)
    if not data or c % 100 >= share or any(s in data for s in sentinels):
        return n, "plain", None, None, data
    low, high = sorted((a % (n + 1), b % (n + 1)))
    i, j = text.place(low), text.place(high)
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    p, s, m = sentinels
    form, head = ("spm", s + suffix + p + prefix) if d % 100 < suffix_first else ("psm", p + prefix + s + suffix)
    sizes = (low, high - low) if unit == "character" else (characters(prefix), characters(middle))
    return n, form, *sizes, head + m + middle


def _rearrange(*how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for block in text_blocks(batch.column(1)):
                rows = [rearranged(block.doc_bytes(i), key, *how) for i, key in enumerate(keys[block.rows])]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
                size = block.rows.stop - block.rows.start
                rest = [c.slice(block.rows.start, size) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, size), *made, *rest], ["id", "n", "form", "prefix_chars", "middle_chars", "output", *batch.schema.names[2:]])

    return run


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels) or any(s != t and s.startswith(t) for s in sentinels for t in sentinels):
        raise ValueError("three different sentinels are needed, none a beginning of another, whose first characters occur only there")
    return tuple(sentinels)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "character", share: int = SHARE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, seed: str = "1", carry: str | None = None) -> DataFrame:
    """Each document rearranged: id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``share`` per cent of documents are rearranged, of these ``suffix_first``
    per cent as ``spm``; which ones, and where they are cut, follows from the
    hash of ``seed`` and id.  The others, empty texts and those that contain a
    sentinel are plain: the output is the text, both sizes are null.

    A null text is an empty one, a row without an id has the draws of an empty
    id; rows with one id have the same draws.  Every row gives one, repeated ones
    too.  White space before the first word belongs to it.  Texts may have any
    length.  Other columns are ignored, whatever their names, or kept as a
    struct of the name ``carry``.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    own = plain_texts(docs, id_col, text_col, carry)
    how = (unit, tuple(s.encode() for s in _checked(sentinels)), seed, share, suffix_first)
    long = [StructField(n, LongType()) for n in ("id", "n", "prefix_chars", "middle_chars")]
    text = [StructField(n, StringType()) for n in ("form", "output")]
    schema = StructType([long[0], long[1], text[0], long[2], long[3], text[1], *([own.schema[carry]] if carry else [])])
    return own.mapInArrow(_rearrange(*how), schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = _checked(sentinels)
    cut = lambda x, at, side: F.substring_index(x, at, side)
    psm, spm = F.substring(output, len(p) + 1, (1 << 31) - 1), F.substring(output, len(s) + 1, (1 << 31) - 1)
    middle = cut(output, m, -1)
    from_psm = F.concat(cut(psm, s, 1), middle, cut(cut(psm, m, 1), s, -1))
    from_spm = F.concat(cut(cut(spm, m, 1), p, -1), middle, cut(spm, p, 1))
    return F.when(form == "psm", from_psm).when(form == "spm", from_spm).otherwise(output)


def fill_in_middle_digests(docs: DataFrame, **how) -> DataFrame:
    """``fill_in_middle`` with hashes of the output and of the text restored from it, in their place."""
    made = fill_in_middle(docs, **how)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"), how.get("sentinels", SENTINELS))
    return made.select("*", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256")).drop("output")
