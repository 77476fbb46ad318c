"""Operator 6: removal of lines that are within a few edits of an earlier line.

Segment-partition edit join.  A line is cut into ``EDITS`` + 1 segments; of two
lines within ``EDITS`` edits, one segment of the shorter stands unchanged in the
other, near its own place.  The lines' segments form an index by length and
number of the segment, which the substrings of each line probe at the places
that the difference in length leaves open.

Hashes of lines, segments and probes are exchanged first.  They tell the first
place of each different line, and which segments a different line meets.  Only
first places of lines with such a segment then send their bytes, to the task of
the segment, where pairs are verified by a bit-parallel edit distance in a band
around the diagonal, after common ends and counts of characters have dismissed
most.

Hot segments.  Lines with a segment that over ``HOT`` different lines share
(templates, whose lines differ in a number) are not compared in such a group.
They are cut into ``FINER`` more segments than they may have edits, and two
lines meet if all segments but one, or but two that both differ, stand in
either.  Groups of such lines that are still hot are cut again, and now only
what they don't share: a fifth of the text, or two fifths, of which either has
one edit and so one of them is enough to find a pair by.  So the text shrinks
until groups are small or no more than the edits are left of a line, when all
lines of one length are near each other.

Scale.  Texts are exchanged twice, to send lines and to cut them, copies of a
line once for each block that holds them, and lines with hot segments once more
for each group that they meet another line in.  Hashes of the finer segments,
95 for a line of two edits, are exchanged for lines with hot segments alone.
Groups are sorted by Spark and pass a task one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import Block, column_of, deal_of, dealt_texts, ids_of, kept, lists, mix, part_of, plain_texts, prefix_hashes, span_hashes, starts_of, text_blocks

#: Edits within which lines are the same, and the length from which on all of them are allowed.
EDITS, LEAST = 2, 40
#: Different lines with one segment that are compared with each other, and how many segments more than edits lines of more such are cut into.
HOT, FINER = 64, 3
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def lines_of(block: Block) -> tuple[np.ndarray, ...]:
    """Start and end of each line without its \\n, start and end without white space around, and its document."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, block.offsets[1:]]), kind="stable")
    inside = np.searchsorted(breaks, block.offsets)
    doc = np.repeat(np.arange(len(block.offsets) - 1), np.diff(inside) + 1)
    solid = np.flatnonzero(~_BLANK[block.data])
    if not len(solid):
        return starts, ends, starts, starts, doc
    first = np.searchsorted(solid, starts)
    begin = np.minimum(np.append(solid, len(block.data))[first], ends)
    stop = np.maximum(solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1, begin)
    return starts, ends, begin, np.where(begin < ends, stop, begin), doc


def segments(size: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of segment i of lines of these sizes; the last ones are longer by one if the size asks for it."""
    base, longer = size // (edits + 1), size % (edits + 1)
    short = edits + 1 - longer
    return base * i + np.maximum(i - short, 0), base + (i >= short)


def tiers_of(edits: int, least: int, whole: bool) -> list[tuple[int, int, int]]:
    """Edits allowed to pairs whose shorter line has a length from the one number to below the other."""
    if not whole:
        return [(edits, least, 1 << 62)]
    starts = [-(-least * k // edits) for k in range(1, edits + 1)]
    return [(k, low, high) for k, low, high in zip(range(1, edits + 1), starts, [*starts[1:], 1 << 62], strict=True) if low < high]


def _cuts(sums: np.ndarray, begin: np.ndarray, size: np.ndarray, tier: tuple[int, int, int], shorter: int, places: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Hashes of the segments of lines that are shorter by so much, where the lines may hold them, and whether at another place than their own.

    Yields hash, line, start and stop in bytes, and the last.  Begins and sizes
    are bytes, or characters that begin at ``places``.
    """
    edits, least, most = tier
    length = size - shorter
    for i in range(edits + 1):
        at, n = segments(length, i, edits)
        tag = mix((length * (edits + 1) + i).astype(np.uint64), 31 + 100 * edits)
        low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
        for move in range(low, high + 1):
            own = np.flatnonzero((length >= least) & (length < most) & (at + move >= 0) & (at + move + n <= size))
            start = (begin + at + move)[own]
            stop = start + n[own]
            if places is not None:
                start, stop = places[start], places[stop]
            yield mix(span_hashes(sums, start, stop) ^ tag[own], 32), own, start, stop, move != 0


class _Lines:
    """Lines of a block, or what is left of lines, with sums for their hashes and their places in bytes or characters."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, whole: bool):
        self.data, self.begin, self.size = data, begin, size
        self.sums = prefix_hashes(data)
        heads = (data & 0xC0) != 0x80 if whole else None
        before = np.append(0, np.cumsum(heads, dtype=np.int64)) if whole else None
        self.units = (before[begin], before[begin + size] - before[begin], np.append(np.flatnonzero(heads), len(data))) if whole else (begin, size, None)

    def cuts(self, tier: tuple[int, int, int], shorter: int) -> Iterator[tuple[np.ndarray, ...]]:
        return _cuts(self.sums, *self.units[:2], tier, shorter, self.units[2])

    def keys(self, tiers: list[tuple[int, int, int]], buckets: int) -> Iterator[tuple]:
        """Key (a bucket in the upper half and 31 bits), line and role of segments (0) and probes (1), then start and stop, tier and difference in length."""
        for k, tier in enumerate(tiers):
            for shorter in range(tier[0] + 1):
                for h, own, start, stop, moved in self.cuts(tier, shorter):
                    key = (((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32) | (h & np.uint64(0xFFFFFFFE)).astype(np.int64)
                    yield key, own, int(shorter > 0 or moved), start, stop, k, shorter

    def text(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.begin[i] + self.size[i]].tobytes()


def _long_lines(block: Block, least: int) -> tuple[np.ndarray, ...]:
    """Of the lines of ``least`` bytes or more: number in the document, start, size, document, hash."""
    _, _, begin, stop, doc = lines_of(block)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    own = stop - begin >= least
    sums = prefix_hashes(block.data)
    return number[own], begin[own], (stop - begin)[own], doc[own], span_hashes(sums, begin[own], stop[own])


_DEALT = "bucket int, lines array<long>, docs array<long>, numbers array<int>, parts array<int>, keys array<int>, tags array<int>, key_parts array<int>"
_DEALT_NAMES = [x.split()[0] for x in _DEALT.split(", ")]


def _first_of_each(line: np.ndarray, id_: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The first place of each different line."""
    o = np.lexsort((number, id_, line))
    return o[starts_of(line[o])]


def _dealt_keys(found: list[tuple], line: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_DEALT`` with keys, the lines' tags and parts, one for each bucket."""
    keys = np.concatenate([x[0] | x[2] for x in found])
    own = np.concatenate([x[1] for x in found])
    bucket = keys >> 32
    o = np.argsort(bucket.astype(np.uint16) if len(bucket) and int(bucket.max()) < 1 << 16 else bucket, kind="stable")
    bucket, keys, own = bucket[o].astype(np.int32), keys[o].astype(np.uint32).view(np.int32), own[o]
    row_at = starts_of(bucket)
    cuts, none, no_int = np.append(row_at, len(bucket)), pa.nulls(len(row_at), pa.list_(pa.int64())), pa.nulls(len(row_at), pa.list_(pa.int32()))
    tags = line.view(np.uint64).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket[row_at]), none, none, no_int, no_int, lists(keys, cuts, pa.int32()), lists(tags[own], cuts, pa.int32()), lists(part[own], cuts, pa.int32())], _DEALT_NAMES)


def _deal(tiers: list[tuple[int, int, int]], least: int, whole: bool, buckets: int, parts: int):
    """Mapper: different lines of a block with their first places, and the keys of their segments and probes, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch.column(0))
            own_part = part_of(ids, parts)
            for block in text_blocks(batch.column(1)):
                number, begin, size, doc, line = _long_lines(block, least)
                if not len(line):
                    continue
                id_, part = ids[block.rows][doc], own_part[block.rows][doc]
                o = np.lexsort((number, id_, part, line))
                head = o[starts_of(line[o], part[o])]  # the first place in each part
                bucket = ((line[head] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                head, bucket = head[np.argsort(bucket, kind="stable")], np.sort(bucket)
                row_at = starts_of(bucket)
                cuts, none = np.append(row_at, len(bucket)), pa.nulls(len(row_at), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[row_at]), lists(line[head].view(np.int64), cuts, pa.int64()), lists(id_[head], cuts, pa.int64()), lists(number[head], cuts, pa.int32()), lists(part[head], cuts, pa.int32()), none, none, none], _DEALT_NAMES)
                once = _first_of_each(line, id_, number)
                yield _dealt_keys(list(_Lines(block.data, begin[once], size[once], whole).keys(tiers, buckets)), line[once], part[once])

    return run


_TOLD = "part int, lines array<long>, docs array<long>, numbers array<int>, keys array<long>"


def _told(part: np.ndarray, columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    """Rows of ``_TOLD``, one for each part, from flat columns sorted by part."""
    row_at = starts_of(part)
    cuts = np.append(row_at, len(part))
    arrays = [pa.array(part[row_at].astype(np.int32))]
    for name, kind in (("lines", pa.int64()), ("docs", pa.int64()), ("numbers", pa.int32()), ("keys", pa.int64())):
        arrays.append(lists(columns[name], cuts, kind) if name in columns else pa.nulls(len(row_at), pa.list_(kind)))
    return pa.RecordBatch.from_arrays(arrays, ["part", "lines", "docs", "numbers", "keys"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer: first places of lines that stand in several parts, and keys of segments that a different line meets."""
    bucket, columns = 0, [[] for _ in range(7)]
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column(0)[0].as_py()
            for to, column in zip(columns, batch.columns[1:], strict=True):
                to.append(column.flatten().to_numpy())
    if not columns[0]:
        return
    line, doc, number, part, key, tag, key_part = (np.concatenate(x) for x in columns)
    columns.clear()
    if len(line):
        o = np.lexsort((number, doc, line))
        line, doc, number, part = line[o], doc[o], number[o], part[o]
        head = starts_of(line)
        times = np.diff(np.append(head, len(line)))
        first = np.repeat(head, times)
        several = np.repeat(times > 1, times)
        line, doc, number, part = line[several], doc[first][several], number[first][several], part[several]
        o = np.lexsort((line, part))
        line, doc, number, part = line[o], doc[o], number[o], part[o]
        head = starts_of(part, line)
        if len(head):
            yield _told(part[head], {"lines": line[head], "docs": doc[head], "numbers": number[head]})
    if len(key):
        # The segment without its role, with its place, sorts as a plain value and dismisses most that stand alone.
        x = np.sort(((key.view(np.uint32) >> np.uint32(1)).astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64))
        head = starts_of(x >> np.uint64(32))
        times = np.diff(np.append(head, len(x)))
        at = (x[np.repeat(times > 1, times)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own, tag, role, part = key[at].view(np.uint32) >> np.uint32(1), tag[at], key[at] & 1, key_part[at]
        o = np.lexsort((tag, own))
        own, tag, role, part = own[o], tag[o], role[o], part[o]
        if not len(own):
            return
        head = starts_of(own)
        times = np.diff(np.append(head, len(own)))
        new = np.zeros(len(own), np.int64)
        new[starts_of(own, tag)] = 1
        different, indexed = np.add.reduceat(new, head), np.minimum.reduceat(role, head) == 0
        wanted, hot = np.repeat((different > 1) & indexed, times), np.repeat(different > HOT, times)
        key, part = ((np.int64(bucket) << 32) | (own.astype(np.int64) << 1) | hot)[wanted], part[wanted].astype(np.int64)
        o = np.lexsort((key, part))
        key, part = key[o], part[o]
        head = starts_of(part, key)
        if len(head):
            yield _told(part[head], {"keys": key[head]})


def _column(table: pa.Table, name: str) -> np.ndarray:
    return column_of(table, name).flatten().to_numpy() if table.num_rows else np.empty(0, np.int64)


def _first_places(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines (sorted) and the earliest place told of each."""
    line, doc, number = _column(told, "lines"), _column(told, "docs"), _column(told, "numbers")
    o = np.lexsort((number, doc, line))
    line, doc, number = line[o], doc[o], number[o]
    head = starts_of(line)
    return line[head], doc[head], number[head]


def _later(line: np.ndarray, doc: np.ndarray, number: np.ndarray, told: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether an earlier place than its own is told of each line."""
    known, docs, numbers = told
    if not len(known):
        return np.zeros(len(line), bool)
    at = np.minimum(np.searchsorted(known, line), len(known) - 1)
    return (known[at] == line) & ((docs[at] < doc) | ((docs[at] == doc) & (numbers[at] < number)))


def _first_lines(docs: pa.Table, told: pa.Table, least: int) -> Iterator[tuple[Block, np.ndarray, ...]]:
    """Blocks of one part with the lines that stand in their first place of all: id, number, begin, size, hash."""
    firsts, ids, before = _first_places(told), ids_of(column_of(docs, "__id")), np.empty(0, np.int64)
    for block in text_blocks(column_of(docs, "__text")):
        number, begin, size, doc, line = _long_lines(block, least)
        line, id_ = line.view(np.int64), ids[block.rows][doc]
        once = _first_of_each(line, id_, number)
        once = once[~_later(line[once], id_[once], number[once], firsts) & ~np.isin(line[once], before)]
        before = np.concatenate([before, line[once]])
        if len(once):
            yield block, id_[once], number[once], begin[once], size[once], line[once]


_SENT = "key long, role int, doc long, number int, line long, part int, text binary, tier int"
_SENT_TYPE = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _SENT.split(", "))])


def _send(tiers: list[tuple[int, int, int]], least: int, whole: bool, buckets: int):
    """One part: the bytes of lines in their first places, for each of their keys that something else meets; lines with hot keys once for each tier, without a key."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = np.unique(_column(told, "keys"))
        keys, hot = known & ~np.int64(1), (known & 1) == 1
        rows: list[tuple] = []
        if docs.num_rows and len(known):
            part = column_of(docs, "part")[0].as_py()
            for block, id_, number, begin, size, line in _first_lines(docs, told, least):
                lines, finer = _Lines(block.data, begin, size, whole), np.zeros((len(tiers), len(begin)), bool)
                for key, own, role, _, _, tier, _ in lines.keys(tiers, buckets):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    met = np.flatnonzero(keys[at] == key)
                    finer[tier, own[met[hot[at[met]]]]] = True
                    for j in met[~hot[at[met]]].tolist():
                        i = int(own[j])
                        rows.append((int(key[j]), role, int(id_[i]), int(number[i]), int(line[i]), part, lines.text(i), tier))
                rows += [(None, 0, int(id_[i]), int(number[i]), int(line[i]), part, lines.text(i), tier) for tier, i in zip(*(x.tolist() for x in np.nonzero(finer)), strict=True)]
        return pa.table({f.name: pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_SENT_TYPE)})

    return run


def drops(edits: int) -> list[tuple[int, int, int, int]]:
    """What two lines within so many edits may differ in: segments i and j (the same, or both), how much longer the longer line is, and by how much what lies between is moved in it."""
    last = edits + FINER
    one = [(i, i, longer, longer) for i in range(last) for longer in range(edits + 1)]
    if edits < 2:
        return one
    return one + [(i, j, longer, move) for i in range(last) for j in range(i + 1, last) for longer in range(edits + 1) for move in range(-edits, edits + 1) if abs(move) + abs(longer - move) <= edits]


def _left_out(size, drop: tuple[int, int, int, int], edits: int) -> tuple:
    """Where the two stretches begin and end that a line of this size (or sizes) may have for itself, one behind the other; the first is empty if there is one."""
    i, j, longer, move = drop
    a, n = segments(size - longer, i, edits + FINER - 1)
    if i == j:
        return a, a, a, a + n + longer
    b, m = segments(size - longer, j, edits + FINER - 1)
    return a, a + n + move, b + move, b + m + longer


_HOT = "group long, line long, tier int, doc long, number int, part int, text binary, x binary, y binary, edits int, left int, own long"
_HOT_NAMES = [c.split()[0] for c in _HOT.split(", ")]
_DROPPED = "key long, own long, role int, drop int, first long, second long"


def _hashes(texts: list[bytes]) -> np.ndarray:
    size = np.array([len(x) for x in texts], np.int64)
    stop = np.cumsum(size)
    return span_hashes(prefix_hashes(np.frombuffer(b"".join(texts), np.uint8)), stop - size, stop)


def _hot_rows(same: list[pa.Array], group: np.ndarray, x: list[bytes], y: list[bytes | None], edits: np.ndarray, left: list[int]) -> pa.RecordBatch:
    """Rows of ``_HOT``; ``same``: its columns from line to text.  ``own`` tells a line's rows in a group apart."""
    own = mix(_hashes(x) ^ group.view(np.uint64), 61) ^ mix(_hashes([b"" if t is None else b"y" + t for t in y]) ^ same[0].to_numpy(zero_copy_only=False).view(np.uint64), 62)
    columns = [pa.array(group), *same, pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(edits.astype(np.int32)), pa.array(left, pa.int32()), pa.array(own.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, _HOT_NAMES)


def _begun(tiers: list[tuple[int, int, int]], whole: bool):
    """Lines with hot segments, all of them in one group for each number of edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed_in = np.array([edits for edits, _, _ in tiers])
        for batch in batches:
            text, tier = batch.column(5).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            yield _hot_rows(batch.columns, tier.astype(np.int64), text, [None] * len(text), allowed_in[tier], [len(t.decode("utf-8", "replace")) if whole else len(t) for t in text])

    return run


def _drop(most: int, whole: bool):
    """Keys of all but what is left out, for each way to leave something out of ``x``, with hashes of what that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, allowed_in, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            texts = batch.column(1).to_pylist()
            size, data = np.array([len(x) for x in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)
            lines = _Lines(data, np.cumsum(size) - size, size, whole)
            begin, units, places = lines.units
            at = lambda x: x if places is None else places[x]
            hashed = lambda own, a, b: span_hashes(lines.sums, at(begin[own] + a), at(begin[own] + b))
            for edits in range(1, most + 1):
                for n, drop in enumerate(drops(edits)):
                    i, j, longer, move = drop
                    a, b, c, d = _left_out(units, drop, edits)
                    own = np.flatnonzero((allowed_in == edits) & (units - longer > edits) & (a <= b) & (c <= d))
                    if not len(own):
                        continue
                    a, b, c, d = (x[own] for x in (a, b, c, d))
                    key = mix((units[own] - longer).astype(np.uint64) ^ np.uint64((i * 64 + j) * 8 + edits << 40), 51) ^ group[own].view(np.uint64)
                    for lane, (x, y) in enumerate(((np.zeros(len(own), np.int64), a), (b, c), (d, units[own]))):
                        key = mix(key ^ hashed(own, x, y), 52 + lane)
                    what = [hashed(own, x, y).view(np.int64) for x, y in ((a, b), (c, d))]
                    ints = [np.full(len(own), int(longer > 0 or (i != j and move != 0)), np.int32), np.full(len(own), n, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), row[own], *ints, what[1] if i == j else what[0], what[1])], [x.split()[0] for x in _DROPPED.split(", ")])

    return run


def _stretches(text: bytes, drop: tuple[int, int, int, int], edits: int, whole: bool) -> tuple[tuple[bytes, int], tuple[bytes, int]]:
    """The two stretches that are left out, each with how many characters (or bytes) it has."""
    wide = whole and not text.isascii()
    places = [i for i, x in enumerate(text) if x & 0xC0 != 0x80] + [len(text)] if wide else range(len(text) + 1)
    a, b, c, d = (int(x) for x in _left_out(np.int64(len(places) - 1), drop, edits))
    return (text[places[a] : places[b]], b - a), (text[places[c] : places[d]], d - c)


def _leave(most: int, whole: bool):
    """Lines of hot groups with what they don't share: one stretch with the same edits, or two with one edit each, first that of which the group has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = {edits: drops(edits) for edits in range(1, most + 1)}
        for batch in batches:
            group, allowed_in = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 9))
            x, y, left, edits = [], [], [], allowed_in.copy()
            for k, (text, rest, e, n, swap) in enumerate(zip(*[batch.column(c).to_pylist() for c in (7, 8, 9, 10, 11)], strict=True)):
                drop = every[e][n]
                one, two = _stretches(text, drop, e, whole)
                if drop[0] == drop[1]:
                    two, other = rest, two
                else:
                    edits[k] = 1
                    other, two = (two, one[0]) if swap else (one, two[0])
                x.append(other[0])
                left.append(other[1])
                y.append(two)
            yield _hot_rows(batch.columns[1:7], group, x, y, edits, left)

    return run


_GROUPED = ["key", "role", "doc", "number", "line", "part", "text"]
_SAME = ["line", "tier", "doc", "number", "part", "text"]


def _second(whole: bool):
    """Lines that differ in next to nothing of their first stretch, by their second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(8).to_pylist()
            group = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 63).view(np.int64)
            yield _hot_rows(batch.columns[1:7], group, y, [None] * len(y), np.ones(len(y)), [len(t.decode("utf-8", "replace")) if whole else len(t) for t in y])

    return run


def _finer(hot: DataFrame, tiers: list[tuple[int, int, int]], whole: bool) -> DataFrame:
    """Groups to be compared of lines with hot segments: no more of them at once than ``HOT`` rows, or lines of which little is left.

    A line is in one group with all others first.  In each round the lines of a
    group get the keys of what they may share; lines that meet are compared, or
    where too many meet go on, in the group of their key, with what is left.
    """
    most = max(edits for edits, _, _ in tiers)
    rows = kept(hot.select(_SAME).dropDuplicates(["line", "tier", "doc", "number"]).mapInArrow(_begun(tiers, whole), _HOT))
    groups = []
    while not rows.isEmpty():
        little = F.col("left") <= 2 * F.col("edits")
        last = F.xxhash64("group", F.lit("left")).alias("key"), (F.col("left") > F.col("edits")).cast("int").alias("role")
        groups.append(rows.where(little & F.col("y").isNull()).select(*last, *_GROUPED[2:]))
        turned = rows.where(little & F.col("y").isNotNull()).mapInArrow(_second(whole), _HOT)
        own = rows.where(F.col("left") > F.col("edits"))
        keys = own.select("group", "x", "edits", "own").mapInArrow(_drop(most, whole), _DROPPED)
        meets = [F.min("own") != F.max("own"), F.min("role") == 0, F.min("first") != F.max("first"), F.min("second") != F.max("second")]
        met = keys.groupBy("key").agg((meets[0] & meets[1] & meets[2] & meets[3]).alias("meets"), (F.count(F.lit(1)) > HOT).alias("hot")).where("meets").select("key", "hot")
        found = kept(keys.join(met, "key").join(own.drop("group", "left"), "own"))
        groups.append(found.where("not hot").select(_GROUPED))
        again = found.where("hot")
        swap = again.groupBy("key").agg((F.approx_count_distinct("second") > F.approx_count_distinct("first")).alias("swap"))
        again = again.join(swap, "key").select(F.col("key").alias("group"), *_SAME, "x", "y", "edits", "drop", "swap")
        rows = kept(again.mapInArrow(_leave(most, whole), _HOT).union(turned).dropDuplicates(["own"]))
    return reduce(DataFrame.union, groups)


_BITS = 64


def within(a: bytes | str, b: bytes | str, edits: int) -> bool:
    """Whether two strings are at most ``edits`` (under 30) insertions, deletions or replacements apart.

    Common ends are cut off.  For the rest the dynamic program is computed in a
    band around the diagonal, a column a step: ``up`` and ``down`` have a bit for
    each row of the band where the value is one above or one below the row
    before, and move along the diagonal; the value at the lower edge is counted
    along, first down the diagonal, then along the last row.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    wide = isinstance(a, str)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n].encode("utf-32-be") if wide else a[:n], "big") ^ int.from_bytes(b[:n].encode("utf-32-be") if wide else b[:n], "big")
    unit = 32 if wide else 8
    head = n - (x.bit_length() + unit - 1) // unit
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        x = int.from_bytes(a[-n:].encode("utf-32-le") if wide else a[-n:], "little") ^ int.from_bytes(b[-n:].encode("utf-32-le") if wide else b[-n:], "little")
        tail = n - (x.bit_length() + unit - 1) // unit
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= edits:
        return True
    places: dict[int | str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, edge = (1 << _BITS) - 1, 1 << (_BITS - 1)
    up, down, value = (full << (_BITS - edits - 1)) & full, 0, edits
    last, row = edge >> 1, len(a) - edits
    shift = edits + 1 - _BITS
    for j, c in enumerate(b):
        match = places.get(c, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        right_up, right_down = (down | ~(same | up)) & full, same & up
        if j < row:
            value += not same & edge
        else:
            value += bool(right_up & last) - bool(right_down & last)
            last >>= 1
        if value > 2 * edits + len(b) - len(a):
            return False
        up, down = (right_down | ~((same >> 1) | right_up)) & full, (same >> 1) & right_up
        shift += 1
    return value <= edits


def allowed(a: bytes | str, b: bytes | str, tiers: list[tuple[int, int, int]]) -> int:
    """Edits allowed between two lines, by the length of the shorter; none (-1) if it is too short for any."""
    n = min(len(a), len(b))
    return next((edits for edits, low, high in tiers if low <= n < high), -1)


def alike(a: bytes | str, b: bytes | str, tiers: list[tuple[int, int, int]]) -> bool:
    if isinstance(a, str) != isinstance(b, str):
        a, b = (x if isinstance(x, str) else x.decode("utf-8", "replace") for x in (a, b))
    edits = allowed(a, b, tiers)
    return edits >= 0 and within(a, b, edits)


def _near(tiers: list[tuple[int, int, int]], whole: bool):
    """Which lines are near an earlier one of their key, and that one's place; rows come sorted by key, document and number.  Lines of the same length are tried first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, earlier, done, found = None, {}, set(), []
        for batch in batches:
            for key, role, doc, number, line, part, text in zip(*[c.to_pylist() for c in batch.columns[:7]], strict=True):
                if key != at:
                    at, earlier = key, {}
                if whole and not text.isascii():
                    text = text.decode("utf-8", "replace")
                if line not in done:
                    same = earlier.get(len(text), ())
                    for d, n, other, r, known in chain(same, *[x for size, x in earlier.items() if x is not same]):
                        if (role == 0 or r == 0) and other != line and (d, n) < (doc, number) and alike(known, text, tiers):
                            done.add(line)
                            found.append((part, line, d, n))
                            break
                earlier.setdefault(len(text), []).append((doc, number, line, role, text))
            if len(found) > 1 << 16:
                yield _told_near(found)
                found = []
        if found:
            yield _told_near(found)

    return run


def _told_near(found: list[tuple]) -> pa.RecordBatch:
    part, line, doc, number = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True))
    return _told(part, {"lines": line, "docs": doc, "numbers": number})


def _cut(least: int, with_text: bool, carry: str | None):
    """Drop the lines of one part's documents for which an earlier place is known."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = ids_of(column_of(docs, "__id")), column_of(docs, "__text")
        found = []
        for block in text_blocks(texts):
            number, _, _, doc, line = _long_lines(block, least)
            found.append((line.view(np.int64), ids[block.rows][doc], number))
        line, doc, number = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        told_line, told_doc, told_number = (_column(told, c) for c in ("lines", "docs", "numbers"))
        every = (np.concatenate([told_line, line]), np.concatenate([told_doc, doc]), np.concatenate([told_number, number]))
        o = np.lexsort((every[2], every[1], every[0]))
        head = o[starts_of(every[0][o])]
        firsts = tuple(x[head] for x in every)
        n, removed, digests, kept = [], [], [], []
        for block, (line, doc, number) in zip(text_blocks(texts), found, strict=True):
            later = _later(line, doc, number, firsts)
            starts, ends, begin, stop, owner = lines_of(block)
            gone = np.zeros(len(starts), bool)
            gone[np.flatnonzero(stop - begin >= least)[later]] = True
            at = np.searchsorted(owner, np.arange(len(block.offsets)))
            counts = np.add.reduceat(gone, at[:-1]) if len(gone) else []
            for i in range(len(block.offsets) - 1):
                if counts[i]:
                    left = b"\n".join(block.data[starts[k] : ends[k]].tobytes() for k in range(at[i], at[i + 1]) if not gone[k])
                else:
                    left = block.doc_bytes(i)
                n.append(int(at[i + 1] - at[i]))
                removed.append(int(counts[i]))
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left.decode("utf-8", "replace") if texts[block.rows.start + i].is_valid else None)
        columns = {"__id": docs.column("__id"), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array(kept, pa.string())
        if carry:
            columns[carry] = docs.column(carry)
        return pa.table(columns)

    return run


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, with_text: bool = True, carry: str | None = None, whole: bool = False) -> DataFrame:
    """Remove each line that is within ``edits`` edits of an earlier line of any document.

    Lines are cut at \\n and compared without white space around, as UTF-8
    bytes (an edit inserts, deletes or replaces one); those of fewer than
    ``least`` bytes are neither removed nor compared.  With ``whole``, edits are
    of characters, and shorter lines are allowed as many as their share of
    ``least`` gives, rounded down; exact copies of lines of every length but of
    blank ones are removed.  Earlier is what stands in
    a document with a smaller id, or above in the same; whether the earlier
    line is itself removed doesn't matter.  Returns one row for each input row:
    the id, ``n_lines``, ``n_removed``, ``kept_sha256`` (of the text left), if
    asked ``kept_text``, and under the name ``carry`` a struct of the row's other columns.

    A null text is one empty line, as an empty one is, and stays null.  Rows with the same id
    are one place in the order: equal lines at equal places don't remove each
    other.  Rows without an id are such a place too, after all others.  Lines
    and texts may have any length.
    """
    own = plain_texts(docs, id_col, text_col, carry)
    buckets, parts = deal_of(own)
    texts, tiers = dealt_texts(own, parts), tiers_of(edits, least, whole)
    least = 1 if whole else least
    dealt = own.select("__id", "__text").mapInArrow(_deal(tiers, least, whole, buckets, parts), _DEALT).repartitionById(buckets, F.col("bucket"))
    told = kept(dealt.mapInArrow(_met, _TOLD))
    sent = kept(texts.select("part", "__id", "__text").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_send(tiers, least, whole, buckets), _SENT))
    meeting, hot = sent.where("key is not null").select(_GROUPED), sent.where("key is null")
    if not hot.isEmpty():
        meeting = meeting.union(_finer(hot, tiers, whole))
    near = meeting.repartition(buckets, "key").sortWithinPartitions("key", "doc", "number", "line", "role").mapInArrow(_near(tiers, whole), _TOLD)
    out = StructType([StructField("__id", LongType()), StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), *([StructField("kept_text", StringType())] if with_text else []), *([own.schema[carry]] if carry else [])])
    return texts.groupBy("part").cogroup(told.union(near).groupBy("part")).applyInArrow(_cut(least, with_text, carry), out).withColumnRenamed("__id", id_col)
