"""Operator 2: removal of long repeated byte strings, by a distributed merge sort of suffixes.

Which suffixes.  A string of ``LENGTH`` bytes is judged by the suffix at its
anchor, the smallest hash among its 32-byte grams.  Equal strings have their
anchor at the same place, so it is enough to sort the suffixes at anchors, one
in some 85 bytes, with what stands before them.  One anchor serves a stretch of
neighbouring strings.  Hashes of the anchors' grams are exchanged first; an
anchor whose gram occurs once in all documents can't be part of a repeat and
its suffix is not sorted.

The sort.  Each part of the documents sorts its suffixes, cut to the 200 bytes
that matter, by the bucket of their gram, and sends every bucket one run: the
lengths of common prefixes with the suffix before, and what follows those
(front coding).  Equal suffixes with equal left sides are sent once; they repeat
each other, which their part knows already.  A bucket merges its runs with a
loser tree that keeps for each contender how much it shares with the last winner:
the one that shares more is smaller, and only equal shares are compared, from
there on.  Suffixes with the same gram meet in one bucket, so that the buckets'
orders together hold every neighbourhood that a single order would hold, and no
quantiles have to be guessed.

The answer.  The merge gives common prefixes of neighbours to the right of the
anchors; sorting the left sides of the suffixes of one gram gives them to the
left.  For each distance of a string's start from its anchor, strings are equal
if no smaller common part separates them in either order.

Scale.  Texts are exchanged once, suffixes of repeats once; a bucket holds its
share of the repeated anchors, at most one for each part from however many exact
copies.  Nothing passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, column_of, deal_of, dealt_texts, ids_of, lists, mix, part_of, plain_texts, powers, prefix_hashes, starts_of, text_blocks

LENGTH, GRAM = 200, 32
#: Bytes of one document that are looked at together; longer ones are cut into such pieces, which overlap by a string.
_PIECE = 4 << 20
_LOW = np.uint64((1 << 24) - 1)


def _piece_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash and place of each anchor, and the first and last start of the strings it serves."""
    empty = np.empty(0, np.int64)
    n = len(data) - LENGTH + 1
    whole = np.zeros(max(n, 0) + 1, np.int32)
    ends = offsets[1:] - LENGTH + 1
    long = ends > offsets[:-1]
    if n <= 0 or not long.any():
        return empty.astype(np.uint64), empty, empty, empty
    np.add.at(whole, offsets[:-1][long], 1)
    np.subtract.at(whole, ends[long], 1)
    sums, width = prefix_hashes(data), LENGTH - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(sums) - GRAM])
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    table = padded.reshape(-1, width)
    upto = np.minimum.accumulate(table, axis=1).ravel()
    since = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(since[:n], upto[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
    start = np.flatnonzero(np.cumsum(whole[:-1]))
    anchor = anchor[start]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = start[np.append(head[1:], len(start)) - 1]
    return mix(grams[anchor[head]], 9), anchor[head], start[head], last


def anchors(block: Block) -> tuple[np.ndarray, ...]:
    """As ``_piece_anchors``, for a block of documents of any length."""
    if len(block.data) <= _PIECE:
        return _piece_anchors(block.data, block.offsets)
    found = []
    for d in range(len(block.offsets) - 1):
        for at in range(block.offsets[d], block.offsets[d + 1], _PIECE):
            data = block.data[at : min(at + _PIECE + LENGTH - 1, block.offsets[d + 1])]
            grams, *places = _piece_anchors(data, np.array([0, len(data)]))
            found.append((grams, *[x + at for x in places]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _deal(buckets: int, parts: int):
    """Mapper: the anchors' grams by bucket, each with the parts of the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = part_of(ids_of(batch.column(0)), parts)
            for block in text_blocks(batch.column(1)):
                grams, at, _, _ = anchors(block)
                if not len(grams):
                    continue
                own = part[block.rows][np.searchsorted(block.offsets, at, "right") - 1]
                order = np.lexsort((own, grams))
                grams, own = grams[order], own[order]
                head = starts_of(grams, own)
                twice = np.minimum(np.diff(np.append(head, len(grams))), 2)
                grams, own = np.repeat(grams[head], twice), np.repeat(own[head], twice)
                bucket = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((own, bucket))
                bucket, own, grams = bucket[order], own[order], grams[order].astype(np.uint32).view(np.int32)
                row_at = starts_of(bucket)
                cuts = np.append(row_at, len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[row_at]), lists(own, cuts, pa.int32()), lists(grams, cuts, pa.int32())], ["bucket", "parts", "grams"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer: the grams of one bucket that occur twice or more, for each part that holds them."""
    bucket, parts, grams = 0, [], []
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column(0)[0].as_py()
            parts.append(batch.column(1).flatten().to_numpy())
            grams.append(batch.column(2).flatten().to_numpy())
    if not parts:
        return
    x = np.sort((np.concatenate(grams).view(np.uint32).astype(np.uint64) << np.uint64(32)) | np.concatenate(parts).astype(np.uint64))
    gram = x >> np.uint64(32)
    head = starts_of(gram)
    times = np.diff(np.append(head, len(x)))
    x = np.unique(x[np.repeat(times > 1, times)])
    key, part = (np.int64(bucket) << 32) | (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    key, part = key[order], part[order]
    row_at = starts_of(part)
    if len(row_at):
        yield pa.RecordBatch.from_arrays([pa.array(part[row_at]), lists(key, np.append(row_at, len(part)), pa.int64())], ["part", "keys"])


def _cut_out(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row of ``width`` bytes for each place, read forwards or backwards, with zeros beyond its size."""
    reach = np.arange(width)
    places = np.clip(at[:, None] + step * reach, 0, max(len(data) - 1, 0))
    return np.where(reach < size[:, None], data[places], 0).astype(np.uint8)


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def _text_hashes(block: Block) -> np.ndarray:
    """A hash of each document, whatever its length, without sums over its bytes."""
    return np.array([int.from_bytes(hashlib.blake2b(block.data[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)], np.int64)


_RUN = "bucket int, part int, refs array<long>, places array<long>, ends array<long>, shared binary, sizes binary, tails binary, left_sizes binary, lefts binary, known binary"
_RUN_TYPE = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("refs", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("shared", "sizes", "tails", "left_sizes", "lefts", "known")]])


def _sorted_runs(buckets: int):
    """One part's documents: its suffixes at repeated grams as front-coded sorted runs, one for each bucket.

    Rows with ``ends`` are not runs but findings: starts and ends of bytes that
    the part alone shows to be repeated.
    """

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not docs.num_rows:
            return _RUN_TYPE.empty_table()
        keys = np.unique(column_of(found, "keys").flatten().to_numpy())
        part = column_of(docs, "part")[0].as_py()
        rows, refs, places, bucket = [], [], [], []
        for block in text_blocks(column_of(docs, "__text")):
            grams, at, low, high = anchors(block)
            to = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            own = np.isin((to << 32) | (grams & np.uint64(0xFFFFFFFF)).astype(np.int64), keys)
            at, low, high, to = at[own], low[own], high[own], to[own]
            right, left = LENGTH - at + high, at - low
            rows.append(np.concatenate([_cut_out(block.data, at, right, LENGTH, 1), right[:, None].astype(np.uint8), _cut_out(block.data, at - 1, left, LENGTH - GRAM, -1), left[:, None].astype(np.uint8)], axis=1))
            doc = np.searchsorted(block.offsets, at, "right") - 1
            refs.append(_text_hashes(block)[doc])
            places.append(at - block.offsets[doc])
            bucket.append(to)
        rows, refs, places, bucket = (np.concatenate(x) for x in (rows, refs, places, bucket))
        if not len(rows):
            return _RUN_TYPE.empty_table()
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        rows, refs, places, bucket = rows[order], refs[order], places[order], bucket[order]
        same = np.zeros(len(rows), bool)
        same[1:] = (rows[1:] == rows[:-1]).all(axis=1) & (bucket[1:] == bucket[:-1])
        known = same.copy()
        known[:-1] |= same[1:]
        right, left = rows[:, LENGTH].astype(np.int64), rows[:, -1].astype(np.int64)
        out = []
        if known.any():
            out.append((part % buckets, part, refs[known], places[known] - left[known], places[known] + right[known], None))
        rows, refs, places, bucket, right, left, known = (x[~same] for x in (rows, refs, places, bucket, right, left, known))
        cuts = np.append(starts_of(bucket), len(bucket))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r, le = rows[a:b, :LENGTH], rows[a:b, LENGTH + 1 : -1]
            shared, reach = _common(r, right[a:b]), np.arange(LENGTH)
            tails = r[(reach >= shared[:, None]) & (reach < right[a:b, None])]
            lefts = le[np.arange(le.shape[1]) < left[a:b, None]]
            coded = [x.astype(np.uint8).tobytes() for x in (shared, right[a:b], tails, left[a:b], lefts, known[a:b])]
            out.append((int(bucket[a]), part, refs[a:b], places[a:b], None, coded))
        plain = [pa.array([x[k] for x in out], t.type) for k, t in enumerate(list(_RUN_TYPE)[:5])]
        return pa.Table.from_arrays([*plain, *[pa.array([x[5] and x[5][k] for x in out], pa.binary()) for k in range(6)]], schema=_RUN_TYPE)

    return run


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of strings by a loser tree that never compares a known common prefix again.

    A run has its strings and the length that each shares with the one before.
    Returns, in merged order: run, place in it, and length shared with the string before.
    """
    k = 1 << max(len(runs) - 1, 0).bit_length()
    heads = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    shares = [0 if r[0] else -1 for r in runs] + [-1] * (k - len(runs))  # with the last winner; -1: nothing left
    place = [0] * k
    losers = [0] * k

    def first(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two contenders that share equally much with the last winner."""
        h = shares[a]
        if h < 0:
            return a, b
        x, y = heads[a], heads[b]
        n = min(len(x), len(y))
        rest = int.from_bytes(x[h:n], "big") ^ int.from_bytes(y[h:n], "big")
        n_equal = n - (rest.bit_length() + 7) // 8
        if (x[n_equal] > y[n_equal]) if n_equal < n else len(x) > len(y):
            a, b = b, a
        shares[b] = n_equal
        return a, b

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if shares[a] == shares[b]:
            a, b = first(a, b)
        elif shares[a] < shares[b]:
            a, b = b, a
        winners[node], losers[node] = a, b
    w = winners[1] if k > 1 else 0
    out: tuple[list[int], list[int], list[int]] = [], [], []
    while shares[w] >= 0:
        i = place[w]
        out[0].append(w)
        out[1].append(i)
        out[2].append(shares[w])
        strings, common = runs[w]
        if i + 1 < len(strings):
            place[w], heads[w], shares[w] = i + 1, strings[i + 1], common[i + 1]
        else:
            shares[w] = -1
        node = (w + k) >> 1
        while node:
            other = losers[node]
            if shares[other] > shares[w]:
                losers[node], w = w, other
            elif shares[other] == shares[w]:
                w, losers[node] = first(w, other)
            node >>= 1
    return out


def _decoded(shared: bytes, sizes: bytes, tails: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for h, n in zip(shared, sizes, strict=True):
        last = last[:h] + tails[at : at + n - h]
        at += n - h
        out.append(last)
    return out


def _equal_strings(right: np.ndarray, left_rows: np.ndarray, left: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether the string that starts d bytes before each anchor is found twice, as a table (suffix, d).

    Suffixes are in merged order; ``shared`` are their common prefixes.
    """
    n, most = len(right), LENGTH - GRAM
    group = np.cumsum(shared < GRAM)
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), left_rows, left[:, None].astype(np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    apart = np.zeros(n, bool)
    apart[1:] = group[order][1:] != group[order][:-1]
    left_shared = np.where(apart, -1, _common(left_rows[order], left[order]))
    nearest = LENGTH - right
    out = np.zeros((n, most + 1), bool)
    for d in range(most + 1):
        own = np.flatnonzero((nearest <= d) & (d <= left))
        if len(own) < 2:
            continue
        back = np.empty(n, np.int64)
        back[order] = np.cumsum(left_shared < d)
        both = np.cumsum(shared < LENGTH - d)[own] * np.int64(n + 1) + back[own]
        o = np.argsort(both, kind="stable")
        equal = both[o][1:] == both[o][:-1]
        out[own[o[1:][equal]], d] = True
        out[own[o[:-1][equal]], d] = True
    return out


_FOUND = "part int, refs array<long>, starts array<long>, ends array<long>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reducer: merge a bucket's runs; starts and ends of repeated bytes for each part."""
    runs, about, lefts = [], [], []
    names = ["part", "refs", "starts", "ends"]
    for batch in batches:
        for row in batch.to_pylist():
            if row["ends"] is not None:
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "refs": row["refs"], "starts": row["places"], "ends": row["ends"]}], pa.schema([("part", pa.int32()), *[(c, pa.list_(pa.int64())) for c in names[1:]]]))
                continue
            runs.append((_decoded(row["shared"], row["sizes"], row["tails"]), list(row["shared"])))
            size, left = (np.frombuffer(row[c], np.uint8).astype(np.int64) for c in ("sizes", "left_sizes"))
            flat = np.zeros((len(size), LENGTH - GRAM), np.uint8)
            flat[np.arange(LENGTH - GRAM) < left[:, None]] = np.frombuffer(row["lefts"], np.uint8)
            lefts.append(flat)
            about.append(np.stack([np.full(len(size), row["part"]), np.array(row["refs"], np.int64), np.array(row["places"], np.int64), size, left, np.frombuffer(row["known"], np.uint8)]))
    if not runs:
        return
    begin = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
    run, place, shared = (np.array(x, np.int64) for x in merge_runs(runs))
    runs.clear()
    order = begin[run] + place
    near = shared >= GRAM
    member = near.copy()
    member[:-1] |= near[1:]
    order, shared = order[member], shared[member]
    if not len(order):
        return
    part, refs, places, right, left, known = np.concatenate(about, axis=1)[:, order]
    found = _equal_strings(right, np.concatenate(lefts)[order], left, shared)
    found[known == 1] = False
    edge = np.zeros((len(found), found.shape[1] + 1), np.int8)
    edge[:, :-1] += found
    edge[:, 1:] -= found
    who, d = np.nonzero(edge == 1)
    _, beyond = np.nonzero(edge == -1)
    starts, ends = places[who] - beyond + 1, places[who] - d + LENGTH
    o = np.argsort(part[who], kind="stable")
    part, refs, starts, ends = part[who][o], refs[who][o], starts[o], ends[o]
    row_at = starts_of(part)
    if len(row_at):
        cuts = np.append(row_at, len(part))
        yield pa.RecordBatch.from_arrays([pa.array(part[row_at].astype(np.int32)), *[lists(x, cuts, pa.int64()) for x in (refs, starts, ends)]], names)


def _removed(with_bytes: bool):
    """Drop the repeated bytes of one part's documents."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        refs, starts, ends = (column_of(found, c).flatten().to_numpy() if found.num_rows else np.empty(0, np.int64) for c in ("refs", "starts", "ends"))
        order = np.argsort(refs, kind="stable")
        refs, starts, ends = refs[order], starts[order], ends[order]
        n, removed, spans, digests, kept = [], [], [], [], []
        for block in text_blocks(column_of(docs, "__text")):
            own = _text_hashes(block)
            low, high = np.searchsorted(refs, own), np.searchsorted(refs, own, "right")
            for i in range(len(own)):
                data = block.data[block.offsets[i] : block.offsets[i + 1]]
                n.append(len(data))
                gone, count = 0, 0
                if high[i] > low[i]:
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, starts[low[i] : high[i]], 1)
                    np.subtract.at(edge, ends[low[i] : high[i]], 1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(data) - int(stay.sum())
                    count = int((~stay[1:] & stay[:-1]).sum() + (not stay[0]))
                    data = data[stay]
                left = data.tobytes()
                removed.append(gone)
                spans.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                if with_bytes:
                    kept.append(left)
        columns = {"__id": column_of(docs, "__id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_bytes else {}))

    return run


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Remove each byte that a string of ``LENGTH`` bytes covers which also starts anywhere else, in this document or another.

    Texts are taken as UTF-8 and judged on the input; overlapping repeats
    count.  Returns one row for each input row: the id, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and, if
    asked, ``kept``, the remaining bytes.

    Null, empty and short texts lose nothing.  Repeated rows, with the same id
    or not, are documents of their own and repeat each other; so are rows without
    an id.  Texts of any length are looked at in pieces.  Other columns are ignored, whatever their names.
    """
    own = plain_texts(docs, id_col, text_col)
    buckets, parts = deal_of(own)
    texts = dealt_texts(own, parts)
    grams = own.mapInArrow(_deal(buckets, parts), "bucket int, parts array<int>, grams array<int>").repartitionById(buckets, F.col("bucket"))
    repeated = grams.mapInArrow(_repeated, "part int, keys array<long>")
    runs = texts.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_sorted_runs(buckets), _RUN).repartitionById(buckets, F.col("bucket"))
    found = runs.mapInArrow(_merged, _FOUND)
    out = "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_removed(with_bytes), out).withColumnRenamed("__id", id_col)
