"""Operator 10: removal of word windows that already occur in an earlier document.

Every window of ``width`` consecutive words gets a 64-bit Rabin-Karp hash.  The
hashes are dealt out by a second, independent hash; where they meet they are
counted and the smallest document of each is found.  The windows that also
start in a document with a smaller id are merged into maximal intervals of
words, which are removed.

Scale.  All windows are shuffled once, as packed arrays of eight bytes a window
(a row of its own would take three times that).  A hot window is combined
before the shuffle: of the documents in a block that share it only the one with
the smallest id is sent, the others are already known to repeat it.  Findings are packed by part of the documents
and meet the texts in a cogroup.  A bucket
holds about 1/partitions of the windows; the bucket number, of a hash of its
own, adds its bits to the 64.  With a bucket for each 128 MB of text no false
partner is expected below some 10^12 windows, and a few tens of them at 10^13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, column_of, deal_of, dealt_texts, hashes_of, ids_of, lists, part_of, pieces, plain_texts, starts_of, text_blocks, word_windows, words_of

WIDTH = 13
_PACKED = "bucket int, ids array<long>, counts array<int>, hashes array<long>, hit boolean"


def _block_windows(block: Block, width: int, both: bool = False) -> tuple[np.ndarray, ...]:
    """Hash, document and first word (counted from the document's first) of each window; the second hash if asked."""
    words = words_of(block)
    hashes = hashes_of(block.data, words.starts, words.ends)
    found, at = word_windows(hashes, words.first, width)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[at]
    return (found, doc, at - words.first[doc]) + ((word_windows(hashes, words.first, width, 1)[0],) if both else ())


def _first_equal(values: np.ndarray, wanted: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """In each run that begins at ``starts``, the first place where the two columns agree."""
    at = np.flatnonzero(values == wanted)
    return at[np.searchsorted(at, starts)]


def _hits(bucket: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Rows of (bucket, ids, counts, hashes), one for each bucket, from flat columns sorted by bucket and id."""
    run_at, row_at = starts_of(bucket, ids), starts_of(bucket)
    cuts = np.append(np.searchsorted(run_at, row_at), len(run_at))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[row_at].astype(np.int32), pa.int32()),
            lists(ids[run_at], cuts, pa.int64()),
            lists(np.diff(np.append(run_at, len(ids))), cuts, pa.int32()),
            lists(hashes.view(np.int64), np.append(row_at, len(ids)), pa.int64()),
            pa.array(np.ones(len(row_at), bool)),
        ],
        ["bucket", "ids", "counts", "hashes", "hit"],
    )


def _deal(width: int, buckets: int):
    """Mapper: the windows of each block by bucket; hits that the block itself shows are marked as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch.column(0))
            for block in text_blocks(batch.column(1), 4 << 20):
                hashes, doc, _, other = _block_windows(block, width, True)
                if not len(hashes):
                    continue
                own = ids[block.rows]
                order = np.argsort(hashes)
                hashes, doc, bucket = hashes[order], doc[order], (other[order] % np.uint64(buckets)).astype(np.int64)
                head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                if len(head) < len(hashes):
                    times = np.diff(np.append(head, len(hashes)))
                    many = np.repeat(times > 1, times)
                    some = own[doc[many]]
                    starts = np.concatenate([[0], np.cumsum(times[times > 1])[:-1]])
                    smallest = np.minimum.reduceat(some, starts)
                    known = some > np.repeat(smallest, times[times > 1])
                    a, h = some[known], hashes[many][known]
                    to = part_of(a, buckets)
                    o = np.lexsort((h, a, to))
                    a, h, to = a[o], h[o], to[o]
                    fresh = starts_of(a, h)
                    if len(fresh):
                        yield _hits(to[fresh], a[fresh], h[fresh])
                    first_of = doc[head]
                    first_of[times > 1] = doc[many][_first_equal(some, np.repeat(smallest, times[times > 1]), starts)]
                    hashes, doc, bucket = hashes[head], first_of, bucket[head]
                order = np.argsort(bucket * len(own) + doc)
                bucket, own, hashes = bucket[order], own[doc[order]], hashes[order]
                run_at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]))
                row_at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                cuts = np.append(np.searchsorted(run_at, row_at), len(run_at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[row_at].astype(np.int32), pa.int32()),
                        lists(own[run_at], cuts, pa.int64()),
                        lists(np.diff(np.append(run_at, len(own))), cuts, pa.int32()),
                        lists(hashes.view(np.int64), np.append(row_at, len(own)), pa.int64()),
                        pa.array(np.zeros(len(row_at), bool)),
                    ],
                    ["bucket", "ids", "counts", "hashes", "hit"],
                )

    return run


def _meet(parts: int):
    """Reducer: windows of one bucket that a smaller document has too, packed for the documents' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, found = [], [], []
        for batch in batches:
            hit = batch.column(4).to_numpy(zero_copy_only=False)
            for rows, known in ((batch.filter(pa.array(hit)), True), (batch.filter(pa.array(~hit)), False)):
                if rows.num_rows:
                    doc = np.repeat(rows.column(1).flatten().to_numpy(), rows.column(2).flatten().to_numpy())
                    h = rows.column(3).flatten().to_numpy()
                    if known:
                        found.append((doc, h))
                    else:
                        ids.append(doc)
                        hashes.append(h)
        if ids:
            doc, h = np.concatenate(ids), np.concatenate(hashes)
            ids.clear(), hashes.clear()
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            equal = h[1:] == h[:-1]
            member = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            h, doc = h[member], doc[member]
            if len(h):
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                head = starts_of(h)
                smallest = np.repeat(doc[head], np.diff(np.append(head, len(h))))
                found.append((doc[doc > smallest], h[doc > smallest]))
        if found:
            doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
            to = part_of(doc, parts)
            order = np.lexsort((doc, to))
            doc, h, to = doc[order], h[order], to[order]
            for a, b in pieces(to, 1 << 20):
                yield _hits(to[a:b], doc[a:b], h[a:b]).drop_columns(["hit"]).rename_columns(["part", "ids", "counts", "hashes"])

    return run


def repeated_windows(own: DataFrame, width: int, buckets: int, parts: int) -> DataFrame:
    """The hashes of the windows that also start in a document with a smaller id, by document.

    Takes the rows of ``plain_texts``.  A row holds findings of one ``part`` of
    the documents: ``ids``, how many hashes each has (``counts``), ``hashes``.
    """
    dealt = own.mapInArrow(_deal(width, buckets), _PACKED).repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(_meet(parts), "part int, ids array<long>, counts array<int>, hashes array<long>")


def _cut(width: int, with_text: bool):
    """Drop the covered words of one part's documents; the rest is joined by single spaces."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        keys = np.repeat(column_of(found, "ids").flatten().to_numpy(), column_of(found, "counts").flatten().to_numpy()) if found.num_rows else np.empty(0, np.int64)
        values = column_of(found, "hashes").flatten().to_numpy() if found.num_rows else keys
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        ids, texts = column_of(docs, "__id"), column_of(docs, "__text")
        own_ids = ids_of(ids)
        low, high = np.searchsorted(keys, own_ids), np.searchsorted(keys, own_ids, "right")
        n, removed, spans, digests, kept_texts = [], [], [], [], []
        for block in text_blocks(texts):
            lo, hi = low[block.rows], high[block.rows]
            if (hi > lo).any():
                hashes, doc, at = _block_windows(block, width)
                begin = np.searchsorted(doc, np.arange(len(lo) + 1))
            for i in range(len(lo)):
                words = block.doc_bytes(i).split()
                n.append(len(words))
                gone, count = 0, 0
                if hi[i] > lo[i]:
                    w = slice(begin[i], begin[i + 1])
                    start = at[w][np.isin(hashes[w].view(np.int64), values[lo[i] : hi[i]])]
                    edge = np.zeros(len(words) + 1, np.int32)
                    edge[start] += 1
                    np.subtract.at(edge, start + width, 1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    count = int((~stay[1:] & stay[:-1]).sum() + (not stay[0]))
                    words = compress(words, stay.tolist())
                left = b" ".join(words)
                removed.append(gone)
                spans.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept_texts.append(left.decode("utf-8", "replace"))
        columns = {"__id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "n_spans": pa.array(spans, pa.int64())}
        return pa.table(columns | ({"kept_text": pa.array(kept_texts, pa.string())} if with_text else {}))

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Remove each word that a repeated window covers.

    A window is ``width`` consecutive words (runs of characters other than
    space and U+0009-U+000D, taken as they are) of one document; it is repeated
    if the same words also start in a document with a smaller id.  Windows are
    judged on the input.  Returns one row for each input row: the id,
    ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one
    space, in UTF-8), ``n_spans`` (maximal removed intervals) and, if asked,
    ``kept_text``.

    Null or empty texts and texts of fewer words than ``width`` lose nothing.
    Rows with the same id are one document for the comparison and never remove
    each other's words; each is returned.  So are rows without an id, which
    come after all others.  A text of any length is one document.
    Other columns are ignored, whatever their names.
    """
    own = plain_texts(docs, id_col, text_col)
    out = "__id long, n_words long, n_removed long, kept_sha256 string, n_spans long" + ", kept_text string" * with_text
    buckets, parts = deal_of(own)
    found = repeated_windows(own, width, buckets, parts)
    return dealt_texts(own, parts).groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_cut(width, with_text), out).withColumnRenamed("__id", id_col)
