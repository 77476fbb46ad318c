"""Operator 12: for each item the documents that rank highest by its words.

Terms are maximal runs of ASCII letters and digits and of all characters beyond
ASCII; A-Z count as a-z.  A term's weight falls with the number of documents
that hold it, its impact in a document rises with its occurrences and falls with
the document's length; all in whole numbers, so that every order of summing
gives the same score.

Sort-based accumulation.  A document is reduced to those of its terms that items
ask for.  For a chunk of documents, the items of each such term are laid end to
end as arrays of item, document and impact; item and document are packed into
one key, keys are radix-sorted by 16 bits at a time, and ``reduceat`` sums the
impacts of equal keys.  A heap for each item keeps the best documents of a task.
What tasks keep is range-partitioned by item, score and id, so that an item with
very many candidates spans several tasks, and selected by heaps once more.

Scale.  Texts are read once for each load of items (about ``LOAD_PAIRS`` pairs
of item and term, which bounds what is collected, broadcast and held) and not
exchanged.  The terms asked for are written, so that counts of documents come
from Spark and scoring reads no text.  A chunk has about ``CHUNK`` triples,
however common its terms.  What is exchanged is at most ``most`` rows for each
item and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, NO_ID, Block, column_of, ids_of, kept, lists, partitions_of, plain_texts, starts_of, text_blocks
from .decontamination import TermFinder, spread, term_hashes

#: Documents ranked for an item.
MOST = 50
#: Pairs of item and term in one load, and triples of item, document and impact in one chunk.
LOAD_PAIRS, CHUNK = 4 << 20, 1 << 20
#: Per cent of a document's relative length that count for its impacts.
LENGTH_SHARE = 50
_POSTINGS = "id long, n long, terms array<int>, times array<long>"
_FOUND = "item_id long, id long, score long"


def _terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return term_hashes(Block(block.rows, LOWER[block.data], block.offsets))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = ids_of(batch.column(0))
        for block in text_blocks(batch.column(1)):
            terms, first = _terms(block)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[block.rows], np.diff(first))), pa.array(terms.view(np.int64))], ["item_id", "term"])


@dataclass
class Asked:
    """A load's items by number, and for each term (sorted hashes) the numbers of the items that ask for it."""

    ids: np.ndarray
    terms: np.ndarray
    cuts: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, pairs: pa.Table) -> Asked:
        item, term = (column_of(pairs, c).to_numpy(zero_copy_only=False) for c in ("item_id", "term"))
        ids, number = np.unique(item, return_inverse=True)
        term = term.view(np.uint64)
        order = np.lexsort((number, term))
        head = starts_of(term[order])
        return cls(ids, term[order][head], np.append(head, len(term)), number[order].astype(np.int64))


def _matched(terms: np.ndarray):
    """Documents with a term: id, number of terms, and which of the asked terms occur how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(terms)
        for batch in batches:
            ids = ids_of(batch.column(0))
            for block in text_blocks(batch.column(1)):
                hashes, first = _terms(block)
                n = np.diff(first)
                at, number = finder(hashes)
                key, times = np.unique((np.searchsorted(first, at, "right") - 1) * len(terms) + number, return_counts=True)
                cuts = np.searchsorted(key, np.arange(len(n) + 1) * len(terms))
                rows = pa.array(n > 0)
                columns = [pa.array(ids[block.rows]), pa.array(n), lists((key % len(terms)).astype(np.int32), cuts, pa.int32()), lists(times, cuts, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.filter(rows) for c in columns], ["id", "n", "terms", "times"])

    return run


def weight(n_docs: int, df: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factors(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 for a document of mean length, less for shorter ones; in whole numbers."""
    if len(n) and LENGTH_SHARE * int(n.max()) * n_docs >= 1 << 63:
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * k * n_docs // n_terms for k in n.tolist()], np.int64)
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms


def radix_order(keys: np.ndarray, bound: int) -> np.ndarray:
    """The order of keys below ``bound``, from the lowest 16 bits up (numpy sorts such digits stably by radix)."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, max(bound - 1, 1).bit_length(), 16):
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of impacts by item and document, in their order."""
    keys = item * n_docs + doc
    order = radix_order(keys, (int(item.max()) + 1) * n_docs) if len(keys) else keys
    keys = keys[order]
    head = starts_of(keys)
    scores = np.add.reduceat(impact[order], head) if len(head) else impact[:0]
    return keys[head] // n_docs, keys[head] % n_docs, scores


class Heaps:
    """The best documents of each item: higher scores first, of equal ones lower ids."""

    def __init__(self, n: int, most: int):
        self.most, self.least = most, np.ones(n, np.int64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def add(self, item: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        near = scores >= self.least[item]
        for i, d, s in zip(item[near].tolist(), ids[near].tolist(), scores[near].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.most:
                heappush(heap, (s, -d))
            else:
                heappushpop(heap, (s, -d))
            if len(heap) == self.most:
                self.least[i] = heap[0][0]

    def batch(self, item_ids: np.ndarray) -> pa.RecordBatch:
        rows = [(i, -d, s) for i, heap in zip(item_ids.tolist(), self.heaps, strict=True) for s, d in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_id", "id", "score"])


def _scored(asked: Asked, weights: np.ndarray, n_docs: int, n_terms: int, most: int):
    """The best documents of each item in a partition of postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(asked.ids), most)
        fan = np.diff(asked.cuts)
        for batch in batches:
            ids, n = ids_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = batch.column(2).offsets.to_numpy()
            terms, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            cuts = cuts - cuts[0]
            doc = np.repeat(np.arange(len(ids)), np.diff(cuts))
            factors = length_factors(n, n_docs, n_terms)
            impact = weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * factors[doc]))
            upto = np.append(0, np.cumsum(fan[terms]))[cuts]
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, "right")) - 1)
                own = slice(cuts[a], cuts[b])
                row, place = spread(terms[own], asked.cuts)
                item, near, scores = accumulated(asked.items[place], doc[own][row] - a, impact[own][row], b - a)
                heaps.add(item, ids[a:b][near], scores)
                a = b
        yield heaps.batch(asked.ids)

    return run


def _selected(most: int):
    """The best rows of each item in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Heaps] = {}
        for batch in batches:
            item, ids, scores = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i in np.unique(item).tolist():
                own = item == i
                known.setdefault(i, Heaps(1, most)).add(np.zeros(own.sum(), np.int64), ids[own], scores[own])
        for i, heap in known.items():
            yield heap.batch(np.array([i]))

    return run


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = MOST) -> DataFrame:
    """The ``most`` documents that score highest for each item: item, ``rank`` from 1, document, ``score``; none without a shared term.

    Equal scores are ordered by id, rows without an id last.  Every row of
    documents is a document, also where rows share an id.  An item has the terms
    of all rows with its id, each once; items without an id are left out.  Null
    and empty texts, and such without a term, are ranked nowhere and not
    counted.  Texts may have any length; an item with more than ``LOAD_PAIRS``
    terms is a load of its own.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = plain_texts(docs, id_col, text_col)
    queries = plain_texts(items, item_col, item_text_col).where("__id is not null")
    pairs = kept(queries.mapInArrow(_item_terms, "item_id long, term long").distinct())
    loads = -(-pairs.count() // LOAD_PAIRS)
    found = None
    for k in range(loads):
        asked = Asked.of(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(loads)) == k).toArrow())
        if not len(asked.ids):
            continue
        postings = kept(own.mapInArrow(_matched(asked.terms), _POSTINGS))
        total = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            break
        counts = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row for each term of the load
        weights = np.zeros(len(asked.terms), np.int64)
        weights[column_of(counts, "term").to_numpy()] = [weight(total["docs"], df) for df in column_of(counts, "df").to_pylist()]
        best = kept(postings.mapInArrow(_scored(asked, weights, total["docs"], total["terms"], most), _FOUND))
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    ranged = found.repartitionByRange(partitions_of(spark), "item_id", F.desc("score"), "id").mapInArrow(_selected(most), _FOUND)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "id"))
    ranked = ranged.withColumn("rank", place).where(F.col("rank") <= most)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.nullif("id", F.lit(NO_ID)).alias(id_col), "score")
