"""Operator 3: passages of documents that hold benchmark items.

Items are scored by BM25, each item's impacts being divided by what the item
would score against itself, so that one threshold serves all.  The inverted
index has items in blocks of ``BLOCK`` with each term's largest impact in a
block and in all.  Every window of every text is a query, its width that of the
items' class of length.  An item's frequent terms, as long as they sum up to
less than ``TAIL``, have no posting in the lists that drive the search, since
without others they reach no threshold.

Block-max WAND.  A window goes on only if the largest impacts of all its lists
can reach the threshold.  Its lists are then walked in order of their current
block: the pivot is the first block at which the largest impacts of the lists so
far can reach it, lists before it skip to it, and if the maxima in that very
block can reach it too, the block is opened.  Items of opened blocks are scored
in full, all that reach the threshold are retrieved, and the shares of word
trigrams of question and answer that the passage holds decide.

Scale.  Texts are not exchanged.  The index is built by Spark, in slices of at
most about ``SLICE_ITEMS`` items and ``SLICE_TERMS`` terms of one class, each by
one task, and written.  Tasks get about ``LOAD_BYTES`` of slices at a time and
read all texts with them; that bounds what is broadcast and held, and the texts
are read once for each such load (one for any usual set of benchmarks).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, NO_LETTER, Block, hashes_of, ids_of, kept, mix, plain_texts, starts_of, text_blocks, words_of

#: Share of its score against itself that an item needs, and shares of question and answer trigrams.
THRESHOLD, OVERLAP = 0.5, 0.5
#: Impact of frequent terms that don't drive the search, and items in a block of the index.
TAIL, BLOCK = 0.25, 16
#: Bounds of a slice of the index, and of the slices that tasks hold at once; least width of a window's step.
SLICE_ITEMS, SLICE_TERMS, LOAD_BYTES, LEAST_WIDTH = 20_000, 2 << 20, 64 << 20, 16
_K1, _B = 1.2, 0.75
#: What sums of the same numbers in another order may differ by.
_SLACK = 1e-9


def plain_words(text):
    """A text in lower case with a space for every sign beyond ASCII that is no letter, mark or digit (quotes, dashes, wide spaces)."""
    return F.regexp_replace(F.lower(text), r"[^\x00-\x7F\p{L}\p{M}\p{N}]+", " ")


def term_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, and where each document's begin (with the end)."""
    words = words_of(block, NO_LETTER)
    return hashes_of(block.data, words.starts, words.ends), words.first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each item in order, the answer's after the question's."""
    for batch in batches:
        parts = []
        for k in (1, 2):
            lists = []
            for block in text_blocks(batch.column(k)):
                terms, first = term_hashes(block)
                lists += [terms[first[i] : first[i + 1]].view(np.int64) for i in range(len(first) - 1)]
            parts.append(lists)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.int64())) for x in parts]], ["item", "question", "answer"])


def question_and_answer(text):
    """A text as question and answer: its last sentence, or if it has only one the last third of its words, is the answer."""
    whole = F.trim(text)
    cut = F.regexp_extract(whole, r"(?s)^(.*[.!?])\s+(\S.*)$", 1)
    words = F.filter(F.split(whole, r"\s+"), lambda w: w != "")
    head = F.ceil(F.size(words) * 2 / 3).cast("int")
    by_words = [F.array_join(F.slice(words, F.lit(1), head), " "), F.array_join(F.slice(words, head + 1, F.size(words)), " ")]
    return F.when(cut != "", cut).otherwise(by_words[0]), F.when(cut != "", F.regexp_extract(whole, r"(?s)^(.*[.!?])\s+(\S.*)$", 2)).otherwise(by_words[1])


@dataclass
class Index:
    """One slice of items: terms (sorted hashes) with postings (item number, impact), the driving postings by block, and each driving list's largest impact."""

    ids: np.ndarray
    terms: np.ndarray
    cuts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_cuts: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    most: np.ndarray
    tails: np.ndarray
    width: int
    grams: list[tuple[tuple[int, np.ndarray], ...]]


def _runs(terms: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the different runs of n terms."""
    if not 0 < n <= len(terms):
        return np.empty(0, np.uint64)
    total = terms[: len(terms) - n + 1].copy()
    for k in range(1, n):
        total = mix(total, 41) + terms[k : len(terms) - n + 1 + k]
    return np.unique(total)


def _side(terms: list[int]) -> tuple[int, np.ndarray]:
    """The length of the runs of a question or an answer (three, or all of fewer terms) and their hashes."""
    n = min(3, len(terms))
    return n, _runs(np.array(terms, np.int64).view(np.uint64), n)


def build_index(rows: list, n_items: int, mean: float, width: int, tail: float) -> Index:
    """``rows``: item id, question terms, answer terms, and for each different term of the item how many items have it."""
    ids = np.array([r["item"] for r in rows], np.int64)
    item, term, impact = [], [], []
    tails = np.zeros(len(rows))
    driving = []
    for i, r in enumerate(rows):
        whole = np.array([*r["question"], *r["answer"]], np.int64).view(np.uint64)
        own, times = np.unique(whole, return_counts=True)
        known = dict(zip(np.array(r["terms"], np.int64).view(np.uint64).tolist(), r["counts"], strict=True))
        df = np.array([known[t] for t in own.tolist()], float)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        x = idf * times * (_K1 + 1) / (times + _K1 * (1 - _B + _B * len(whole) / max(mean, 1)))
        x = x / x.sum()
        order = np.argsort(x, kind="stable")
        light = np.cumsum(x[order]) < tail
        tails[i] = x[order][light].sum()
        drives = np.ones(len(own), bool)
        drives[order[light]] = False
        item.append(np.full(len(own), i))
        term.append(own)
        impact.append(x)
        driving.append(drives)
    item, term, impact, driving = (np.concatenate(x) for x in (item, term, impact, driving))
    order = np.lexsort((item, term))
    item, term, impact, driving = item[order], term[order], impact[order], driving[order]
    head = starts_of(term)
    n = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(term))))
    block = item // BLOCK
    d = np.flatnonzero(driving)
    at = d[starts_of(n[d], block[d])]
    most = np.maximum.reduceat(impact[d], np.searchsorted(d, at)) if len(d) else np.empty(0)
    block_tails = np.maximum.reduceat(tails, np.arange(0, len(tails), BLOCK))
    grams = [(_side(r["question"]), _side(r["answer"])) for r in rows]
    block_cuts = np.searchsorted(n[at], np.arange(len(head) + 1))
    list_most = np.zeros(len(head))
    np.maximum.at(list_most, n[at], most)
    return Index(ids, term[head], np.append(head, len(term)), item, impact, block_cuts, block[at], most, list_most, block_tails, width, grams)


def wand(index: Index, query: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries and the blocks that they open, from pairs of a query and a driving term; all queries move at once.

    In each round a query's lists stand in order of their current block.  Its
    pivot is the first block up to which the lists' largest impacts can reach
    the threshold; a query without one is done.  Lists before the pivot skip to
    it; where none is before, the block's own maxima decide whether it is
    opened, and its lists go on by one.
    """
    least, n_blocks = threshold - _SLACK - float(index.tails.max()), len(index.tails)
    places = np.repeat(np.arange(len(index.terms)), np.diff(index.block_cuts)) * n_blocks + index.blocks  # sorted
    at, end = index.block_cuts[terms], index.block_cuts[terms + 1]
    opened = [(query[:0], index.blocks[:0])]
    while len(query):
        own = at < end
        query, terms, at, end = query[own], terms[own], at[own], end[own]
        if not len(query):
            break
        order = np.lexsort((index.blocks[at], query))
        query, terms, at, end = query[order], terms[order], at[order], end[order]
        head = starts_of(query)
        size = np.diff(np.append(head, len(query)))
        row = np.repeat(np.arange(len(head)), size)
        total = np.cumsum(index.most[terms])
        total -= np.repeat(total[head] - index.most[terms[head]], size)
        reached = np.flatnonzero(total >= least)
        first = reached[starts_of(row[reached])] if len(reached) else reached
        pivot = np.full(len(head), -1)
        pivot[row[first]] = index.blocks[at[first]]
        own = pivot[row] >= 0
        if not own.all():
            query, terms, at, end, row = query[own], terms[own], at[own], end[own], row[own]
            if not len(query):
                break
            row = np.cumsum(np.append(False, query[1:] != query[:-1]))
            pivot, head = pivot[pivot >= 0], starts_of(query)
        there = index.blocks[at] == pivot[row]
        ready = index.blocks[at[head]] == pivot
        bound = np.add.reduceat(np.where(there, index.block_most[at], 0.0), head) + index.tails[pivot]
        yes = ready & (bound >= threshold - _SLACK)
        opened.append((query[head[yes]], pivot[yes]))
        skips = index.blocks[at] < pivot[row]
        at[skips] = np.searchsorted(places, terms[skips] * n_blocks + pivot[row[skips]])
        at[there & ready[row]] += 1
    return tuple(np.concatenate(x) for x in zip(*opened, strict=True))


class TermFinder:
    """Terms of the index by hash, by a table of the hashes' low bits that is right at once for most."""

    def __init__(self, terms: np.ndarray):
        self.bits = max(12, int(len(terms)).bit_length() + 3)
        self.terms, self.mask = terms, np.uint64((1 << self.bits) - 1)
        self.some = np.zeros(1 << self.bits, bool)
        self.some[(terms & self.mask).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` of the terms of the index, and their numbers."""
        at = np.flatnonzero(self.some[(hashes & self.mask).astype(np.int64)])
        n = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        own = self.terms[n] == hashes[at]
        return at[own], n[own]


def spread(n: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that each stand for a slice of another table: the row and the place of each element of the slices."""
    size = cuts[n + 1] - cuts[n]
    row = np.repeat(np.arange(len(n)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + cuts[n][row]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    head = starts_of(keys[order])
    return keys[order][head], np.add.reduceat(values[order], head) if len(head) else values[:0]


def search_block(terms: np.ndarray, first: np.ndarray, index: Index, finder: TermFinder, threshold: float) -> Iterator[tuple[int, int, float, float, float]]:
    """Document in the block, item number, best score and best overlaps of each pair that some window retrieves.

    Windows are twice as wide as the items' class and begin at each multiple of
    its width, so that any stretch of that length lies within one of them.
    """
    at, n = finder(terms)
    doc = np.searchsorted(first, at, "right") - 1
    place = (at - first[doc]) // index.width
    stride = int(place.max()) + 2 if len(place) else 1
    # A word is in the window that begins before it and, but for the first, in the one before that.
    drives = index.block_cuts[n + 1] > index.block_cuts[n]
    query, own = doc[drives] * stride + place[drives], n[drives]
    query, own = np.concatenate([query, query[place[drives] > 0] - 1]), np.concatenate([own, own[place[drives] > 0]])
    o = np.lexsort((own, query))
    o = o[starts_of(query[o], own[o])]
    query, own = query[o], own[o]
    head = starts_of(query)
    if not len(head):
        return
    reach = np.repeat(np.add.reduceat(index.most[own], head) + index.tails.max() >= threshold - _SLACK, np.diff(np.append(head, len(query))))
    n_blocks = len(index.tails)
    opened = np.sort(np.add(*(x * f for x, f in zip(wand(index, query[reach], own[reach], threshold), (n_blocks, 1), strict=True))))
    if not len(opened):
        return
    # All terms of the items in windows that open a block, each once for a window; their postings in these blocks are summed.
    asked = np.unique(opened // n_blocks)
    query, own = doc * stride + place, n
    query, own = np.concatenate([query, query[place > 0] - 1]), np.concatenate([own, own[place > 0]])
    some = asked[np.minimum(np.searchsorted(asked, query), len(asked) - 1)] == query
    query, own = query[some], own[some]
    o = np.lexsort((own, query))
    o = o[starts_of(query[o], own[o])]
    query, own = query[o], own[o]
    row, posting = spread(own, index.cuts)
    keys = query[row] * n_blocks + index.items[posting] // BLOCK
    some = opened[np.minimum(np.searchsorted(opened, keys), len(opened) - 1)] == keys
    row, posting = row[some], posting[some]
    keys, scores = _summed(query[row] * len(index.ids) + index.items[posting], index.impacts[posting])
    keys, scores = keys[scores >= threshold], scores[scores >= threshold]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for q in np.unique(keys // len(index.ids)):
        found = keys // len(index.ids) == q
        d, p = divmod(int(q), stride)
        a, b = first[d] + p * index.width, min(first[d] + (p + 2) * index.width, first[d + 1])
        near = terms[max(a - 2, first[d]) : min(b + 2, first[d + 1])]
        held = [_runs(near, k) for k in range(4)]
        for i, score in zip((keys[found] % len(index.ids)).tolist(), scores[found].tolist(), strict=True):
            shares = [float(np.isin(g, held[k]).mean()) if k else 1.0 for k, g in index.grams[i]]
            old = best.get((d, i), (0.0, 0.0, 0.0))
            best[d, i] = max(old, (score, *shares), key=lambda x: (min(x[1:]), x[0]))
    for (d, i), x in sorted(best.items()):
        yield d, i, *x


def _search(slices: list[bytes], threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [pickle.loads(x) for x in slices]
        finders = [TermFinder(x.terms) for x in indexes]
        for batch in batches:
            ids = ids_of(batch.column(0))
            for block in text_blocks(batch.column(1), 1 << 20):
                terms, first = term_hashes(block)
                rows = [(int(ids[block.rows][d]), int(index.ids[i]), s, q, a) for index, finder in zip(indexes, finders, strict=True) for d, i, s, q, a in search_block(terms, first, index, finder, threshold) if q >= overlap and a >= overlap]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], ["id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _built(n_items: int, mean: float, tail: float):
    """One slice of the index from its items."""

    def run(rows: pa.Table) -> pa.Table:
        items = sorted(rows.to_pylist(), key=lambda r: (r["item"], r["row"]))
        index = pickle.dumps(build_index(items, n_items, mean, items[0]["width"], tail), 5)
        return pa.table({"width": pa.array([items[0]["width"]], pa.int32()), "slice": pa.array([items[0]["slice"]], pa.int32()), "index": pa.array([index], pa.binary())})

    return run


def item_index(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, tail: float = TAIL) -> DataFrame | None:
    """The written index of the items, a row for each slice (``width``, ``slice``, ``index``).  BM25 counts items and lengths over all of them."""
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    question, answer = (whole, F.coalesce(F.col(answer_col).cast("string"), F.lit(""))) if answer_col else question_and_answer(whole)
    table = items.select(F.col(item_col).cast("long").alias("item"), plain_words(question).alias("question"), plain_words(answer).alias("answer")).where("item is not null")
    table = table.mapInArrow(_item_terms, "item long, question array<long>, answer array<long>").where(F.size("question") + F.size("answer") > 0)
    size = F.size("question") + F.size("answer")
    width = F.greatest(F.lit(LEAST_WIDTH), F.pow(F.lit(2), F.length(F.bin(size - 1)))).cast("int")  # the power of two from the size on
    table = kept(table.withColumns({"row": F.xxhash64("item", "question", "answer"), "width": width}))
    about = table.agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean")).first()
    if not about["n"]:
        return None
    most = F.greatest(F.ceil(F.count(F.lit(1)) / SLICE_ITEMS), F.ceil(F.sum(size) / SLICE_TERMS))
    slices = table.groupBy("width").agg(most.cast("long").alias("slices"))  # a row for each class of length
    entries = table.select("row", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"))
    counts = entries.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = entries.join(counts, "term").groupBy("row").agg(F.collect_list(F.struct("term", "n")).alias("x"))
    full = table.dropDuplicates(["row"]).join(known.select("row", F.col("x.term").alias("terms"), F.col("x.n").alias("counts")), "row")
    full = full.join(slices, "width").withColumn("slice", F.pmod(F.col("row"), F.col("slices")).cast("int")).drop("slices")
    return kept(full.groupBy("width", "slice").applyInArrow(_built(about["n"], about["mean"], tail), "width int, slice int, index binary"))


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Pairs of a document and an item that a passage of it holds: ids, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``.

    Texts are lower-cased; terms are runs of letters, marks and digits of any
    script.  An item is held if some window scores at least ``threshold`` of the
    item's score against itself and has at least ``overlap`` of the word
    trigrams of both question and answer (a side of fewer words is one run).
    Without ``answer_col`` the last sentence of an item is its answer.

    Null and empty texts hold nothing; items without a word, or an id, are held
    nowhere.  Repeated items and rows are found once for each pair of ids, and
    rows without an id as one document.  Texts and items may have any length.
    Other columns are ignored, whatever their names.
    """
    own = plain_texts(docs, id_col, text_col).withColumn("__text", plain_words(F.col("__text")))
    schema = "id long, item_id long, score double, question_overlap double, answer_overlap double"
    index = item_index(items, item_col=item_col, text_col=item_text_col, answer_col=answer_col, tail=min(TAIL, threshold / 2))
    if index is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    sizes = index.select("width", "slice", F.octet_length("index").alias("n")).orderBy("width", "slice").collect()  # a row for each 20,000 items
    loads, full = [[]], 0
    for r in sizes:
        if loads[-1] and full + r["n"] > LOAD_BYTES:
            loads.append([])
            full = 0
        loads[-1].append((r["width"], r["slice"]))
        full += r["n"]
    found = None
    for load in loads:
        asked = F.struct("width", "slice").isin([F.struct(F.lit(w), F.lit(k)) for w, k in load])
        part = own.mapInArrow(_search([bytes(r["index"]) for r in index.where(asked).collect()], threshold, overlap), schema)
        part = part if len(loads) == 1 else kept(part)
        found = part if found is None else found.union(part)
    best = found.groupBy("id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
    return best.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "item_id", "score", "question_overlap", "answer_overlap")
