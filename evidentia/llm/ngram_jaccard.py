"""Operator 1: documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

Token-group matrix.  Equal sets become one.  A first exchange of all tokens
(64-bit hashes of shingles) finds those that two different sets hold; a set
links with nothing unless such tokens make up the threshold's share of it, and
only sets that pass go on.  They are partitioned into groups of similar sets:
sorted by min-hashes over the cluster, those of frequent tokens first, each set
joins the first of a few recent leaders that it links with, several times over
with other min-hashes and, where one min-hash fills several tasks, other
company; the most central set of such a min-hash is copied to all of them.
What is linked so far are the components of that; the sets of one component and
size are a group.

The rest is exact.  Of two linked sets, the rarer tokens that precede the last
``need - 1`` of each (its prefix, in one order for all) share at least one, and
from the first that they share on, both have as many tokens left as their
overlap must hold.  The matrix holds the union of the prefixes of each group,
with the most that is left at each token.  A query is a set, a candidate a group
of another component that holds a token of its prefix with enough left.  Two
bounds follow.  What the query's prefix has in common with the group's row, and
the most that can lie beyond the prefixes, bounds the overlap with any member;
for candidates that pass, the overlap of the whole query with the union of the
whole group does.  Only groups whose bounds reach what their members need are
opened and their members compared.  Sets that are linked through others already
are not compared again, so a large group of near copies costs no square of its
size; no link between components is missed.

Scale.  No text is exchanged.  A token that many sets of a block hold is hot: it
is dealt by token and block, so that no task gets all its sets, and comes last
in the order.  Exact copies are one row after a partial aggregation.  No table
is broadcast by this code or gathered on the driver.  Sets are told apart by 64
bits and tokens of sets that are compared by 56, so that a false equality in an
overlap is expected once in some 10^11 pairs of sets of a thousand tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .blocks import LOWER, Block, column_of, deal_of, hashes_of, kept, lists, mix, part_of, plain_texts, starts_of, text_blocks, word_windows, words_of
from .components import components

WIDTH, PERCENT = 5, 80
#: How many leaders a set is compared with in each of the rounds that form groups.
LEADERS, ROUNDS = 24, 3
#: Sets with one min-hash for each copy of their hub.
_HUB_EACH = 8
#: Sets of one block with a token that is dealt by token and block, and its place in the order of tokens.
_HOT, _LAST = 32, np.uint64(63)
#: Kinds of rows: tokens with their sets, hot ones with their sets, and word that a token is hot.
_PLAIN, _SETS_OF_HOT, _IS_HOT = 0, 1, 2
_NAMES = ["bucket", "kind", "sids", "sizes", "counts", "tokens"]
_DEALT = "bucket int, kind int, sids array<long>, sizes array<int>, counts array<int>, tokens array<long>"


def need(n, percent: int):
    """The smallest overlap with which a set of n can reach the threshold."""
    return -(-percent * n // 100)


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token hashes of each document, sorted within it, and where each document's begin (with the end)."""
    low = Block(block.rows, LOWER[block.data], block.offsets)
    words = words_of(low)
    hashes = hashes_of(low.data, words.starts, words.ends)
    tokens, at = word_windows(hashes, words.first, width)
    count = np.diff(words.first)
    sizes = np.maximum(count - width + 1, 0)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for k in range(1, width):
            own = count[short] == k
            whole[own] = word_windows(hashes[(words.first[short[own]][:, None] + np.arange(k)).ravel()], np.arange(own.sum() + 1) * k, k)[0]
        tokens = np.insert(tokens, np.cumsum(sizes)[short], whole)
        sizes[short] = 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    new = np.ones(len(tokens), bool)
    for i in range(len(sizes)):
        own = tokens[begin[i] : begin[i + 1]]
        own.sort()
        np.not_equal(own[1:], own[:-1], out=new[begin[i] + 1 : begin[i + 1]]) if len(own) > 1 else None
    return tokens[new], np.concatenate([[0], np.cumsum(new)])[begin]


def _set_ids(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens, 5))])
    n = np.diff(begin)
    return np.where(n > 0, mix((sums[begin[1:]] - sums[begin[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40)), 6), np.uint64(0)).view(np.int64)


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                tokens, begin = shingle_sets(block, width)
                same = [batch.column(k).slice(block.rows.start, len(begin) - 1) for k in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(np.diff(begin), pa.int64()), pa.array(_set_ids(tokens, begin)), *same[1:]], ["id", "n", "sid", "carried"][: 2 + len(same)])

    return run


def _by_bucket(bucket: np.ndarray, kind: int, doc: np.ndarray, tokens: np.ndarray, sids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_DEALT``, one for each bucket, from tokens in order of document."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and int(bucket.max()) < 1 << 16 else bucket, kind="stable")
    bucket, doc, tokens = bucket[order], doc[order], tokens[order]
    run_at, row_at = starts_of(bucket, doc), starts_of(bucket)
    cuts = np.append(np.searchsorted(run_at, row_at), len(run_at))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[row_at].astype(np.int32), pa.int32()),
            pa.array(np.full(len(row_at), kind, np.int32)),
            lists(sids[doc[run_at]], cuts, pa.int64()),
            lists(n[doc[run_at]], cuts, pa.int32()),
            lists(np.diff(np.append(run_at, len(doc))), cuts, pa.int32()),
            lists(tokens.view(np.int64), np.append(row_at, len(doc)), pa.int64()),
        ],
        _NAMES,
    )


def _bucket_of(tokens: np.ndarray, buckets: int, salt: int = 0) -> np.ndarray:
    return (((tokens >> np.uint64(32)) + np.uint64(salt)) % np.uint64(buckets)).astype(np.int32)


def _deal(width: int, buckets: int):
    """Mapper: the tokens of the different sets of each block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(1), 4 << 20):
                tokens, begin = shingle_sets(block, width)
                sids, n = _set_ids(tokens, begin), np.diff(begin)
                first = np.zeros(len(sids), bool)
                first[np.unique(sids, return_index=True)[1]] = True
                first &= n > 0
                own = np.repeat(first, n)
                tokens, doc = tokens[own], np.repeat(np.arange(len(n)), n)[own]
                if not len(tokens):
                    continue
                ordered = np.sort(tokens)
                hot = np.unique(ordered[: len(ordered) - _HOT + 1][ordered[: len(ordered) - _HOT + 1] == ordered[_HOT - 1 :]]) if len(ordered) >= _HOT else ordered[:0]
                if len(hot):
                    own = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                    salt = int(sids[first].view(np.uint64).min() % np.uint64(1 << 31))
                    yield _by_bucket(_bucket_of(tokens[own], buckets, salt), _SETS_OF_HOT, doc[own], tokens[own], sids, n)
                    yield _by_bucket(_bucket_of(hot, buckets), _IS_HOT, np.zeros(len(hot), np.int64), hot, np.zeros(1, np.int64), np.zeros(1, np.int64))
                    tokens, doc = tokens[~own], doc[~own]
                if len(tokens):
                    yield _by_bucket(_bucket_of(tokens, buckets), _PLAIN, doc, tokens, sids, n)

    return run


def _told(keys: np.ndarray, who: np.ndarray, known: np.ndarray, size: np.ndarray, parts: int) -> pa.RecordBatch:
    """Keys of shared tokens with their sets, one row for each part."""
    part = part_of(known, parts)[who]
    order = np.lexsort((who, part))
    keys, who, part = keys[order].view(np.int64), who[order], part[order]
    run_at, row_at = starts_of(part, who), starts_of(part)
    cuts = np.append(np.searchsorted(run_at, row_at), len(run_at))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[row_at]), lists(known[who[run_at]], cuts, pa.int64()), lists(size[who[run_at]], cuts, pa.int32()), lists(np.diff(np.append(run_at, len(who))), cuts, pa.int32()), lists(keys, np.append(row_at, len(who)), pa.int64())],
        ["part", "sids", "sizes", "counts", "tokens"],
    )


def _key(grade: np.ndarray | np.uint64, tokens: np.ndarray) -> np.ndarray:
    return (grade << np.uint64(56)) | (tokens >> np.uint64(8))


def _shared(parts: int):
    """Reducer: the tokens of one bucket that two or more sets hold, packed for the sets' parts.

    A token's key has the logarithm of its number of sets in the top byte, for
    hot tokens the highest number, then its hash: keys order tokens from rare
    to frequent, alike for all sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[int, list[list[np.ndarray]]] = {k: [[], [], [], []] for k in (_PLAIN, _SETS_OF_HOT, _IS_HOT)}
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for kind in np.unique(kinds):
                for to, column in zip(columns[int(kind)], batch.filter(pa.array(kinds == kind)).columns[2:], strict=True):
                    to.append(column.flatten().to_numpy())
        hot = np.unique(np.concatenate(columns.pop(_IS_HOT)[3] or [np.empty(0, np.int64)]).view(np.uint64))
        for kind in (_SETS_OF_HOT, _PLAIN):
            if not columns[kind][0]:
                continue
            sids, sizes, counts, tokens = (np.concatenate(x) for x in columns.pop(kind))
            known, index = np.unique(sids, return_inverse=True)
            size = np.zeros(len(known), np.int32)
            size[index] = sizes
            tokens, who = tokens.view(np.uint64), np.repeat(index.astype(np.int32), counts)
            if kind == _SETS_OF_HOT:
                yield _told(_key(_LAST, tokens), who, known, size, parts)
                continue
            is_hot = np.zeros(len(tokens), bool)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
            # Half of a token's bits, with its place, sort as plain values and dismiss most tokens of one set.
            x = np.sort((tokens << np.uint64(32)) | np.arange(len(tokens), dtype=np.uint64))
            head = starts_of(x >> np.uint64(32))
            times = np.diff(np.append(head, len(x)))
            at = np.concatenate([(x[np.repeat(times > 1, times)] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.flatnonzero(is_hot)])
            at = np.unique(at) if len(hot) else at
            at = at[np.lexsort((who[at], tokens[at]))]
            at = at[starts_of(tokens[at], who[at])] if len(at) else at
            head = starts_of(tokens[at])
            times = np.diff(np.append(head, len(at)))
            grade = np.where(is_hot[at], _LAST, np.repeat(np.log2(np.maximum(times, 1)).astype(np.uint64), times))
            own = np.repeat(times > 1, times) | is_hot[at]
            if own.any():
                yield _told(_key(grade[own], tokens[at][own]), who[at][own], known, size, parts)

    return run


def _candidates(percent: int):
    """Sets of one part that hold enough shared tokens to link with any other, and their min-hashes."""

    def run(rows: pa.Table) -> pa.Table:
        sids, sizes, counts, keys = (column_of(rows, c).flatten().to_numpy() for c in ("sids", "sizes", "counts", "tokens"))
        who = np.repeat(sids, counts)
        order = np.lexsort((keys, who))
        order = order[starts_of(who[order], keys[order])]
        who, keys = who[order], keys[order]
        begin = starts_of(who)
        held = np.diff(np.append(begin, len(who)))
        known, first = np.unique(sids, return_index=True)
        n = sizes[first].astype(np.int64)
        keep = held >= need(n, percent)
        own = np.repeat(keep, held)
        keys, held = keys[own], held[keep]
        cuts = np.concatenate([[0], np.cumsum(held)])
        grades = np.add.reduceat(keys >> 56, cuts[:-1]) * 256 // n[keep] if len(keys) else np.empty(0, np.int64)
        hashes = [np.minimum.reduceat(mix(keys.view(np.uint64), 20 + k), cuts[:-1]).view(np.int64) if len(keys) else np.empty(0, np.int64) for k in range(ROUNDS)]
        return pa.table({"sid": pa.array(known[keep], pa.int64()), "n": pa.array(n[keep], pa.int64()), "keys": lists(keys, cuts, pa.int64()), "grade": pa.array(grades, pa.int64())} | {f"h{k}": pa.array(h, pa.int64()) for k, h in enumerate(hashes)})

    return run


def _led(percent: int):
    """Sets sorted by min-hash: each links with a recent leader of the same min-hash or becomes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for batch in batches:
            sids, sizes, heads = (batch.column(k).to_numpy() for k in (0, 1, 3))
            flat, cuts = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            to = np.empty(len(sids), np.int64)
            for i in range(len(sids)):
                own, n = flat[cuts[i] : cuts[i + 1]], int(sizes[i])
                if heads[i] != at:
                    at, leaders = heads[i], []
                for k, (sid, m, other) in enumerate(leaders):
                    if min(n, m) * 100 >= percent * max(n, m):
                        both = np.concatenate([own, other])
                        both.sort()
                        overlap = int((both[1:] == both[:-1]).sum())
                        if 100 * overlap >= percent * (n + m - overlap):
                            to[i] = sid
                            leaders.insert(0, leaders.pop(k))
                            break
                else:
                    leaders = [(int(sids[i]), n, own.copy()), *leaders[: LEADERS - 1]]
                    to[i] = sids[i]
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(to)], ["a", "b"])

    return run


def _with_hubs(sets: DataFrame, head: str) -> DataFrame:
    """The sets and, for a min-hash that many share, copies of its most central set, which meet the others in all tasks they are dealt to."""
    shared = sets.groupBy(head).agg(F.count(F.lit(1)).alias("times"), F.max_by("sid", F.struct("grade", "sid")).alias("sid")).where(F.col("times") > _HUB_EACH)
    hubs = sets.drop(head).join(shared, "sid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("times") / _HUB_EACH).cast("int"))))
    return sets.withColumn("copy", F.lit(0)).unionByName(hubs.select(*sets.columns, "copy"))


def _late_links(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different components so far: matrix, bound, opening.  A group is the sets of one component and size."""
    grouped = kept(sets.select("sid").join(roots.select(F.col("node").alias("sid"), F.col("root").alias("g")), "sid", "left").withColumn("g", F.coalesce("g", "sid")))
    reaches = lambda held, n, m: (F.col(held) if isinstance(held, str) else held) * (100 + percent) >= (F.col(n) + m) * percent
    least = lambda n: F.ceil(F.col(n) * percent / 100)
    placed = sets.select("sid", "n", F.size("keys").alias("held"), F.slice("keys", F.lit(1), (F.size("keys") - least("n") + 1).cast("int")).alias("prefix"))
    placed = placed.join(grouped, "sid")
    every = kept(placed.select("sid", "n", "held", "g", F.posexplode("prefix").alias("at", "key")).withColumn("left", F.col("held") - F.col("at")).drop("held", "at"))
    keys = every.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.min("n").alias("n_least")).where("low != high").select("key", "n_least")
    every = kept(every.join(keys, "key"))
    entries = every.where(reaches("left", "n", F.greatest("n_least", least("n")))).drop("n_least")
    matrix = entries.groupBy("key", "g", F.col("n").alias("ng")).agg(F.max("left").alias("lg"))
    queries = entries.select("key", F.col("sid").alias("q"), F.col("n").alias("nq"), F.col("left").alias("lq"), F.col("g").alias("gq"))
    fits = (F.col("gq") < F.col("g")) & (F.col("ng") * 100 >= F.col("nq") * percent) & (F.col("ng") * percent <= F.col("nq") * 100)
    found = kept(queries.join(matrix, "key").where(fits & reaches("lq", "nq", F.col("ng")) & reaches("lg", "nq", F.col("ng"))).select("q", "nq", "g", "ng").distinct())
    # Up to the last token of the prefix that ends first all that two sets share lies in both prefixes, and beyond it at most need - 1.
    rows = every.select("key", "g", F.col("n").alias("ng")).distinct()
    held = found.join(every.select(F.col("sid").alias("q"), "key"), "q").join(rows, ["key", "g", "ng"]).groupBy("q", "nq", "g", "ng").agg(F.count(F.lit(1)).alias("held"))
    found = kept(held.where(reaches(F.col("held") + F.greatest(least("nq"), least("ng")) - 1, "nq", F.col("ng"))).drop("held"))
    asked = found.join(sets.select(F.col("sid").alias("q"), "keys"), "q").select("q", "nq", "g", "ng", F.explode("keys").alias("key"))
    unions = sets.join(grouped, "sid").withColumnRenamed("n", "ng").join(found.select("g", "ng").distinct(), ["g", "ng"], "left_semi").select("g", "ng", F.explode("keys").alias("key")).distinct()
    bounds = asked.join(unions, ["g", "ng", "key"]).groupBy("q", "nq", "g", "ng").agg(F.count(F.lit(1)).alias("most"))
    opened = bounds.where(reaches("most", "nq", F.col("ng"))).select("q", "g", "ng")
    members = entries.select("key", "g", F.col("sid").alias("s"), F.col("n").alias("ng"), F.col("left").alias("ls"))
    close = reaches("lq", "nq", F.col("ng")) & reaches("ls", "nq", F.col("ng"))
    pairs = queries.join(opened, "q").join(members, ["key", "g", "ng"]).where(close & (F.col("q") != F.col("s"))).select("q", "s", "nq", F.col("ng").alias("ns")).distinct()
    compared = pairs.join(sets.select(F.col("sid").alias("q"), F.col("keys").alias("kq")), "q").join(sets.select(F.col("sid").alias("s"), F.col("keys").alias("ks")), "s")
    overlap = F.size(F.array_intersect("kq", "ks"))
    return compared.where(overlap * 100 >= (F.col("nq") + F.col("ns") - overlap) * percent).select(F.col("q").alias("a"), F.col("s").alias("b"))


def ngram_jaccard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, carry: str | None = None) -> DataFrame:
    """Components of documents under links of at least ``percent`` % Jaccard similarity of their shingle sets.

    A-Z are lower-cased; words are runs of characters other than space and
    U+0009-U+000D; a set holds the distinct runs of ``width`` words of the whole
    text, or the whole sequence of a shorter one.  Returns for each row its id,
    ``n_shingles`` and ``component_id``, the smallest id reachable by links; with
    ``carry`` also ``component_key``, a number of the component's own, and the
    column of that name.

    Null, empty and blank texts have an empty set and link with nothing.  Rows
    with the same id are compared like others.  Rows without an id are linked
    like others and name nothing: a component of such rows alone has no id.
    Other columns are ignored, whatever their names.
    """
    own = plain_texts(docs, id_col, text_col)
    buckets, parts = deal_of(own)
    more = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), carry) if carry else own
    sized = kept(more.mapInArrow(_sizes(width), StructType([*[StructField(c, LongType()) for c in ("id", "n", "sid")], *([StructField("carried", more.schema[2].dataType)] if carry else [])])))
    dealt = own.mapInArrow(_deal(width, buckets), _DEALT).repartitionById(buckets, F.col("bucket"))
    shared = dealt.mapInArrow(_shared(parts), _DEALT.replace("bucket int, kind", "part"))
    heads = [f"h{k}" for k in range(ROUNDS)]
    sets = kept(shared.groupBy("part").applyInArrow(_candidates(percent), "sid long, n long, keys array<long>, grade long" + "".join(f", {h} long" for h in heads)))
    rounds = []
    for k in range(ROUNDS):
        near = _with_hubs(sets, f"h{k}").repartitionByRange(buckets, f"h{k}", F.xxhash64("sid", "copy", F.lit(k))).sortWithinPartitions(f"h{k}", F.desc("grade"), "sid")
        rounds.append(kept(near.select("sid", "n", "keys", f"h{k}").mapInArrow(_led(percent), "a long, b long")))
    links = rounds[0]
    for more in rounds[1:]:
        links = links.union(more)
    roots = components(links)
    late = kept(_late_links(sets, roots, percent))
    roots = components(links.union(late)) if not late.isEmpty() else roots
    of_set = sized.where("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    of_set = of_set.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = of_set.join(of_set.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "component_id", "root")
    alone = F.when(F.col("n") == 0, F.col("id"))
    return sized.join(named, "sid", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(alone, "component_id").alias("component_id"), *([F.col("root").alias("component_key"), F.col("carried").alias(carry)] if carry else []))
