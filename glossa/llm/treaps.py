"""Ranked lexical search over inverted treaps.

Every term of a shard of documents has a treap: in order it lists the documents with the
term by id, from the root down it falls by impact. A query walks the treaps of its terms at
the same time over ranges of documents. The sum of the roots' impacts bounds all scores of
a range, so a range whose bound cannot enter the top k goes; else a document splits it, and
every treap is searched for the roots of both sides. Ranges of ``LEAF`` documents are scored
posting by posting, the best bounds first.

Whole tables: the first pass cuts every text into terms and keeps the postings of terms that
some query has; document frequencies and lengths are counted over all of them; the second
pass builds treaps a shard at a time and keeps each task's best k, which then meet. Queries
go in blocks of ``BLOCK_BYTES`` of text, so what is sent to the executors is bounded at any
size; every block is run against all documents.

Heap order: impacts are rounded up to five significant bits and equal ones go by a hash, so
a treap's depth is bounded by classes times the logarithm, also where impacts rise with the
id or where all are equal. The rounded impact is the bound of a subtree.

Defined cases: null texts have no terms; empty tables and texts without terms give no rows;
terms of weight 0 add nothing; of equal scores the smaller id is better, a null id the last;
rows with equal ids are documents of their own, and every row of queries is an item of its
own; fewer than k documents above 0 are all returned.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.batches import small_batches
from glossa.llm.common import drop_frozen, freeze

#: Bytes of query texts of a block, postings of a shard, documents of a range that is not
#: split further, entries (term of a range) that are walked at once, merges of partial results.
BLOCK_BYTES, SHARD, LEAF, WIDTH, MERGES = 4 << 20, 1 << 19, 64, 1 << 19, 64
#: Fixed values of the score.
SCALE, GAIN, SLOPE, CONSTANT, SHARE = 1_000_000_000, 1000, 12, 100, 25

_KEEP = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Letters, digits and bytes of characters beyond ASCII, A-Z in lower case; all else blank.
_TABLE = bytes(ord(chr(b).lower()) if b in _KEEP and b < 0x80 else b if b in _KEEP else 0x20 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TABLE).split()


def _bytes(column: pa.Array):
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


# ---------------------------------------------------------------- index of a shard


class Treaps:
    """The treaps of all terms of a shard. term, doc and impact are parallel arrays of
    postings; doc is a document's place in the order of ids, below n_docs."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        self.key = term.astype(np.int64) * n_docs + doc
        order = np.argsort(self.key, kind="stable")
        self.key, self.doc, self.impact, self.n_docs = self.key[order], doc[order], impact[order], n_docs
        self.start = np.searchsorted(self.key, np.arange(n_terms + 1, dtype=np.int64) * n_docs)
        shift = np.maximum(np.frexp(self.impact.astype(float))[1] - 5, 0)
        self.bound = -(-self.impact >> shift) << shift
        self.left, self.right, self.root = self._heaps()

    def _heaps(self):
        """Children of every posting, roots of every term: -1 where there is none."""
        n = len(self.key)
        chance = (self.key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        first = np.zeros(n + 1, bool)
        first[self.start] = True
        left, right, root, stack = [-1] * n, [-1] * n, [], []
        for i, (b, h, new) in enumerate(zip(self.bound.tolist(), chance.tolist(), first.tolist(), strict=False)):
            if new:
                stack = []
            at, below = (b, h), -1
            while stack and stack[-1][0] < at:
                below = stack.pop()[1]
            left[i] = below
            if stack:
                right[stack[-1][1]] = i
            else:
                root.append(i)  # the last posting that emptied the stack is the root of its term
            stack.append((at, i))
        heads = np.full(len(self.start), -1, np.int64)
        term_of = np.searchsorted(self.start, np.arange(n), "right") - 1
        heads[term_of[root]] = root
        return np.array(left, np.int32), np.array(right, np.int32), heads[:-1]

    def descend(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each treap below ``node``, the root of what lies in [low, high), or -1."""
        out = node.copy()
        at = np.flatnonzero(out >= 0)
        while len(at):
            doc = self.doc[out[at]]
            before, after = doc < low[at], doc >= high[at]
            moving = before | after
            at, before = at[moving], before[moving]
            out[at] = np.where(before, self.right[out[at]], self.left[out[at]])
            at = at[out[at] >= 0]
        return out

    def scores(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, queries: Queries):
        """(range, doc, score) of all documents above 0 in ranges [low, high) of queries."""
        n = queries.size[query]
        item = np.repeat(np.arange(len(query)), n)
        place = np.repeat(queries.start[query] - np.cumsum(n) + n, n) + np.arange(len(item))
        term, times = queries.term[place].astype(np.int64), queries.times[place]
        a = np.searchsorted(self.key, term * self.n_docs + low[item])
        b = np.searchsorted(self.key, term * self.n_docs + high[item])
        wide = b - a
        posting = np.repeat(a - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))
        offset = np.cumsum(high - low) - (high - low)
        of = np.repeat(item, wide)
        total = np.bincount(offset[of] + self.doc[posting] - low[of], self.impact[posting] * np.repeat(times, wide).astype(float), minlength=int((high - low).sum()))
        some = np.flatnonzero(total > 0)
        which = np.searchsorted(offset, some, "right") - 1
        return which, some - offset[which] + low[which], total[some].astype(np.int64)


class Queries:
    """Terms and their numbers of all queries, and the best k documents of each so far."""

    def __init__(self, found: list[list[tuple[int, int]]], k: int):
        self.size = np.array([len(q) for q in found], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.term = np.array([t for q in found for t, _ in q], np.int32)
        self.times = np.array([n for q in found for _, n in q], np.int64)
        self.k = k
        self.best = (np.zeros(0, np.int64),) * 3  # query, score, id: best first within a query
        self.edge, self.edge_id = np.zeros(len(found), np.int64), np.full(len(found), _LAST)

    def open(self, query, bound, least):
        """Whether a document of at most ``bound`` and an id of ``least`` or more can enter."""
        return (bound > self.edge[query]) | ((bound == self.edge[query]) & (bound > 0) & (least < self.edge_id[query]))

    def offer(self, query, score, doc_id):
        enter = self.open(query, score, doc_id)
        if not enter.any():
            return
        q, s, i = (np.concatenate([old, new[enter]]) for old, new in zip(self.best, (query, score, doc_id), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(len(self.edge)))
        rank = np.arange(len(q)) - first[q]
        kept = rank < self.k
        self.best = q[kept], s[kept], i[kept]
        full = np.flatnonzero(rank == self.k - 1)
        self.edge[q[full]], self.edge_id[q[full]] = s[full], i[full]


def search(index: Treaps, ids: np.ndarray, queries: Queries) -> None:
    """Offer every document of the shard that can enter the best k. ids: ascending."""
    room = max(1, -(-index.n_docs // LEAF))
    group = np.cumsum(queries.size * room) // WIDTH
    for g in np.unique(group):
        _walk(index, ids, queries, np.flatnonzero((group == g) & (queries.size > 0)))


def _walk(index: Treaps, ids: np.ndarray, queries: Queries, chosen: np.ndarray) -> None:
    query, low, high = chosen, np.zeros(len(chosen), np.int64), np.full(len(chosen), index.n_docs, np.int64)
    n = queries.size[query]
    cell = np.repeat(np.arange(len(query)), n)
    place = np.repeat(queries.start[query] - np.cumsum(n) + n, n) + np.arange(len(cell))
    node, times = index.root[queries.term[place]], queries.times[place]
    leaves = []
    while True:
        here = node >= 0
        cell, node, times = cell[here], node[here], times[here]
        if not len(cell):
            break
        # The bound of every range is the sum of its roots; entries lie range by range.
        value = index.bound[node] * times
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        of, bound = cell[begin], np.add.reduceat(value, begin)
        alive = queries.open(query[of], bound, ids[low[of]])
        small = high[of] - low[of] <= LEAF
        done = of[alive & small]
        leaves.append((query[done], low[done], high[done], bound[alive & small]))
        split = alive & ~small
        entries = np.repeat(split, np.diff(np.append(begin, len(cell))))
        cell, node, times, value, of = cell[entries], node[entries], times[entries], value[entries], of[split]
        if not len(of):
            break
        # The document with the largest share of the bound splits its range, unless it stands near an end.
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        number = np.repeat(np.arange(len(of)), np.diff(np.append(begin, len(cell))))
        top = np.flatnonzero(value == np.maximum.reduceat(value, begin)[number])
        pivot = index.doc[node[top[np.unique(number[top], return_index=True)[1]]]].astype(np.int64)
        a, b = low[of], high[of]
        quarter = (b - a) // 4
        pivot = np.where((pivot < a + quarter) | (pivot >= b - quarter), (a + b) // 2, pivot)
        which, doc, score = index.scores(query[of], pivot, pivot + 1, queries)
        queries.offer(query[of][which], score, ids[doc])
        sides = [index.descend(node, x[number], y[number]) for x, y in ((a, pivot), (pivot + 1, b))]
        query, low, high = np.concatenate([query[of]] * 2), np.concatenate([a, pivot + 1]), np.concatenate([pivot, b])
        cell, node, times = np.concatenate([number, number + len(of)]), np.concatenate(sides), np.concatenate([times] * 2)
    if not leaves:
        return
    query, low, high, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
    order = np.lexsort((-bound, query))
    query, low, high, bound = query[order], low[order], high[order], bound[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    begin, step = 0, 4
    while True:
        at = np.flatnonzero((rank >= begin) & (rank < begin + step))
        if not len(at):
            return
        at = at[queries.open(query[at], bound[at], ids[low[at]])]
        for part in np.array_split(at, max(1, int(queries.size[query[at]].sum()) * LEAF // (4 * WIDTH) + 1)):
            which, doc, score = index.scores(query[part], low[part], high[part], queries)
            queries.offer(query[part][which], score, ids[doc])
        begin, step = begin + step, 2 * step


# ---------------------------------------------------------------- whole tables


def _postings(shared):
    """(doc_id, text) to (doc_id, n, terms, times) of terms that a query has."""

    def run(batches):
        known = shared.value
        for batch in batches:
            n, sizes, found, times = [], [0], [], []
            for text in _bytes(batch.column(1)):
                words = terms(text)
                n.append(len(words))
                for word, k in Counter(words).items():
                    t = known.get(word)
                    if t is not None:
                        found.append(t)
                        times.append(k)
                sizes.append(len(found))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))], ["doc_id", "n", "terms", "times"])

    return run


def _ranked(shared):
    """Postings of documents to (item, doc_id, score): the best k of this task of each item."""

    def run(batches):
        m = shared.value
        queries, held, rows = Queries(m["queries"], m["k"]), [], 0

        def flush():
            ids, n, size, term, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            base = CONSTANT - SHARE + SHARE * n * m["docs"] // m["length"]
            impact = m["weight"][term] * (SCALE * times // (GAIN * times + SLOPE * np.repeat(base, size)))
            doc, some = np.repeat(place, size), impact > 0
            if some.any():
                search(Treaps(term[some], doc[some], impact[some], len(m["weight"]), len(ids)), ids[order], queries)

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                at, lists = b.column(0), [b.column(c) for c in (2, 3)]
                ids = at.fill_null(_LAST).to_numpy(zero_copy_only=False)
                flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
                held.append((ids, b.column(1).to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64), *flat))
                rows += len(flat[0])
                if rows >= SHARD:
                    flush()
                    rows = 0
        if held:
            flush()
        q, s, i = queries.best
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(i, mask=i == _LAST), pa.array(s)], ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The result of the collected queries (item_id, text) of a block."""
    spark = docs.sparkSession
    found = [Counter(terms((r.text or "").encode())) for r in items]
    known = {t: i for i, t in enumerate(dict.fromkeys(t for c in found for t in c))}
    sent = spark.sparkContext.broadcast(known)  # at most BLOCK_BYTES of query texts
    rows = freeze(docs.mapInArrow(_postings(sent), "doc_id long, n long, terms array<int>, times array<int>"))
    total = rows.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).head()
    df = np.zeros(len(known), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # terms of the block
        df[r.t] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    model = {"queries": [[(known[t], n) for t, n in c.items()] for c in found], "k": k, "docs": total.docs, "length": total.length or 1, "weight": weight}
    shared = spark.sparkContext.broadcast(model)
    near = rows.where("size(terms) > 0").mapInArrow(_ranked(shared), "item int, doc_id long, score long")
    # Tasks' results meet in MERGES groups an item first, so no task gets those of all tasks.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "_part"], ["item"]):
        d = near.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGES))) if len(keys) > 1 else near
        near = d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("_part")
    out = freeze(near)
    drop_frozen(rows)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "_item int, item_id long")  # of one block
    return out.join(F.broadcast(names), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of every query
    (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    q = queries.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = q.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    blocks = -(-size // block_bytes)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    done = [_block(d, items, k) for b in range(blocks) if (items := q.where(number == b).collect())]
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
