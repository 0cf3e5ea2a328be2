"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, joined by one space, and an end byte. Each byte is eight
binary decisions (which decision: the bits before it); every decision has a tree whose
nodes are the last 0 to ``DEPTH`` bytes. A node's Krichevsky-Trofimov estimate and its
children's product are mixed half and half from the leaves up, which gives each depth its
weight; the prediction of a bit mixes the estimates of all depths on its path by those
weights.

Training: tasks count the (DEPTH + 1)-grams of bytes of all training texts and Spark sums
them. Partitions that hold whole subtrees (by the last two bytes of the context) weigh
them; the two shallowest depths have at most 256 x 255 nodes and are weighed on the driver.
A gram's value is the log-probability of its last byte, the product of its eight decisions.
A node without counts has the estimate 1/2 and its subtree too, so a byte that a context
has not seen gets the mixture's own mass for it, and each context's distribution sums to 1.

Scoring: the values of the most frequent grams, at most ``COMMON_GRAMS``, and the counts of
the most frequent words, at most ``COMMON_WORDS``, are broadcast, both by levels of their
counts. All other grams of a text, seen or not, are asked for: their distinct keys meet the
counts in their subtrees' partitions, and the values are joined back to the rows. So what
passes the driver is bounded, and what is shuffled grows with the corpus.

Defined cases: a null text counts as empty and is its end alone; without training texts
every bit has probability 1/2; equal texts, repeated rows too, get equal scores; very long
texts are cut into steps, not shortened; an empty table gives an empty result; further
columns are not read, so any names may stand there.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.batches import small_batches
from glossa.llm.common import crc_of_id, freeze

DEPTH = 5
COMMON_GRAMS = 8_000_000
COMMON_WORDS = 300_000
PART_ROWS = 200_000
END = b"\n"
STEP = 1 << 19
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LN2 = math.log(2.0)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _runs(docs: list[list[bytes]]):
    """Steps of about STEP bytes: (first doc, end doc, gram keys, starts, lengths)."""
    pad, a, parts, sizes, total = END * DEPTH, 0, [], [], 0
    for k, words in enumerate(docs):
        s = b" ".join(words) + END
        parts.append(pad + s)
        sizes.append(len(s))
        total += len(s) + DEPTH
        if total >= STEP or k + 1 == len(docs):
            yield a, k + 1, _grams(np.frombuffer(b"".join(parts), np.uint8)), np.concatenate([[0], np.cumsum(np.array(sizes[:-1], np.int64) + DEPTH)]), np.array(sizes, np.int64)
            a, parts, sizes, total = k + 1, [], [], 0


def _grams(data: np.ndarray) -> np.ndarray:
    """DEPTH + 1 bytes from each place on, as one number (the last byte lowest)."""
    d = data.astype(np.uint64)
    two = d[:-1] << np.uint64(8) | d[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return four[:-2] << np.uint64(16) | two[4:]


def _count(batches):
    """Rows (word, key, n): words, and grams where word is null."""
    words: Counter = Counter()
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    ends = 0
    for batch in batches:
        docs = [_words(t) for t in batch.column(0).to_pylist()]
        for d in docs:
            words.update(d)
        ends += len(docs)
        for _, _, k, starts, lengths in _runs(docs):
            keep = np.ones(len(k), bool)
            out = ((starts + lengths)[:, None] + np.arange(DEPTH)).ravel()
            keep[out[out < len(k)]] = False
            waiting.append(np.sort(k[keep]))
        if sum(map(len, waiting)) > 4_000_000:
            keys, counts = _merge(keys, counts, waiting)
            waiting = []
        if len(words) > 1_500_000:
            yield from _word_rows(words)
            words.clear()
    keys, counts = _merge(keys, counts, waiting)
    yield from _word_rows(words)
    for a in range(0, len(keys), 100_000):
        n = len(keys[a : a + 100_000])
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array(keys[a : a + n].astype(np.int64)), pa.array(counts[a : a + n])], ["word", "key", "n"])
    if ends:  # the end's own count, under a word that no text has
        yield pa.RecordBatch.from_arrays([pa.array([" "]), pa.array([0]), pa.array([ends])], ["word", "key", "n"])


def _merge(keys, counts, waiting):
    if not waiting:
        return keys, counts
    s = np.sort(np.concatenate(waiting))
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    both, n = np.concatenate([keys, s[at]]), np.concatenate([counts, np.diff(np.append(at, len(s)))])
    u, inverse = np.unique(both, return_inverse=True)
    return u, np.bincount(inverse, n, minlength=len(u)).astype(np.int64)


def _word_rows(words: Counter):
    items = list(words.items())
    for a in range(0, len(items), 50_000):
        part = items[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array(np.zeros(len(part), np.int64)), pa.array([n for _, n in part], pa.int64())], ["word", "key", "n"])


# ---------------------------------------------------------------- weighting


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after eight steps up."""
    y, shift = np.asarray(x, float) + 8, np.zeros(np.shape(x))
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth: key (context and decision), counts, log of the mixture."""

    def __init__(self, keys, n0, n1, below=None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = log_kt(n0, n1)
        self.mixed = own if below is None else np.logaddexp(own, below) - _LN2
        self.stop = np.ones(len(keys)) if below is None else np.exp(own - self.mixed - _LN2)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    def up(self, depth: int) -> Level:
        """The level above, of contexts of ``depth`` bytes."""
        mask = np.uint64((1 << 8 * (depth + 1)) - 1)
        u, inv = np.unique(self.keys & mask, return_inverse=True)
        add = lambda v: np.bincount(inv, v, minlength=len(u))
        return Level(u, add(self.n0), add(self.n1), add(self.mixed))


def _decisions(byte: np.ndarray):
    """For each of eight bits: the decision's number (1 to 255) and the bit."""
    for i in range(8):
        yield (1 << i) | (byte >> np.uint64(8 - i)), (byte >> np.uint64(7 - i)) & np.uint64(1)


def _levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of depth 2 to DEPTH of whole subtrees."""
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    nodes, ones = zip(*((context | node, bit) for node, bit in _decisions(byte)), strict=True)
    u, inv = np.unique(np.concatenate(nodes), return_inverse=True)
    bit = np.concatenate(ones).astype(float)
    weight = np.tile(counts.astype(float), 8)
    n1 = np.bincount(inv, weight * bit, minlength=len(u))
    levels = [Level(u, np.bincount(inv, weight, minlength=len(u)) - n1, n1)]
    for depth in range(DEPTH - 1, 1, -1):
        levels.append(levels[-1].up(depth))
    return levels[::-1]


def _table(batches) -> list[np.ndarray]:
    """Keys and, per further column, its numbers."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)]
    t = pa.Table.from_batches(found)
    return [t.column(0).to_numpy().astype(np.uint64), *(t.column(k).to_numpy(zero_copy_only=False) for k in range(1, t.num_columns))]


def _shallow_part(batches):
    """Sums of depth-2 nodes for the depths above: (node of depth 1, n0, n1, mixed)."""
    keys, counts, *_ = _table(batches)
    if not len(keys):
        return
    top = _levels(keys, counts)[0]
    node, inv = np.unique(top.keys & np.uint64(0xFFFF), return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *(pa.array(np.bincount(inv, v)) for v in (top.n0, top.n1, top.mixed))], ["node", "n0", "n1", "mixed"])


class Shallow:
    """Depths 0 and 1: weights on the way down, and all byte probabilities."""

    def __init__(self, node=(), n0=(), n1=(), mixed=()):
        dense = lambda size, at, v: np.bincount(np.asarray(at, np.int64), np.asarray(v, float), minlength=size) if len(at) else np.zeros(size)
        one = Level(np.arange(65536), *(dense(65536, node, v) for v in (n0, n1, mixed)))
        own = log_kt(one.n0, one.n1)
        one.mixed = np.logaddexp(own, dense(65536, node, mixed)) - _LN2
        one.stop = np.exp(own - one.mixed - _LN2)
        up = np.arange(65536) & 255
        root = Level(np.arange(256), *(np.bincount(up, v, minlength=256) for v in (one.n0, one.n1)), np.bincount(up, one.mixed, minlength=256))
        # What has been mixed in when depth 2 is reached, and the weight that is left.
        self.gone = root.stop[up] * root.one[up] + (1 - root.stop[up]) * one.stop * one.one
        self.left = (1 - root.stop[up]) * (1 - one.stop)


def gram_values(keys: np.ndarray, levels: list[Level], gone: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context: the mixture over
    all depths; below a node without counts all estimates are 1/2."""
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    out = np.zeros(len(keys))
    for node, bit in _decisions(byte):
        whole = context | node
        low = (whole & np.uint64(0xFFFF)).astype(np.int64)
        one, rest = gone[low], left[low]
        for depth, level in enumerate(levels, 2):
            k = whole & np.uint64((1 << 8 * (depth + 1)) - 1)
            at = np.minimum(np.searchsorted(level.keys, k), len(level.keys) - 1)
            seen = level.keys[at] == k
            stop = np.where(seen, level.stop[at], 1.0)
            one = one + rest * stop * np.where(seen, level.one[at], 0.5)
            rest = rest * (1 - stop)
        one = one + rest * 0.5
        out += np.log10(np.where(bit.astype(bool), one, 1 - one))
    return out


def _value_part(shallow):
    """Rows (key, n, ask) of whole subtrees to (key, value) of the distinct keys asked for."""

    def run(batches):
        keys, counts, ask = _table(batches)
        asked = np.unique(keys[ask])
        if not len(asked):
            return
        s, some = shallow.value, counts > 0
        values = gram_values(asked, _levels(keys[some], counts[some]) if some.any() else [], s["gone"], s["left"])
        yield from pa.table({"key": pa.array(asked.astype(np.int64)), "value": pa.array(values)}).to_batches(max_chunksize=100_000)

    return run


# ---------------------------------------------------------------- lookup


class Lookup:
    """Open addressing: code to value, NaN where there is none."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(8, (2 * len(codes)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, _EMPTY), np.full(1 << self.bits, np.nan, np.float32)
        at, h = np.arange(len(codes)), self._hash(codes)
        while len(at):
            free = self.keys[h] == _EMPTY
            self.keys[h[free]] = codes[at[free]]
            mine = self.keys[h] == codes[at]
            self.values[h[mine]] = values[at[mine]]
            at, h = at[~mine], (h[~mine] + 1) & ((1 << self.bits) - 1)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes ^ codes >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        h = self._hash(codes)
        found = self.keys[h]
        out = self.values[h]
        odd = np.flatnonzero(found != codes)
        out[odd] = np.nan
        odd = odd[found[odd] != _EMPTY]
        while len(odd):
            h_ = h[odd] = (h[odd] + 1) & ((1 << self.bits) - 1)
            found = self.keys[h_]
            hit = found == codes[odd]
            out[odd[hit]] = self.values[h_[hit]]
            odd = odd[~hit & (found != _EMPTY)]
        return out


# ---------------------------------------------------------------- the operator


def train(texts: DataFrame) -> dict:
    """A model over all rows of ``texts`` (text): counted words and grams, and small parts."""
    spark = texts.sparkSession
    small_batches(spark)
    counted = texts.mapInArrow(_count, "word string, key long, n long")
    counted = freeze(counted.groupBy("word", "key").agg(F.sum("n").alias("n")))
    vocabulary = counted.where("word is not null").select("word", F.col("n").alias("c"))
    grams = counted.where("word is null").select("key", "n")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    model = {"vocabulary": vocabulary, "total": total, "distinct": distinct, "grams": grams, "parts": max(1, -(-grams.count() // PART_ROWS))}
    sums = by_subtree(model, grams).mapInArrow(_shallow_part, "node long, n0 double, n1 double, mixed double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "mixed")])
    rows = sums.orderBy("node").collect()  # at most 256 x 255 rows
    shallow = Shallow(*(np.array([r[i] for r in rows]) for i in range(4))) if rows else Shallow()
    return model | {"shallow": vars(shallow)}


def by_subtree(model: dict, rows: DataFrame) -> DataFrame:
    return rows.repartition(model["parts"], F.expr("(key div 256) % 65536"))


def values(model: dict, asked: DataFrame) -> DataFrame:
    """(key, value) of the distinct keys of ``asked`` (key), in training texts or not."""
    rows = model["grams"].select("key", "n", F.lit(False).alias("ask")).union(asked.select("key", F.lit(0).cast("long"), F.lit(True)))
    return by_subtree(model, rows).mapInArrow(_value_part(asked.sparkSession.sparkContext.broadcast(model["shallow"])), "key long, value double")


def _most(rows: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the largest counts, whole quarter powers of two, at most ``limit``."""
    level, lowest, held = F.floor(F.log2(count) * 4).cast("int"), None, 0
    for r in rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("level")).collect():  # at most 4 x 64 rows
        held += r["rows"]
        if held > limit:
            break
        lowest = r["level"]
    return rows.where(level >= lowest if lowest is not None else F.lit(False))


def score(docs: DataFrame, model: dict, common_grams: int = COMMON_GRAMS, common: int = COMMON_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of
    every row of ``docs``; the code length per byte is of the text as it is modelled."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    total, distinct = model["total"], model["distinct"]
    below = total + 0.1 * (distinct + 1)
    top = _most(model["vocabulary"], "c", common).toArrow()  # at most `common` rows
    logs = np.log10((top.column("c").to_numpy() + 0.1) / below)
    words = dict(zip(top.column("word").cast(pa.binary()).to_pylist(), logs.tolist(), strict=True))
    t = values(model, _most(model["grams"], "n", common_grams)).toArrow()  # at most `common_grams` rows
    grams = spark.sparkContext.broadcast({"codes": t.column("key").to_numpy(), "values": t.column("value").to_numpy().astype(np.float32)})
    del t
    small = spark.sparkContext.broadcast(words)
    ends = model["vocabulary"].where(F.col("word") == " ").agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0]
    end = math.log10((ends + 0.1) / below)
    names = ["doc_id", "n_tokens", "known", "base", "score", "n_bytes", "rare", "rare_n", "asked", "asked_n"]

    def run(batches):
        v = grams.value
        if "look" not in v:  # built once in a worker
            v["look"] = Lookup(v.pop("codes").astype(np.uint64), v.pop("values"))
        get, look = small.value.get, v["look"]
        for b in batches:
            texts = [_words(t) for t in b.column(1).to_pylist()]
            mark, sizes = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            asked: list = [[]] * b.num_rows
            asked_n: list = [[]] * b.num_rows
            for i, j, keys, starts, lengths in _runs(texts):
                got = look(keys).astype(float)
                at = np.flatnonzero(np.isnan(got))
                got[at] = 0.0
                mark[i:j], sizes[i:j] = _sums(got, starts, lengths), lengths
                of = np.searchsorted(starts, at, "right") - 1
                inside = at - starts[of] < lengths[of]
                pairs = np.stack([of[inside].astype(np.uint64), keys[at[inside]]], axis=1)
                if not len(pairs):
                    continue
                pairs, n = np.unique(pairs, axis=0, return_counts=True)
                cuts = np.append(np.flatnonzero(np.diff(pairs[:, 0], prepend=np.uint64(1 << 63))), len(pairs))
                for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    row = i + int(pairs[a, 0])
                    asked[row], asked_n[row] = pairs[a:z, 1].astype(np.int64).tolist(), n[a:z].tolist()
            size, known, base, rare, rare_n = [], [], [], [], []
            for t in texts:
                got = list(map(get, t))
                other = Counter([w for w, v in zip(t, got, strict=True) if v is None]) if None in got else {}
                hits = [v for v in got if v is not None] if other else got
                size.append(len(t) + 1)
                known.append(len(hits) + (ends > 0))
                base.append(math.fsum(hits) + end)
                rare.append(list(other))
                rare_n.append(list(other.values()))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(mark), pa.array(sizes), pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(rare_n, longs), pa.array(asked, longs), pa.array(asked_n, longs)], names)

    small_batches(spark)
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, base double, score double, n_bytes long, rare array<string>, rare_n array<long>, asked array<long>, asked_n array<long>")
    scored = freeze(scored.withColumn("_row", F.monotonically_increasing_id()))
    each = lambda key, n: scored.select("_row", F.explode(F.arrays_zip(F.col(key).alias("k"), F.col(n).alias("m"))).alias("r")).select("_row", "r.k", "r.m")
    rare = each("rare", "rare_n").withColumnRenamed("k", "word")
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(model["vocabulary"], "word", "left").groupBy("_row").agg(F.sum(F.col("m") * F.log10((c + 0.1) / F.lit(float(below)))).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("more_known"))
    asked = each("asked", "asked_n").withColumnRenamed("k", "key")
    found = freeze(values(model, asked.select("key").distinct()))
    rest = asked.join(found, "key").groupBy("_row").agg(F.sum(F.col("m") * F.col("value")).alias("rest"))
    whole = F.col("score") + F.coalesce("rest", F.lit(0.0))
    return scored.drop("rare", "rare_n", "asked", "asked_n").join(rare, "_row", "left").join(rest, "_row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        whole.alias("score"),
        "n_bytes",
        (-whole * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _sums(values, starts, lengths):
    edges = np.column_stack([starts, starts + lengths]).ravel()
    return np.add.reduceat(np.append(values, 0.0), edges)[::2]


def score_documents(docs: DataFrame, fold: int = 10) -> DataFrame:
    """Train on the rows whose id's crc32 is not 0 by ``fold`` and score all rows."""
    model = train(docs.where(crc_of_id() % fold != 0).select("text"))
    return score(docs, model).withColumn("held_out", crc_of_id() % fold == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
