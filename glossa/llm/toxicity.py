"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Features are the presence of hashed character n-grams (3 to 6 code points of the
lower-cased text).
On a bounded sample of labelled documents Spark sums each bucket's documents per class;
the log-count ratio r of a bucket scales its feature, the buckets with the largest
z-scores of r stay, and a regularised logistic regression over the scaled features gives
the weights. Scoring is one pass over whole texts without a shuffle.

Bounds, both parameters: ``FIT_ROWS`` documents are fitted on and ``FEATURES`` kept.

Defined cases: null and empty texts have no features and get the score of the bias; with
one class or no labels the score is the smoothed share of label 1; equal texts, repeated
rows too, get equal scores; of several labels of an id the largest counts; ties among
features go by bucket; very long texts are scored whole; an empty table gives an empty
result; further columns are not read, so any names may stand there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.batches import held_out, labelled_sample, points, small_batches, steps

ORDERS = (3, 4, 5, 6)
BITS = 20
FIT_ROWS = 12_000
FEATURES = 4096


def gram_buckets(data: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Bucket + 1 of the n-gram that starts at each code point; 0 where it would leave its text."""
    n = len(data)
    out = np.zeros(n, np.uint32)
    if n < order:
        return out
    h = np.full(n - order + 1, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h ^= data[k : n - order + 1 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - BITS)
    out[: n - order + 1] = h
    out[: n - order + 1] += np.uint32(1)
    last = (ends[:, None] - np.arange(1, order)[None, :]).ravel()
    starts = np.repeat(np.concatenate([[0], ends[:-1]]), order - 1)
    out[last[last >= starts]] = 0
    return out


def _hits(data, offsets, keep):
    """(row, kept index) pairs, each once: ``keep`` maps bucket + 1 to index + 1 or 0."""
    ends = offsets[1:]
    found = []
    for order in ORDERS:
        got = keep[gram_buckets(data, ends, order)]
        at = np.flatnonzero(got)
        found.append(np.searchsorted(ends, at, "right") * (len(keep)) + got[at])
    pairs = np.unique(np.concatenate(found))
    return pairs // len(keep), pairs % len(keep) - 1


def _count(batches):
    sums: dict[int, np.ndarray] = {}
    everything = np.arange((1 << BITS) + 1, dtype=np.int64)
    for batch in batches:
        data, offsets = points(batch.column(0))
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in steps(offsets):
            rows, found = _hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], everything)
            for c in (False, True):
                sums[c] = sums.get(c, np.zeros(1 << BITS, np.int32))
                np.add.at(sums[c], found[y[a:b][rows] == c], 1)
    if sums:
        at = np.flatnonzero(sums[False] + sums[True])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[True][at].astype(np.int64)), pa.array(sums[False][at].astype(np.int64))], ["bucket", "pos", "neg"])


def _presence(keep):
    def run(batches):
        for batch in batches:
            data, offsets = points(batch.column(0))
            for a, b in steps(offsets):
                rows, found = _hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keep)
                grid = np.zeros((b - a, FEATURES), bool)
                grid[rows, found] = True
                bits = np.packbits(grid, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in bits], pa.binary()), batch.column(1).slice(a, b - a)], ["bits", "label"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps_: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent, classes weighted by frequency."""
    n = len(y)
    s = np.linalg.norm(x[:: max(1, n // 2000)], axis=1)
    rate = 4.0 / (float((s**2).mean()) + 1 + l2)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(steps_):
        z = x @ v[:-1] + v[-1]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(x.T @ g / n + l2 * v[:-1], g.mean()).astype(np.float32)
        new = v - rate * grad
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """The model: bucket -> kept index table, weights of kept features, bias."""
    sample = labelled_sample(docs, labels, "toxic", rows).repartition(8)
    counts = sample.mapInArrow(_count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return {"keep": np.zeros((1 << BITS) + 1, np.uint16), "weights": np.zeros(1, np.float32), "bias": float(np.log(share / (1 - share)))}
    r = F.log((F.col("pos") + 1) / F.lit(n1 + 2)) - F.log((F.col("neg") + 1) / F.lit(n0 + 2))
    z = F.abs(r) / F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))
    top = counts.where("pos + neg >= 5").select("bucket", r.alias("r"), z.alias("z")).orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()
    keep = np.zeros((1 << BITS) + 1, np.uint16)
    ratio = np.zeros(FEATURES, np.float32)
    for i, x in enumerate(top):
        keep[x.bucket + 1], ratio[i] = i + 1, x.r
    got = sample.mapInArrow(_presence(keep), "bits binary, label int").toPandas()  # at most `rows` rows of FEATURES / 8 bytes
    got = got.sort_values(["bits", "label"])
    x = np.unpackbits(np.frombuffer(b"".join(got.bits), np.uint8).reshape(len(got), -1), axis=1)[:, :FEATURES].astype(np.float32)
    x *= ratio
    w, bias = logistic(x, got.label.to_numpy(np.float32))
    return {"keep": keep, "weights": w * ratio, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB: fixed by BITS and FEATURES

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = points(batch.column(1))
            z = np.full(len(offsets) - 1, m["bias"])
            for a, b in steps(offsets):
                rows, found = _hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m["keep"])
                z[a:b] += np.bincount(rows, m["weights"][found], minlength=b - a) if len(rows) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    d = score(docs, fit(docs, labels))
    return d.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
