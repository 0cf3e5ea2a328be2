"""An encoder of names that learns from the ontology: weighted character n-grams, whitened.

A text is its set of hashed character trigrams, with marks at its ends. A trigram weighs the
inverse frequency that it has among all names, and stands in a few signed places of a short
vector. The second moments of all names' vectors, summed by partition, give the projection
that makes common directions (words that many names share) short and leaves rare ones long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of trigrams, places of a trigram in the vector.
BUCKETS, PLACES = 1 << 16, 4
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct trigrams of each text, without a step per character."""
    marked = [f"\u0002\u0002{(t or '').lower()}\u0003" for t in texts]
    size = np.array([len(t) - 2 for t in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(row)) + 2 * row
    bucket = _mix(points[at] + (points[at + 1] << _U(21)) + (points[at + 2] << _U(42))) % _U(BUCKETS)
    key = np.unique(row.astype(np.int64) * BUCKETS + bucket.astype(np.int64))
    return key // BUCKETS, key % BUCKETS


def _project(row: np.ndarray, weight: np.ndarray, bucket: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    out = np.zeros(n * dimensions)
    for k in range(PLACES):
        h = _mix(bucket.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(k + 1))
        place = row * dimensions + (h % _U(dimensions)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> _U(40)) & _U(1)).astype(float)
        out += np.bincount(place, weight * sign, minlength=len(out))
    return out.reshape(n, dimensions)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Encoder:
    """Weights of trigrams and a projection; ``vectors`` of texts are unit rows."""

    def __init__(self, idf: np.ndarray, projection: np.ndarray):
        self.idf, self.projection = idf, projection

    def vectors(self, texts: list[str]) -> np.ndarray:
        row, bucket = trigrams(texts)
        x = _project(row, self.idf[bucket], bucket, len(texts), len(self.projection))
        return _unit(_unit(x) @ self.projection)

    def column(self, spark):
        """The encoder as a function of a column; its tables come once to a worker."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = shared.value
            for x in batches:
                yield pd.Series(list(model.vectors(x.tolist()).astype(np.float32)))

        return encode


def fit_encoder(names: DataFrame, name: str = "name", dimensions: int = 256, ridge: float = 0.3) -> Encoder:
    """The encoder of all ``names``: two passes, each summed by partition; what comes to the
    driver is BUCKETS counts and sixteen matrices of ``dimensions`` squared."""
    texts = names.where(F.col(name).isNotNull()).select(F.col(name).alias("t"))

    def count(batches):
        n, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += np.bincount(trigrams(batch.column(0).to_pylist())[1], minlength=BUCKETS)
            rows += batch.num_rows
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], rows))], ["bucket", "n"])

    idf, total = np.zeros(BUCKETS), 0
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        if r.bucket < 0:
            total = r.n
        else:
            idf[r.bucket] = r.n
    first = Encoder(np.log((total + 1) / (idf + 1)) + 0.1, np.eye(dimensions))
    shared = names.sparkSession.sparkContext.broadcast(first)

    def moments(batches):
        s = np.zeros((dimensions, dimensions))
        for batch in batches:
            x = shared.value.vectors(batch.column(0).to_pylist())
            s += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], ["s"])

    s = sum((np.frombuffer(r.s).reshape(dimensions, dimensions) for r in texts.repartition(16).mapInArrow(moments, "s binary").collect()), np.zeros((dimensions, dimensions)))
    value, vector = np.linalg.eigh(s / max(total, 1))
    value = np.maximum(value, 0)
    scale = 1 / np.sqrt(value + ridge * max(value.mean(), 1e-12))
    return Encoder(first.idf, (vector * scale) @ vector.T)
