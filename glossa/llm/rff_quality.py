"""Quality classifier: random Fourier features of document statistics, ridge, isotonic.

Statistics of whole texts (character classes, words, repetition, lines) are standardised
and mapped to cosines of random projections, which approximate a Gaussian kernel. Each
partition sums its part of the normal equations, by two folds; the driver adds the
fixed-size sums and solves for ridge weights, of both folds and of each alone.
Pool-adjacent-violators turns raw values into probabilities: it is fitted on the values that
each fold gets from the other one's weights, so no row calibrates what it was fitted on.

Bound, a parameter: ``FIT_ROWS`` labelled documents are fitted on.

Defined cases: null and empty texts have the statistics of an empty text; with one class
or no labels every score is the smoothed share of label 1; equal texts, repeated rows too,
get equal scores; of several labels of an id the largest counts; equal values pool; very
long texts are measured whole; an empty table gives an empty result; further columns are
not read unless they are carried, in one struct.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.batches import held_out, labelled_sample, small_batches
from glossa.llm.common import freeze

FIT_ROWS = 20_000
DIMENSIONS = 384
RIDGE = 1e-4


def _classes() -> np.ndarray:
    """Byte to character class, as columns of 0 and 1."""
    sets = [range(65, 91), range(97, 123), range(48, 58), [32], [10], b".,;:", b"!?", b"#*$%&<>", b"|", b"@/\\_=+~^", b"()[]{}\"'-", range(128, 192), range(192, 256)]
    out = np.zeros((256, len(sets)))
    for k, s in enumerate(sets):
        out[list(s), k] = 1
    return out


_CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """Numbers that describe one whole text."""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    n = max(1, len(raw))
    share = hist / n
    some = share[share > 0]
    words = text.split()
    k = max(1, len(words))
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / k
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    capitals = sum(map(str.isupper, words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        *(share @ _CLASSES),
        float(-(some * np.log2(some)).sum()),
        np.log1p(len(words)),
        mean,
        np.log1p(max(lengths)),
        len(counts) / k,
        np.log1p(len(words)) * len(counts) / k,
        pairs / max(1, len(words) - 1),
        max(counts.values(), default=0) / k,
        capitals / k,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
    ]


WIDTH = len(statistics(""))


def _measure(batches):
    for batch in batches:
        values = [np.asarray(statistics(x or "")).tolist() for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])


def features(x: np.ndarray, m: dict) -> np.ndarray:
    """Cosines of random projections of standardised statistics, and a constant."""
    z = np.clip((x - m["mean"]) / m["scale"], -6, 6)
    return np.hstack([np.cos(z @ m["w"] + m["b"]) * np.sqrt(2 / DIMENSIONS), np.ones((len(x), 1))])


def fold_of(x: np.ndarray) -> np.ndarray:
    """0 or 1 for each row of statistics, by its bytes."""
    return np.array([zlib.crc32(row.tobytes()) & 1 for row in np.ascontiguousarray(x, float)], np.int64)


def _normal(m):
    def run(batches):
        a, b = np.zeros((2, DIMENSIONS + 1, DIMENSIONS + 1)), np.zeros((2, DIMENSIONS + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, WIDTH)
            phi, y, fold = features(x, m), batch.column(1).to_numpy(zero_copy_only=False).astype(float), fold_of(x)
            for k in (0, 1):
                a[k] += phi[fold == k].T @ phi[fold == k]
                b[k] += phi[fold == k].T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    return run


def ridge(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Weights of the normal equations; the constant is not penalised."""
    return np.linalg.solve(a + RIDGE * rows * np.diag([1.0] * DIMENSIONS + [0.0]) + 1e-9 * np.eye(DIMENSIONS + 1), b)


def isotonic(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing probabilities. Equal values pool."""
    knots, inverse = np.unique(value, return_inverse=True)
    total, weight = np.bincount(inverse, y), np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []  # sum, weight, first, last
    for i in range(len(knots)):
        blocks.append([total[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    # Smoothed by a pseudo-observation, so no block claims certainty.
    xs = np.array([knots[int(k)] for b in blocks for k in (b[2], b[3])])
    ps = np.array([(b[0] + 0.5 * 1e-3) / (b[1] + 1e-3) for b in blocks for _ in (0, 1)])
    return xs, ps


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 7) -> dict:
    small_batches(docs.sparkSession)
    sample = freeze(labelled_sample(docs, labels, "quality", rows).mapInArrow(_measure, "x array<double>, label int").repartition(8))
    x, y = None, None
    got = sample.toPandas().sort_values("label", kind="stable") if not sample.isEmpty() else None  # at most `rows` rows of WIDTH numbers
    if got is None or got.label.nunique() < 2:
        n, ones = (0, 0) if got is None else (len(got), int(got.label.sum()))
        return {"share": (ones + 1) / (n + 2)}
    x, y = np.vstack(got.x.to_numpy()), got.label.to_numpy(float)
    draw = np.random.default_rng(seed)
    scale = x.std(axis=0)
    m = {"mean": x.mean(axis=0), "scale": np.where(scale > 1e-9, scale, 1.0), "w": draw.normal(size=(WIDTH, DIMENSIONS)) * 0.25, "b": draw.uniform(0, 2 * np.pi, DIMENSIONS)}
    sums = sample.mapInArrow(_normal(m), "a binary, b binary").collect()  # a fixed size for each of 8 partitions
    size = DIMENSIONS + 1
    a = sum(np.frombuffer(r.a).reshape(2, size, size) for r in sums)
    b = sum(np.frombuffer(r.b).reshape(2, size) for r in sums)
    m["beta"] = ridge(a.sum(axis=0), b.sum(axis=0), len(y))
    phi, fold = features(x, m), fold_of(x)
    both = all(len(np.unique(y[fold == k])) == 2 for k in (0, 1))
    raw = phi @ m["beta"]
    for k in (0, 1) if both else ():  # too few rows for two folds calibrate on themselves
        raw[fold == k] = phi[fold == k] @ ridge(a[1 - k], b[1 - k], int((fold != k).sum()))
    m["knots"], m["levels"] = isotonic(raw, y)
    return m


def predict(x: np.ndarray, m: dict) -> np.ndarray:
    if "share" in m:
        return np.full(len(x), m["share"])
    return np.clip(np.interp(features(x, m) @ m["beta"], m["knots"], m["levels"]), 0, 1)


def score(docs: DataFrame, model: dict, carry: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``carry``) and score of every row."""
    names = carry or ["doc_id"]
    out = docs.select(*names, F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed by DIMENSIONS and FIT_ROWS

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            x = np.array([statistics(t or "") for t in texts.to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(predict(x, m))], [*names, "score"])

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
    return out.mapInArrow(run, f"{schema}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (at 0.3)."""
    d = score(docs, fit(docs, labels))
    return d.select("doc_id", held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
