"""Recognition: pluggable token labellers over token rows, a gazetteer and models over windows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.spans import WORD, bounded_batches, decode_rows, decode_tags, slices, token_rows, window_starts, windows

#: A recognizer takes token rows (key, tokens: token, start, end, lead) and gives tags (key,
#: token, start, end, lead, tag); tokens that it leaves out are outside of all spans. It may
#: have ``rows``, which gives token rows with ``tags`` instead, so that spans are decoded within
#: the row, and ``single`` where every tagged token is a span of its own.
Recognizer = Callable[[DataFrame], DataFrame]


def gazetteer(terms: DataFrame, label: str = "cell_type", longest: int = 5) -> Recognizer:
    """Tags tokens that belong to a term of at most ``longest`` tokens. Longer matches win
    over shorter ones that begin within them; terms: (term)."""
    words = F.filter(F.split(F.lower("term"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    table = terms.select(F.array_join(words, " ").alias("phrase"), F.size(words).alias("n")).where(f"n between 1 and {longest}").distinct()
    own = ["token", "start", "end", "lead"]

    def run(rows: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        key = rows.columns[0]
        if longest == 1:
            tokens = rows.select(key, F.explode("tokens").alias("_t")).select(key, "_t.*").withColumn("_p", F.lower("token"))
            found = tokens.join(table.select("phrase"), F.col("_p") == F.col("phrase"))
            return found.select(key, *own, F.lit(f"B-{label}").alias("tag"))
        # All phrases that begin at a token are made within the row.
        lower = "transform(tokens, t -> lower(t.token))"
        phrases = f"transform(sequence(1, least({longest}, size(w) - i)), k -> array_join(slice(w, i + 1, k), ' '))"
        grams = F.expr(f"transform(array({lower}), w -> transform(tokens, (t, i) -> struct(t, {phrases} as phrases)))[0]")
        d = rows.where("size(tokens) > 0").select(key, F.posexplode(grams).alias("pos", "_g"))
        d = d.select(key, "pos", "_g.t.*", F.posexplode("_g.phrases").alias("_n", "_p"))
        found = d.join(table, (F.col("_p") == F.col("phrase")) & (F.col("_n") + 1 == F.col("n")), "left")
        d = found.groupBy(key, "pos", *own).agg(F.max("n").alias("len"))
        # A token is inside if a match that begins before it reaches it.
        before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.max(F.col("pos") + F.col("len")).over(before), F.lit(-1)) > F.col("pos")
        tag = F.when(inside, f"I-{label}").when(F.col("len").isNotNull(), f"B-{label}").otherwise("O")
        return d.select(key, *own, tag.alias("tag"))

    run.single = longest == 1
    return run


def recognize(passages: DataFrame, recognizer: Recognizer, key: str = "passage_id", text: str = "text", word: str = WORD) -> DataFrame:
    """(key, label, start, end, n_tokens, text) of all recognised spans. A span's text is made
    of its own tokens, so no text is shuffled."""
    rows = token_rows(passages, key, text, word, lead=True)
    if hasattr(recognizer, "rows"):
        return decode_rows(recognizer.rows(rows), key)
    tags = recognizer(rows)
    if getattr(recognizer, "single", False):
        return tags.select(key, F.expr("substring(tag, instr(tag, '-') + 1)").alias("label"), "start", "end", F.lit(1).cast("long").alias("n_tokens"), F.col("token").alias("text"))
    return decode_tags(tags, key, ["start"], "tag", "start", "end", "token", "lead")


# ---------------------------------------------------------------- models over windows


class Lazy:
    """A model that each worker makes by ``load`` when it first needs it; ``labels`` in the
    order of its scores."""

    def __init__(self, load: Callable[[], object], labels: list[str]):
        self.load, self.labels, self._made = load, list(labels), None

    def scores(self, tokens: list[str], sizes: np.ndarray) -> np.ndarray:
        if self._made is None:
            self._made = self.load()
        return self._made.scores(tokens, sizes)

    def __getstate__(self):
        return {**self.__dict__, "_made": None}


def features(tokens: list[str], sizes: Iterable[int]) -> list[list[str]]:
    """Of every kind of feature its value at each token: the token, its ending, and its
    neighbours within the window."""
    low = [t.lower() for t in tokens]
    before, after = ["^", *low[:-1]], [*low[1:], "$"]
    at = 0
    for n in sizes:
        if n:
            before[at], after[at + n - 1] = "^", "$"
        at += n
    return [[f"{kind}:{x}" for x in values] for kind, values in (("w", low), ("s", [t[-3:] for t in low]), ("p", before), ("n", after))]


class Linear:
    """A linear token classifier: the sum of the weights of a token's features per label."""

    def __init__(self, labels: list[str], prior: np.ndarray, weights: dict[str, int], table: np.ndarray):
        self.labels, self.prior, self.weights, self.table = list(labels), prior, weights, table

    def scores(self, tokens: list[str], sizes: np.ndarray) -> np.ndarray:
        """(tokens, labels) scores of windows' tokens, one window after the other."""
        out = np.tile(self.prior, (len(tokens), 1))
        for values in features(tokens, sizes.tolist()):
            out += self.table[[self.weights.get(v, -1) for v in values]]  # the last row is of unknown features
        return out


def _windows_of(batch: pa.RecordBatch, k: int):
    """(sizes, fields of all tokens) of a column of windows."""
    sizes = pa.compute.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.column(k).flatten()
    return sizes, {f.name: flat.field(i) for i, f in enumerate(flat.type)}


def fit_linear(tagged: DataFrame, labels: list[str], least: int = 5, most: int = 200_000) -> Linear:
    """The classifier of windows whose tokens have a ``tag`` (see ``tagged_windows``): a weight is
    the logarithm of the label's share of the feature in all windows. Features that occur ``least`` times or more have weights, at most
    the ``most`` most frequent: that bounds the model, not what is counted."""
    place = {t: k for k, t in enumerate(labels)}

    def run(batches):
        count: Counter = Counter()

        def out():
            rows = list(count.items())
            count.clear()
            return pa.RecordBatch.from_arrays([pa.array([f for (f, _), _ in rows], pa.string()), pa.array([t for (_, t), _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["feature", "label", "n"])

        for batch in slices(batches):
            sizes, token = _windows_of(batch, 0)
            tags = [place[t] for t in token["tag"].to_pylist()]
            for values in features(token["token"].to_pylist(), sizes.tolist()):
                count.update(zip(values, tags, strict=True))
            count.update(("", t) for t in tags)
            if len(count) > 200_000:
                yield out()
        yield out()

    each = tagged.select("tokens").mapInArrow(run, "feature string, label int, n long")
    sums = each.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in range(len(labels))])
    kept = sums.where((F.col("n") >= least) | (F.col("feature") == "")).orderBy(F.desc("n"), "feature").limit(most + 1).collect()  # `most` rows
    whole = next(([r[f"n_{k}"] for k in range(len(labels))] for r in kept if r.feature == ""), [0] * len(labels))
    total, size = sum(whole), len(labels)
    weight = lambda n, c: math.floor(1000 * math.log((c + 1) / (n + size)))
    rows = [r for r in kept if r.feature != ""]
    table = np.array([[weight(r.n, r[f"n_{k}"]) for k in range(size)] for r in rows] + [[0] * size], float)
    prior = np.array([weight(total, c) for c in whole], float)
    return Linear(labels, prior, {r.feature: k for k, r in enumerate(rows)}, table)


def tagged_windows(tagged: DataFrame, key: str, max_length: int = 512, overlap: int = 128, special: int = 2) -> DataFrame:
    """(key, chunk, first, tokens) of rows (key, tokens, tags): windows whose tokens have a tag."""
    names = [f.name for f in tagged.schema["tokens"].dataType.elementType]
    both = F.expr(f"transform(arrays_zip(tokens, tags), x -> struct({', '.join(f'x.tokens.{n} as {n}' for n in names)}, x.tags as tag))")
    return windows(tagged.select(key, both.alias("tokens")), key, max_length, overlap, special)


def score_windows(cut: DataFrame, key: str, model) -> DataFrame:
    """(key, chunk, token, start, end, lead, s_0, ...): a score per token and label of every
    window. The model comes once to a worker; a token that it scores NaN has none."""
    bounded_batches(cut.sparkSession)
    shared = cut.sparkSession.sparkContext.broadcast(model)
    names = [f"s_{k}" for k in range(len(model.labels))]

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            sizes, token = _windows_of(batch, 2)
            s = np.asarray(m.scores(token["token"].to_pylist(), sizes), float)
            of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            own = [token[c] for c in ("token", "start", "end", "lead")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *own, *[pa.array(s[:, k], mask=np.isnan(s[:, k])) for k in range(len(names))]], [key, "chunk", "token", "start", "end", "lead", *names])

    d = cut.select(key, "chunk", "tokens")
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, chunk int, token string, start int, end int, lead string, {', '.join(f'{n} double' for n in names)}")


def best_of(labels: list[str], means: list[Column], default: str = "O") -> Column:
    """The label of the largest mean, the first one on ties; the default without any."""
    names = F.array(*[F.lit(x) for x in labels])
    top = F.array_max(F.array(*means))
    return F.when(top.isNull(), default).otherwise(F.get(names, (F.array_position(F.array(*means), top) - 1).cast("int")))


def windowed(model, max_length: int = 512, overlap: int = 128, special: int = 2) -> Recognizer:
    """A recognizer of a model with ``labels`` and ``scores(tokens, sizes)``: windows of tokens,
    scores of every window, their means over the windows that hold a token (by its exact
    place), the best label. Windows are cut within the row, and a text's scores meet once."""

    def run(rows: DataFrame) -> DataFrame:
        key = rows.columns[0]
        scored = score_windows(windows(rows, key, max_length, overlap, special), key, model)
        names = [f"s_{k}" for k in range(len(model.labels))]
        # Dealt by text, which the decoding needs as well: no second shuffle.
        means = scored.repartition(key).groupBy(key, "start", "end", "token", "lead").agg(*[F.avg(n).alias(n) for n in names])
        return means.select(key, "token", "start", "end", "lead", best_of(model.labels, [F.col(n) for n in names]).alias("tag"))

    def tagged(rows: DataFrame) -> DataFrame:
        return tag_windows(rows, rows.columns[0], model, max_length, overlap, special)

    run.rows = tagged
    return run


def tag_windows(rows: DataFrame, key: str, model, max_length: int = 512, overlap: int = 128, special: int = 2) -> DataFrame:
    """Token rows with ``tags``: windows, scores, means and the best label within each row; the
    first label on ties, O without any score."""
    _, width = window_starts("0", max_length, overlap, special)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    bounded_batches(rows.sparkSession)
    names = np.array([*model.labels, "O"], object)

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            sizes, token = _windows_of(batch, 1)
            ends = np.cumsum(sizes)
            cuts = [(e - n + a, min(e - n + a + width, e)) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True) if n for a in range(0, max(n - overlap, 1), width - overlap)]
            at = np.concatenate([np.arange(a, b) for a, b in cuts]) if cuts else np.zeros(0, np.int64)
            words = token["token"].to_pylist()
            s = np.asarray(m.scores([words[k] for k in at.tolist()], np.array([b - a for a, b in cuts], np.int64)), float).reshape(len(at), len(names) - 1)
            total, count = np.zeros((len(words), len(names) - 1)), np.zeros((len(words), len(names) - 1))
            np.add.at(total, at, np.nan_to_num(s, nan=0.0, posinf=np.inf, neginf=-np.inf))
            np.add.at(count, at, ~np.isnan(s))
            mean = np.where(count > 0, total / np.maximum(count, 1), -np.inf)
            best = np.where((count > 0).any(axis=1), mean.argmax(axis=1), len(names) - 1)
            tags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(names[best].tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tags], [key, "tokens", "tags"])

    d = rows.select(key, "tokens")
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, tokens {d.schema[1].dataType.simpleString()}, tags array<string>")
