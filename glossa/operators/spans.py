"""Token, chunk, label and span operators: windows, interval joins, gaps and islands."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of tokens: letters and numbers, the same with the underscore (which counts in
#: evaluations), letters of ASCII. Python's classes of one character.
WORD, EVALUATED, ASCII = r"[^\W_]", r"\w", "[A-Za-z]"
#: Characters of texts that are cut at once (or one text), characters of a bin of interval joins.
PART, BIN = 1 << 20, 64
TOKENS = "array<struct<token:string,start:int,end:int>>"
TOKENS_WITH_LEADS = "array<struct<token:string,start:int,end:int,lead:string>>"


@cache
def _class(word: str, size: int) -> np.ndarray:
    """Whether each code point below ``size`` belongs to a class."""
    own = re.compile(word)
    return np.array([own.match(chr(c)) is not None for c in range(size)])


def char_class(word: str, points: np.ndarray) -> np.ndarray:
    """Whether each of some code points belongs to a class."""
    return _class(word, 1 << max(int(points.max(initial=0)).bit_length(), 8))[points]


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings that lie one after the other in UTF-8 bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _cut(texts: list[str], word: str, lead: bool) -> pa.Array:
    """The tokens of each text: maximal runs of characters of the class, by array operations
    over all texts at once."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    inside = char_class(word, points)
    before, after = np.roll(inside, 1), np.roll(inside, -1)
    before[row[:-1][row[:-1] < len(points)]] = False
    after[row[1:][row[1:] > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    of = np.searchsorted(row, first, "right") - 1
    raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    width = np.diff(byte)
    fields = [_strings(raw[np.repeat(inside, width)], byte[last] - byte[first]), pa.array((first - row[of]).astype(np.int32)), pa.array((last - row[of]).astype(np.int32))]
    names = ["token", "start", "end"]
    if lead:  # what lies between a token and the one before; what follows a text's last token is left out
        begin = np.where(np.concatenate([[-1], of[:-1]])[: len(of)] == of, np.concatenate([[0], last[:-1]])[: len(first)], row[of])
        mark = np.zeros(len(points) + 1, np.int64)
        np.add.at(mark, begin, 1)
        np.add.at(mark, first, -1)
        fields.append(_strings(raw[np.repeat(np.cumsum(mark[:-1]) > 0, width)], byte[first] - byte[begin]))
        names.append("lead")
    counts = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names))


#: Bytes of an Arrow batch, rows of token arrays that a step in Python works on.
BATCH_BYTES, STEP = 16 << 20, 128


def bounded_batches(spark) -> None:
    """Hold Arrow batches of this session to a number of bytes that fits a worker's memory,
    whatever the rows' size; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches, rows: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches in steps of some rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _parts(sizes: list[int], limit: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` in size, one row at least."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _cut_batches(batches, word: str, lead: bool = False) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and tokens of batches (key, text), in steps of some characters."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in _parts([len(t) for t in texts]):
            yield batch.column(0).slice(a, b - a), _cut(texts[a:b], word, lead)


def token_rows(docs: DataFrame, key: str, text: str = "text", word: str = WORD, lead: bool = False) -> DataFrame:
    """(key, tokens): of every text the array of its tokens with their code-point places, and
    with ``lead`` the characters before each. A null text has none.

    Places need running sums over a text's characters, which no built-in expression gives;
    batches are cut by array operations, without a step per token, and nothing is shuffled."""

    def run(batches):
        for keys, tokens in _cut_batches(batches, word, lead):
            yield pa.RecordBatch.from_arrays([keys, tokens], [key, "tokens"])

    d = docs.select(key, F.col(text).alias("_text"))
    bounded_batches(docs.sparkSession)
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, tokens {TOKENS_WITH_LEADS if lead else TOKENS}")


def token_spans(docs: DataFrame, key: str, text: str = "text", word: str = WORD, ends: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, token, start, end): code-point places of all words of every text; of those
    that end in one of ``ends``, where some are given: the rest become no rows."""
    if ends:

        def run(batches):
            for keys, tokens in _cut_batches(batches, word):
                own = tokens.flatten()
                kept = np.flatnonzero(reduce(np.logical_or, [pa.compute.ends_with(own.field("token"), e).to_numpy(zero_copy_only=False) for e in ends]))
                begin = tokens.offsets.to_numpy()
                of = np.searchsorted(begin, kept, "right") - 1
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array((kept - begin[of]).astype(np.int32)), *[own.field(n).take(pa.array(kept)) for n in ("token", "start", "end")]], [key, "pos", "token", "start", "end"])

        bounded_batches(docs.sparkSession)
        d = docs.select(key, F.col(text).alias("_text"))
        return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, pos int, token string, start int, end int")
    return token_rows(docs, key, text, word).select(key, F.posexplode("tokens").alias("pos", "_t")).select(key, "pos", "_t.token", "_t.start", "_t.end")


def _bins(start: str, end: str, width: int = BIN):
    return F.explode(F.expr(f"sequence(cast({start} div {width} as int), cast(({end} - 1) div {width} as int))"))


def meeting(a: DataFrame, b: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Pairs of rows of ``a`` (key, start, end, more) and ``b`` (key, _s, _e, more) that
    overlap. Both meet in the bins that they touch, and a pair counts in the bin where the
    common part begins, so the join is on equal keys and no bin holds a whole document."""
    left = a.where("end > start").withColumn("_bin", _bins("start", "end", width))
    right = b.where("_e > _s").withColumn("_bin", _bins("_s", "_e", width))
    common = F.floor(F.greatest("start", "_s") / width) == F.col("_bin")
    return left.join(right, [key, "_bin"]).where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")) & common).drop("_bin")


def window_starts(n: str, max_length: int = 512, overlap: int = 128, special: int = 2) -> tuple[str, int]:
    """SQL of the first tokens of all windows of ``n`` tokens, and the windows' width."""
    width = max_length - special
    if not 0 <= overlap < width:
        raise ValueError("the overlap must be shorter than a window")
    return f"sequence(0, greatest(cast({n} as int) - {overlap}, 1) - 1, {width - overlap})", width


def chunks(docs: DataFrame, key: str, n: str, max_length: int = 512, overlap: int = 128, special: int = 2) -> DataFrame:
    """(key, chunk, first, last): token windows of max_length - special, each sharing
    ``overlap`` tokens with the one before; the last one may be shorter."""
    starts, width = window_starts(n, max_length, overlap, special)
    d = docs.select(key, F.col(n).cast("int").alias("_n"), F.posexplode(F.expr(starts)).alias("chunk", "first"))
    return d.select(key, "chunk", "first", F.expr(f"least(first + {width}, _n)").alias("last"))


def windows(rows: DataFrame, key: str, max_length: int = 512, overlap: int = 128, special: int = 2) -> DataFrame:
    """(key, chunk, first, tokens): the windows of token rows, cut within the row."""
    starts, width = window_starts("size(tokens)", max_length, overlap, special)
    cut = F.expr(f"transform({starts}, f -> named_struct('first', f, 'tokens', slice(tokens, f + 1, {width})))")
    return rows.where("size(tokens) > 0").select(key, F.posexplode(cut).alias("chunk", "_w")).select(key, "chunk", "_w.first", "_w.tokens")


def average_logits(tokens: DataFrame, keys: list[str], label: str, logit: str) -> DataFrame:
    """Mean logit of each token and label over the chunks that hold the token."""
    return tokens.groupBy(*keys, label).agg(F.avg(logit).alias("mean_logit"), F.count(F.lit(1)).alias("n_chunks"))


def best_label(means: DataFrame, keys: list[str], label: str, logit: str = "mean_logit") -> DataFrame:
    """The label of the largest mean; the smallest label on ties."""
    return means.groupBy(*keys).agg(F.max_by(label, F.struct(F.col(logit), -F.col(label))).alias(label))


def decode_tags(tags: DataFrame, key: str, order: list[str], tag: str, start: str, end: str, token: str | None = None, lead: str | None = None) -> DataFrame:
    """Tags O, B-x, I-x of ordered tokens to (key, label, start, end, n_tokens), and with the
    columns ``token`` and ``lead`` (what lies before it) the span's text.

    A span begins at B, at another label than the token before, or after O; tokens
    without width are left out first. A tag without a dash begins a span of its own."""
    w = Window.partitionBy(key).orderBy(*order)
    some = [F.struct(F.col(lead).alias("lead"), F.col(token).alias("token")).alias("_piece")] if token else []
    d = tags.where(F.col(end) > F.col(start)).select(key, *order, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(tag).alias("_tag"), *some)
    dashed = F.contains("_tag", F.lit("-"))
    d = d.withColumn("_label", F.when(F.col("_tag") == "O", None).when(dashed, F.expr("substring(_tag, instr(_tag, '-') + 1)")).otherwise(F.col("_tag")))
    opens = F.col("_label").isNotNull() & (F.startswith("_tag", F.lit("B-")) | ~dashed | ~F.col("_label").eqNullSafe(F.lag("_label").over(w)))
    d = d.withColumn("_span", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.where("_label is not null")
    out = d.groupBy(key, "_span").agg(F.first("_label").alias("label"), F.min("_s").alias("start"), F.max_by("_e", F.struct(*order)).alias("end"), F.count(F.lit(1)).alias("n_tokens"), *([F.sort_array(F.collect_list(F.struct(*order, "_piece"))).alias("_pieces")] if token else []))  # of one span
    if token:
        text = F.array_join(F.transform("_pieces", lambda x, i: F.when(i == 0, x["_piece"]["token"]).otherwise(F.concat(x["_piece"]["lead"], x["_piece"]["token"]))), "")
        out = out.withColumn("text", text).drop("_pieces")
    return out.drop("_span")


def decode_rows(rows: DataFrame, key: str) -> DataFrame:
    """``decode_tags`` of token rows (key, tokens with ``lead``, tags), within each row: (key,
    label, start, end, n_tokens, text). No token is shuffled."""

    def run(batches):
        for batch in slices(batches):
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            row, flat = np.repeat(np.arange(len(sizes)), sizes), batch.column(1).flatten()
            code = batch.column(2).flatten().dictionary_encode()
            tags = [t or "O" for t in code.dictionary.to_pylist()]
            label = [None if t == "O" else t.split("-", 1)[-1] for t in tags]
            names = sorted({x for x in label if x is not None})
            at = code.indices.to_numpy(zero_copy_only=False)
            own = np.array([-1 if x is None else names.index(x) for x in label] or [-1])[at] if len(at) else np.zeros(0, int)
            fresh = np.array([t.startswith("B-") or "-" not in t for t in tags] or [False])[at] if len(at) else np.zeros(0, bool)
            before = np.concatenate([[-1], own[:-1]])[: len(own)]
            before[np.flatnonzero(np.diff(row)) + 1] = -1
            opens = (own >= 0) & (fresh | (own != before))
            first, inside = np.flatnonzero(opens), np.flatnonzero(own >= 0)
            n = np.bincount(np.cumsum(opens)[inside] - 1, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
            token, lead = (flat.field(c).take(pa.array(inside)).to_pylist() for c in ("token", "lead"))
            texts, k = [], 0
            for size in n.tolist():
                texts.append(token[k] + "".join(a + b for a, b in zip(lead[k + 1 : k + size], token[k + 1 : k + size], strict=True)))
                k += size
            last = first + n - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array([names[x] for x in own[first]], pa.string()), flat.field("start").take(pa.array(first)), flat.field("end").take(pa.array(last)), pa.array(n.astype(np.int64)), pa.array(texts, pa.string())], [key, "label", "start", "end", "n_tokens", "text"])

    d = rows.select(key, "tokens", "tags")
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, label string, start int, end int, n_tokens long, text string")


def _owners(mode: str):
    """(tokens, entities) of a row to each token's entity: -1 where it has none."""

    def of(tokens: pa.Array, entities: pa.Array) -> np.ndarray:
        start, end = (tokens.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
        name, low, high = (entities.field(k).to_numpy(zero_copy_only=False) for k in ("entity", "start", "end"))
        owner = np.full(len(start), -1, np.int64)
        first, last = np.searchsorted(end, low, "right"), np.searchsorted(start, high, "left")
        for k in np.argsort(name, kind="stable").tolist():
            a, b = first[k], last[k]
            cut = b > a and (start[a] < low[k] or end[b - 1] > high[k])
            if mode == "strict" and (cut or b <= a):
                raise ValueError(f"an entity {'cuts a token' if cut else 'meets no token'}: {low[k]}-{high[k]}")
            if not (cut and mode == "skip"):
                owner[a:b] = k
        return owner

    return of


def _tag(mode: str, key: str):
    of = _owners(mode)

    def run(batches):
        for batch in slices(batches):
            out = []
            for r in range(batch.num_rows):
                tokens, entities = (batch.column(k)[r].values for k in (1, 2))
                if tokens is None or not len(tokens):
                    out.append([])
                    continue
                if entities is None or not len(entities):
                    out.append(["O"] * len(tokens))
                    continue
                owner = of(tokens, entities)
                labels = np.array(entities.field("label").to_pylist(), object)
                fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
                out.append(["O" if k < 0 else ("B-" if new else "I-") + labels[k] for k, new in zip(owner.tolist(), fresh.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], [key, "tokens", "tags"])

    return run


def _own_entities(entities: DataFrame, key: str, mode: str) -> DataFrame:
    """(key, _entities): of one text."""
    e = entities.where("end > start" if mode != "strict" else "true").select(key, F.struct(F.col("entity").cast("long").alias("entity"), F.col("label").alias("label"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("e"))
    return e.groupBy(key).agg(F.collect_list("e").alias("_entities"))


def tag_rows(rows: DataFrame, entities: DataFrame, key: str, mode: str = "expand") -> DataFrame:
    """Token rows (key, tokens) with ``tags``: every token's tag of its owner among ``entities``
    (key, entity, label, start, end); the last entity owns a token that several cover.

    ``expand`` takes every token that overlaps an entity, ``skip`` leaves out entities
    that cut a token, ``strict`` fails on them and on entities that meet no token. A token
    whose left neighbour has another owner, or none, begins its span anew. A text's tokens
    and entities meet once, as one row each; no token is shuffled alone."""
    if mode not in ("expand", "skip", "strict"):
        raise ValueError(f"unknown mode {mode}")
    d = rows.join(_own_entities(entities, key, mode), key, "left").select(key, "tokens", "_entities")
    kind = d.schema
    return d.mapInArrow(_tag(mode, key), f"`{key}` {kind[0].dataType.simpleString()}, tokens {kind[1].dataType.simpleString()}, tags array<string>")


def tag_texts(docs: DataFrame, entities: DataFrame, key: str, text: str = "text", word: str = WORD, mode: str = "expand") -> DataFrame:
    """``tag_rows`` of texts: a text meets its entities before it is cut, so texts are shuffled
    and not the tokens, which take many times their bytes."""
    if mode not in ("expand", "skip", "strict"):
        raise ValueError(f"unknown mode {mode}")
    d = docs.select(key, F.col(text).alias("_text")).join(_own_entities(entities, key, mode), key, "left")
    bounded_batches(docs.sparkSession)
    tag = _tag(mode, key)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _parts([len(t) for t in texts]):
                yield from tag([pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _cut(texts[a:b], word, False), batch.column(2).slice(a, b - a)], [key, "tokens", "_entities"])])

    return d.mapInArrow(run, f"`{key}` {d.schema[key].dataType.simpleString()}, tokens {TOKENS}, tags array<string>")


def encode_tags(tokens: DataFrame, entities: DataFrame, key: str, mode: str = "expand") -> DataFrame:
    """Tokens (key, pos, token, start, end), or token rows, with their ``tag``; see ``tag_rows``."""
    if "tokens" not in tokens.columns:
        one = F.struct("pos", *[c for c in ("token", "start", "end") if c in tokens.columns])
        tokens = tokens.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("tokens"))  # of one text
    d = tag_rows(tokens, entities, key, mode)
    d = d.select(key, F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "_x"))
    names = [c for c in ("token", "start", "end") if c in d.schema["_x"].dataType["tokens"].dataType.names]
    return d.select(key, "pos", *[f"_x.tokens.{c}" for c in names], F.col("_x.tags").alias("tag"))


def contained(entities: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Entities with the passage that holds them whole; others have none and go."""
    p = passages.select(key, "passage", F.col("start").alias("_s"), F.col("end").alias("_e"))
    p = p.where("_e > _s").withColumn("_bin", _bins("_s", "_e", 1024))
    d = entities.where("end > start").withColumn("_bin", F.expr("cast(start div 1024 as int)")).join(p, [key, "_bin"]).where("start >= _s and end <= _e")
    return d.withColumn("local_start", F.col("start") - F.col("_s")).drop("_bin", "_s", "_e")


def overlapping_pairs(spans: DataFrame, key: str, index: str) -> DataFrame:
    """(key, a, b): pairs of one key's spans that overlap, a before b."""
    d = spans.select(key, F.col(index).alias("a"), "start", "end")
    other = spans.select(key, F.col(index).alias("b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return meeting(d, other, key).where("a < b").select(key, "a", "b")


def token_overlaps(refs: DataFrame, preds: DataFrame, passages: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(key, ref, pred): spans (key, id, start, end and the columns ``by``, by default their
    type) that overlap, agree in ``by`` and share a token of the passage's text. passages:
    (key, text), and offset where the spans' places do not begin at 0.

    A token meets both spans only where they overlap, so they share one if and only if their
    common part holds a character of a token: spans meet spans, and no token is listed."""
    by = ["type"] if by is None else by
    same = lambda x: F.concat_ws("\u0001", F.col(key).cast("string"), *[F.col(c).cast("string") for c in by])
    r = refs.select(F.col(key).alias("_key"), same(key).alias("_meet"), F.col("id").alias("ref"), "start", "end")
    p = preds.select(same(key).alias("_meet"), F.col("id").alias("pred"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    pairs = meeting(r, p, "_meet").select(F.col("_key").alias(key), "ref", "pred", F.greatest("start", "_s").alias("_a"), F.least("end", "_e").alias("_b"))
    shift = F.col("offset") if "offset" in passages.columns else F.lit(0)
    t = passages.select(key, "text", shift.alias("_o"))
    common = F.expr("substring(text, cast(_a - _o as int) + 1, cast(_b - _a as int))")
    return pairs.join(t, key).where(common.rlike(r"[\p{L}\p{N}_]")).select(key, "ref", "pred").distinct()


#: Folders of sorted ranges that numbered tables read; see ``drop_ranges``.
RANGES: list[str] = []


def drop_ranges(spark) -> None:
    """Delete the files under all numbered tables so far, when nothing reads them any more."""
    while RANGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(RANGES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_ids(d: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Gapless numbers from 0 in a total order. Sorted ranges are written once to the shared
    folder, so a row's number, its file's first number and its place in the file, cannot
    change when a task runs again; no window holds more than one row per file. The files
    stay until ``drop_ranges``."""
    spark = d.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/glossa-ranges"
    path = f"{folder.rstrip('/')}/ranges-{uuid.uuid4().hex}"
    RANGES.append(path)
    d.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = spark.read.schema(d.schema).parquet(path).select(*[F.col(f"`{c}`") for c in d.columns], part.alias("_part"), F.col("_metadata.row_index").alias("_n"))
    sizes = rows.groupBy("_part").agg((F.max("_n") + 1).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_part", before.alias("_shift")))  # one row per file
    return rows.join(shifts, "_part").withColumn(out, F.col("_shift") + F.col("_n")).drop("_part", "_n", "_shift")


def ids_within(d: DataFrame, group: str, order: list[str], out: str = "id") -> DataFrame:
    """Gapless numbers from 0 within each group, in a total order, by numbers over all rows:
    a group with most of the rows is spread like any other."""
    n = running_ids(d, [group, *order], "_id")
    first = n.groupBy(F.col(group).alias("_g")).agg(F.min("_id").alias("_first"))
    return n.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(out, F.col("_id") - F.col("_first")).drop("_id", "_g", "_first")
