"""Best-fit packing of token sequences, with certified bin counts.

Each text becomes token ids and one closing id 0; longer ones are cut into full sequences
and a first piece of the rest. Only rests need packing. Partitions of bounded size pack
their rests by best-fit decreasing, and dual-feasible functions give each partition a
lower bound of its bin count. A partition that meets its bound is done; the others hand
their unfilled bins to new, mixed partitions, which pack again and keep the new bins only
where they are fewer.

With an order of the documents, partitions are consecutive ranges of it, bins are handed on
among neighbours, and sequences are numbered by the place of their first member.

Texts are split at spaces and the parts' ids looked up in a bounded memo; a part that is
not there is encoded. Where white space makes the parts depend on each other, or a text
holds the end marker, the whole text is encoded by tokenizers. Both ways give its ids.

Defined cases: a null text counts as empty, whose ids are the closing id alone; repeated
rows are packed each; an empty table gives an empty result; equal lengths go by id, piece
and checksum; very long texts are cut into full sequences and a rest; further columns are
not read, so any names may stand there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.batches import small_batches
from glossa.llm.common import freeze, positions

CAPACITY = 2048
PART_ROWS = 40_000
MEMO = 1_000_000
VOCABULARY = "byte_bpe_50k"
MARKER = "<|endoftext|>"


class Encoder:
    """Texts to little-endian 32-bit ids, equal to those of ``tokenizers``."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.parts = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _learn(self, part: str) -> bytes:
        """Ids of a part with the space before it."""
        text = " " + part
        ids = self.parts(text) if max(text) < "ɐ" else self.whole.encode(text, add_special_tokens=False).ids
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[part] = out = np.array(ids, "<u4").tobytes()
        return out

    def __call__(self, text: str) -> bytes:
        parts = text.split(" ")
        # White space at an edge of a part would join that of its neighbour.
        if MARKER in text or not text or any(not p or p[0].isspace() or p[-1].isspace() for p in (parts if len(parts) < 2 or "  " in text or "\n " in text or " \n" in text or not text.isprintable() else (parts[0], parts[-1]))):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head = parts[0]
        ids = self.first.get(head)
        if ids is None:
            if len(self.first) >= MEMO // 10:
                self.first.clear()
            self.first[head] = ids = np.array(self.whole.encode(head, add_special_tokens=False).ids, "<u4").tobytes()
        parts[0] = ""
        memo = self.memo
        try:
            return ids + b"".join(map(memo.__getitem__, parts[1:]))
        except KeyError:
            return ids + b"".join([memo.get(p) or self._learn(p) for p in parts[1:]])


class Kept:
    """An encoder that a worker makes at its first use and keeps, with its memo, from task to
    task: it is sent as a broadcast variable."""

    def __init__(self, vocabulary: str):
        self.vocabulary, self.made = vocabulary, None

    def __call__(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(self.vocabulary)
        return self.made


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a first piece of the rest, then full ones."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    shared = docs.sparkSession.sparkContext.broadcast(Kept(vocabulary))  # a name

    def run(batches):
        encode = shared.value()
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(k)
                    out.append((piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; equal lengths in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n = 0, 0  # bit r of open_: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - r
        if r > size:
            room[r - size].append(b)
            open_ |= 1 << (r - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual-feasible functions give."""
    if not len(lengths):
        return 0
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(hist @ size) // capacity)
    for k in range(1, 40):  # rounding down to multiples of 1 / k, except where exact
        value = np.where((k + 1) * size % capacity == 0, k * size, capacity * ((k + 1) * size // capacity))
        best = max(best, -(-int(hist @ value) // (capacity * k)))
    counts, sums = np.cumsum(hist), np.cumsum(hist * size)
    half = capacity // 2
    for a in range(half + 1):  # items above capacity - a count as whole bins, those under a as nothing
        whole = int(counts[capacity] - counts[capacity - a])
        large = int(counts[capacity - a] - counts[half])
        middle = int(sums[half] - (sums[a - 1] if a else 0))
        spare = large * capacity - int(sums[capacity - a] - sums[half])
        best = max(best, whole + large + max(0, -(-(middle - spare) // capacity)))
    return best


def _pack_partition(capacity: int, turn: int):
    """Pack what a task gets; from the second turn on, only if bins get fewer."""

    def run(batches):
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        bound, count = lower_bound(lengths, capacity), int(bins.max()) + 1
        sequence = ((turn << 24 | TaskContext.get().partitionId()) << 32) + bins
        if turn:
            old = t.column("sequence_id").to_numpy()
            before = len(np.unique(old))
            if before <= count:
                count, sequence, offsets = before, old, t.column("offset").to_numpy()
        _, index = np.unique(sequence, return_inverse=True)
        fill = np.bincount(index, lengths)[index]
        unfilled = (fill < capacity) & (count > bound)
        new = {"sequence_id": sequence, "offset": offsets, "part_bins": np.full(len(lengths), count), "part_bound": np.full(len(lengths), bound), "unfilled": unfilled}
        for k, v in new.items():
            column = pa.array(v.astype(bool) if k == "unfilled" else v.astype(np.int64))
            t = t.set_column(t.column_names.index(k), k, column) if k in t.column_names else t.append_column(k, column)
        yield from t.to_batches()

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, turns: int = 3, order: str | None = None) -> DataFrame:
    """``items`` (doc_id, piece, length, ids_crc32 and more) with sequence_id, offset and
    the certificate of the partition that placed them: part_bins >= part_bound. With a
    column ``order``, partitions are consecutive ranges of it."""
    names = items.columns
    schema = ", ".join(f"`{c}` {k}" for c, k in items.dtypes) + ", sequence_id long, offset long, part_bins long, part_bound long, unfilled boolean"
    full = items.where(F.col("length") == capacity)
    # A full piece is a sequence of its own; its number is negative.
    full = full.select(*names, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), *[F.lit(x).cast("long").alias(c) for c, x in (("offset", 0), ("part_bins", 1), ("part_bound", 1))])
    todo, done = items.where(F.col("length") < capacity), []
    rows = todo.count()
    for turn in range(turns):
        if not rows:
            break
        parts = -(-rows // part_rows)
        if order is None:
            dealt = todo.repartition(parts, F.xxhash64("doc_id", "piece") if not turn else F.xxhash64("sequence_id", F.lit(turn)))
        elif not turn:
            dealt = todo.repartitionByRange(parts, order, "piece")
        else:
            first = F.min(order).over(Window.partitionBy("sequence_id"))
            dealt = todo.withColumn("_first", first).repartitionByRange(parts, "_first", "sequence_id").drop("_first")
        placed = freeze(dealt.mapInArrow(_pack_partition(capacity, turn), schema))
        todo = placed.where("unfilled")
        rows = todo.count() if turn + 1 < turns and parts > 1 else 0
        done.append(placed.drop("unfilled") if not rows else placed.where("not unfilled").drop("unfilled"))
    for d in done:
        full = full.unionByName(d)
    return full


def certificates(packed: DataFrame) -> DataFrame:
    """part, bins, bound of each packed partition."""
    return packed.where("sequence_id >= 0").groupBy((F.col("sequence_id").bitwiseAND(-(1 << 32))).alias("part")).agg(F.max("part_bins").alias("bins"), F.max("part_bound").alias("bound"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound."""
    return pack(freeze(pieces(docs, capacity, vocabulary)), capacity)


def pack_in_order(docs: DataFrame, order: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, part_rows: int = PART_ROWS, buckets: int = 4096) -> DataFrame:
    """As ``pack_documents``, over consecutive ranges of the numbers ``order`` (from 0), with
    ``position``: the gapless number of the sequence by its first member's place."""
    both = docs.select(F.struct("doc_id", F.col(order).alias("order")).alias("doc_id"), "text")
    items = pieces(both, capacity, vocabulary)
    items = freeze(items.select("doc_id.doc_id", *items.columns[1:], F.col("doc_id.order").alias("_order")))
    d = freeze(pack(items, capacity, part_rows, order="_order"))
    firsts = d.groupBy("sequence_id").agg(F.min(F.struct("_order", "piece")).alias("_f")).select("sequence_id", F.col("_f._order").alias("_a"), F.col("_f.piece").alias("_p"))
    top = d.agg(F.max("_order")).head()[0] or 0
    firsts = firsts.withColumn("_b", F.expr(f"_a div {max(1, -(-(top + 1) // buckets))}"))
    numbered = positions(firsts, [], "_b", ["_a", "_p", "sequence_id"], "position")
    return d.join(numbered.select("sequence_id", "position"), "sequence_id").select(*[c for c in d.columns if c != "_order"], "position")
