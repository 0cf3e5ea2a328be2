"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, exact verification.

A text is the bag of its five-word shingles (words split at U+0020 and U+0009 to U+000D; a
text of one to four words is one shingle). Weights, the multiplicities, are discretised by
dyadic intervals (0, 1], (1, 2], (2, 4], ...: each shingle and interval has a Poisson
process of points (time, register, level) that depends on nothing else, and a point counts
if its level is within the weight. The register's first point is the same in two bags with
probability sum(min) / sum(max), so the share of equal registers estimates weighted
Jaccard without bias. Points come in order of time, and a process stops once it is past
the bag's largest register.

``BANDS`` bands of ``ROWS`` registers give buckets (a pair at 0.8 misses all of them with
probability (1 - 0.8 ** 4) ** 25, about 2e-6). First each bucket's members are compared
with ``LEADS`` of them, drawn by hashes: by size, by registers (which drop pairs far below
the threshold; a pair at 0.8 with a probability of about 1e-6), then by the exact overlap
of their bags. Links make classes. Then all pairs of different classes in buckets that
still hold several are compared: a bucket is dealt into blocks, and each pair of blocks is
a cell. A cell looks for pairs whose registers agree and whose first common band is the
bucket's; members of such pairs go on with their texts, and the cell counts the exact
overlap of all their pairs by a product of matrices. It gives links that span what any of
its pairs joins, so rows stay linear where work is quadratic. No pair is left out.

Equal texts (equal MD5 of their bytes) are one node, so copies cost nothing. Groups are
never gathered: buckets are aggregated to counts and leads, and joins are left to the
adaptive splitting of skewed partitions.

Defined cases: a null text counts as empty; equal texts are one class, also without words;
texts without words have no other links; repeated rows are equal texts; very long texts
are processed whole (a cell holds fewer of them); an empty table gives an empty result;
rows without an id keep a class by their text; of rows with equal least ids the one that
comes first by MD5 of its text is kept, of fully repeated rows any one; names of the
table's other columns may clash with those used here, as they are carried in one struct.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.batches import small_batches, steps, utf8
from glossa.llm.common import drop_frozen, freeze

SHINGLE = 5
THRESHOLD = (8, 10)
BANDS, ROWS = 25, 4
#: Members of a bucket that all others are compared with first.
LEADS = 3
#: Rows and shingles of a block of a bucket; two blocks are a cell.
CELL, CELL_SHINGLES = 256, 400_000
#: Registers that must agree before texts are compared: five deviations below 0.8.
AGREE = 60
_U = np.uint64
_P = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = ~space & (np.concatenate([[True], space[:-1]]) | first)
    start = np.flatnonzero(begins)
    stops = ~space & np.concatenate([space[1:] | first[1:], [True]])
    end = np.flatnonzero(stops) + 1
    # Prefix sums of byte * P ** place: a word is a difference, brought to place 0.
    power = np.cumprod(np.full(n, _P, np.uint64))
    inverse = np.cumprod(np.full(n, pow(_P, -1, 1 << 64), np.uint64))
    sums = np.concatenate([[_U(0)], np.cumsum((data.astype(np.uint64) + _U(1)) * power)])
    word = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=len(offsets) - 1)
    at = np.concatenate([[0], np.cumsum(count)])
    size = np.minimum(count, SHINGLE)
    shingle_count = np.where(count > 0, count - size + 1, 0)
    rows = np.repeat(np.arange(len(count)), shingle_count)
    begin = np.arange(len(rows)) - np.repeat(np.cumsum(shingle_count) - shingle_count, shingle_count) + at[rows]
    out = size[rows].astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < size[rows]
        out = np.where(inside, mix(out * _U(_P) + word[np.minimum(begin + k, len(word) - 1)]), out)
    return rows, out


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Registers (n, m): the time of each register's first point, infinite in empty bags."""
    registers = np.full(n * m, np.inf)
    if not len(rows):
        return registers.reshape(n, m)
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(r)))
    row, element = r[at], h[at]
    # One process for each dyadic interval that the weight reaches into.
    parts, low, width = [], 0, 1
    while True:
        reach = np.flatnonzero(weight > low)
        if not len(reach):
            break
        parts.append((row[reach], mix(element[reach] + _U(low * 0x51ED2701 + 1)), np.full(len(reach), low), np.full(len(reach), float(width)), weight[reach]))
        low, width = low + width, max(1, low + width)
    row, state, low_, width_, weight_ = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(row))
    simple = len(parts) == 1
    while len(row):
        state = mix(state + _U(_P))
        time = time - np.log(((state >> _U(11)).astype(float) + 0.5) * 2.0**-53) / width_
        draw = mix(state ^ _U(0xD1B54A32D192ED03))
        register = (draw >> _U(32)) * _U(m) >> _U(32)
        place = row * m + register.astype(np.int64)
        if simple:
            np.minimum.at(registers, place, time)
        else:
            level = low_ + np.floor((draw & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * width_)
            counts = level < weight_
            np.minimum.at(registers, place[counts], time[counts])
        go = time < registers.reshape(n, m).max(axis=1)[row]
        row, state, time, width_ = row[go], state[go], time[go], width_[go]
        if not simple:
            low_, weight_ = low_[go], weight_[go]
    return registers.reshape(n, m)


def _sketch(batches):
    """n (size of the bag) and marks: 32 bits of each register; null without words."""
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        sizes: list = []
        marks: list = []
        for a, b in steps(offsets, 2 << 20):
            rows, hashes = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.bincount(rows, minlength=b - a)
            bits = (mix(signatures(rows, hashes, b - a).view(np.uint64)) & _U(0xFFFFFFFF)).astype("<u4")
            sizes += n.tolist()
            marks += [x.tobytes() if k else None for x, k in zip(bits, n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())], ["rid", "same", "id", "n", "marks"])


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, BANDS * ROWS)


def _near_size(a, b):
    low, high = THRESHOLD
    return np.minimum(a, b) * high >= np.maximum(a, b) * low


def _alike(batches):
    """Pairs whose sizes and registers agree well enough to be worth an exact comparison."""
    for batch in batches:
        x, y = _marks(batch.column(2)), _marks(batch.column(3))
        at = pa.array(np.flatnonzero((x == y).sum(axis=1) >= AGREE))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _shrink(members):
    """Compressed texts of the members' bitmap, a text once in a while only."""

    def run(batches):
        bits, seen = members.value, set()
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(bits[place >> 6] >> (place & 63).astype(np.uint64) & _U(1))
            same = batch.column(0).take(pa.array(at)).to_pylist()
            new = [k for k, s in enumerate(same) if s not in seen and not seen.add(s)]
            texts = batch.column(1).take(pa.array(at[new], pa.int64())).to_pylist()
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([same[k] for k in new], pa.binary()), pa.array([zlib.compress(t.encode("utf-8", "replace"), 1) for t in texts], pa.binary())], ["same", "z"])

    return run


def _bitmap(ids: DataFrame) -> tuple[np.ndarray, Column]:
    """One bit per hashed ``same`` (16 bits an id, 16 MB at most), and the place's column.
    It only spares rows a shuffle: a join on the ids themselves follows."""
    size = max(10, min(27, (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("same"), F.lit(1 << size))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toArrow()  # 2 million rows at most
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits, place


def bag(text: bytes) -> np.ndarray:
    """The sorted shingle hashes of one text, with repeats."""
    return np.sort(shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection of two sorted bags."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    values = both[at]
    total = np.diff(np.append(at, len(both)))
    in_a = np.searchsorted(a, values, "right") - np.searchsorted(a, values, "left")
    return int(np.minimum(in_a, total - in_a).sum())


def _verify(batches):
    low, high = THRESHOLD
    last, held = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if a != last:
                last, held = a, bag(zlib.decompress(x))
            other = bag(zlib.decompress(y))
            both = overlap(held, other)
            keep[i] = both * high >= low * (len(held) + len(other) - both)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _beside(pairs: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of both members. Skewed members are split by AQE."""
    for side in ("b", "a"):
        right = values.select(F.col("rid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(right, side)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """(rid, class), frozen: class is the smallest rid that links (a, b) lead to. Each round
    takes the least class among neighbours and then the class of that, so chains halve; it
    ends when nothing moves."""
    both = freeze(links.select("a", "b").union(links.select("b", "a")).toDF("rid", "near").where("rid <> near").distinct())
    labels = freeze(both.groupBy("rid").agg(F.least(F.first("rid"), F.min("near")).alias("class"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        seen = both.join(labels.select(F.col("rid").alias("near"), "class"), "near").groupBy("rid").agg(F.min("class").alias("least"))
        new = labels.join(seen, "rid").select("rid", F.least("class", "least").alias("head"), F.col("class").alias("old"))
        ahead = labels.select(F.col("rid").alias("head"), F.col("class").alias("next"))
        jumped = new.join(ahead, "head", "left").withColumn("class", F.least("head", F.coalesce("next", "head")))
        after = freeze(jumped.select("rid", "class", (F.col("class") < F.col("old")).alias("moved")))
        drop_frozen(labels)
        labels = after
    drop_frozen(both)
    return labels


# ---------------------------------------------------------------- cells


def _agree(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Of all pairs of two blocks' registers: enough agree, and no band before ``band`` does."""
    if len(x) * len(y) <= 4096:
        equal = (x[:, None, :] == y[None, :, :]).reshape(len(x), len(y), BANDS, ROWS)
        return (equal.sum(axis=(2, 3)) >= AGREE) & ~equal[:, :, :band].all(axis=3).any(axis=2)
    total, earlier = np.zeros((len(x), len(y)), np.uint8), np.zeros((len(x), len(y)), bool)
    for b in range(BANDS):
        every = True
        for k in range(b * ROWS, (b + 1) * ROWS):
            equal = x[:, k][:, None] == y[:, k][None, :]
            total += equal
            every &= equal
        if b < band:
            earlier |= every
    return (total >= AGREE) & ~earlier


def _flag(batches):
    """Cells (key, i, j, band, x, y) to their members (key, i, j, rid, class) of pairs across
    classes that may be near; y is null where the cell is one block."""
    for batch in batches:
        key, i_, j_, band = (batch.column(c).to_pylist() for c in range(4))
        sides = []
        for c in (4, 5):
            column = batch.column(c)
            inner = column.flatten()
            ends = np.cumsum([0, *(k or 0 for k in pa.compute.list_value_length(column).to_pylist())])
            rid, label, n = (inner.field(f).to_numpy(zero_copy_only=False) for f in range(3))
            sides.append((ends, rid, label, n, _marks(inner.field(3))))
        out: list = [[], [], []]
        for r in range(batch.num_rows):
            blocks = [(rid[e[r] : e[r + 1]], label[e[r] : e[r + 1]], n[e[r] : e[r + 1]], marks[e[r] : e[r + 1]]) for e, rid, label, n, marks in sides]
            x, y = blocks[0], blocks[1] if i_[r] != j_[r] else blocks[0]
            if not len(x[0]) or not len(y[0]):
                continue
            near = _agree(x[3], y[3], band[r]) & (x[1][:, None] != y[1][None, :]) & _near_size(x[2].astype(np.int64)[:, None], y[2].astype(np.int64)[None, :])
            for block, some in ((x, near.any(axis=1)), (y, near.any(axis=0)))[: 1 + (i_[r] != j_[r])]:
                at = np.flatnonzero(some)
                out[0] += [r] * len(at)
                out[1] += block[0][at].tolist()
                out[2] += block[1][at].tolist()
        at = pa.array(out[0], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["key", "i", "j", "rid", "class"])


def overlaps(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, n) sizes of the multiset intersections of all pairs of bags."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    # A repeat of a shingle is an element of its own: overlaps of bags are those of sets.
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])) if len(rows) else np.zeros(0, np.int64)
    repeat = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))
    _, element, uses = np.unique(mix(hashes + repeat.astype(np.uint64) * _U(_P)), return_inverse=True, return_counts=True)
    common = uses[element] > 1
    rows, element = rows[common], (np.cumsum(uses > 1) - 1)[element[common]]
    order = np.argsort(element, kind="stable")
    rows, element = rows[order], element[order]
    out = np.zeros((n, n), np.float32)  # exact up to 2 ** 24
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, 4096):
        a, b = np.searchsorted(element, [first, first + 4096])
        grid = np.zeros((n, 4096), np.float32)
        grid[rows[a:b], element[a:b] - first] = 1
        out += grid @ grid.T
    return out


def _forest(batches):
    """Members of cells, a list of (class, z) each, to links (a, b) of classes that span all
    that pairs of the cell at the threshold join."""
    low, high = THRESHOLD
    for batch in batches:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            raw = [zlib.decompress(m["z"]) for m in members]
            rows, hashes = shingles(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
            size = np.bincount(rows, minlength=len(raw)).astype(float)
            both = overlaps(rows, hashes, len(raw)).astype(float)
            names, label = np.unique([m["class"] for m in members], return_inverse=True)
            x, y = np.nonzero(np.triu(both * high >= low * (size[:, None] + size[None, :] - both), 1) & (label[:, None] != label[None, :]))
            head = list(range(len(names)))

            def find(k, head=head):
                while head[k] != k:
                    head[k] = k = head[head[k]]
                return k

            for pair in np.unique(np.minimum(label[x], label[y]) * len(names) + np.maximum(label[x], label[y])).tolist():
                p, q = find(pair // len(names)), find(pair % len(names))
                if p != q:
                    head[max(p, q)] = min(p, q)
                    a.append(int(names[min(p, q)]))
                    b.append(int(names[max(p, q)]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _rest(open_: DataFrame, nodes: DataFrame, packed: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) of classes by all pairs of different classes in a bucket, frozen.
    open_: (key, band, rid), nodes: (rid, n, marks), packed: (rid, z), labels: (rid, class)."""
    members = freeze(open_.join(labels.select("rid", "class"), "rid", "left").withColumn("class", F.coalesce("class", "rid")).join(nodes.select("rid", "n"), "rid"))
    mixed = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n").cast("long")).alias("shingles"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    mixed = mixed.select("key", F.expr(f"cast(least(rows, greatest(ceil(rows / {CELL}), ceil(shingles / {CELL_SHINGLES}))) as int)").alias("blocks"))
    dealt = members.join(mixed, "key").withColumn("block", F.expr("cast(pmod(xxhash64(rid, key), blocks) as int)"))
    dealt = dealt.join(nodes.select("rid", "marks"), "rid")
    blocks = freeze(dealt.groupBy("key", "band", "block", "blocks").agg(F.collect_list(F.struct("rid", "class", "n", "marks")).alias("m")))  # CELL rows or so
    left = blocks.where("blocks > 1").select("key", "band", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), F.col("m").alias("x"))
    right = blocks.where("blocks > 1").select("key", F.col("block").alias("j"), F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("m").alias("y"))
    cells = left.join(right, ["key", "i", "j"]).select("key", "i", "j", "band", "x", F.when(F.col("i") < F.col("j"), F.col("y")).alias("y"))
    alone = blocks.where("blocks = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "band", F.col("m").alias("x"), F.lit(None).cast(blocks.schema["m"].dataType).alias("y"))
    flagged = freeze(cells.unionByName(alone).mapInArrow(_flag, "key long, i int, j int, rid long, class long"))
    full = flagged.join(packed, "rid").groupBy("key", "i", "j").agg(F.collect_list(F.struct("class", "z")).alias("m"))  # two blocks at most
    links = freeze(full.select("m").mapInArrow(_forest, "a long, b long").distinct())
    drop_frozen(members, blocks, flagged)
    return links


# ---------------------------------------------------------------- the operator


def link(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """(same, class), frozen: class is the rid of a text. sketches: (rid, same, n, marks), frozen;
    texts: (same, text), with copies."""
    groups = freeze(sketches.groupBy("same").agg(F.min("rid").alias("rep")))
    nodes = sketches.where("marks is not null").join(groups.select(F.col("rep").alias("rid")), "rid", "left_semi")
    key = F.expr(f"xxhash64(band, substring(marks, {4 * ROWS} * band + 1, {4 * ROWS}))").alias("key")
    spread = nodes.select("rid", "marks", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select(key, "band", "rid")
    leads = [F.min(F.struct(F.xxhash64("rid", F.lit(turn)).alias("h"), "rid")) for turn in range(1, LEADS)]
    buckets = spread.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.array(F.min("rid"), *[x["rid"] for x in leads]).alias("leads")).where("rows > 1")
    open_ = freeze(spread.join(buckets, "key").select("key", "band", "rid", "leads"))
    inside = freeze(nodes.select("rid", "same", "n", "marks").join(open_.select("rid").distinct(), "rid", "left_semi"))
    bits, place = _bitmap(inside)
    members = texts.sparkSession.sparkContext.broadcast(bits)
    small = texts.select("same", "text", place.alias("place")).mapInArrow(_shrink(members), "same binary, z binary")
    packed = freeze(small.groupBy("same").agg(F.first("z").alias("z")).join(inside.select("same", "rid"), "same").select("rid", "z"))
    pairs = open_.select(F.col("rid").alias("b"), F.explode(F.array_distinct("leads")).alias("a")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sized = _beside(pairs, inside, ["n", "marks"]).where(f"least(n_a, n_b) * {THRESHOLD[1]}L >= greatest(n_a, n_b) * {THRESHOLD[0]}L")
    likely = freeze(sized.select("a", "b", "marks_a", "marks_b").mapInArrow(_alike, "a long, b long"))
    found = freeze(_beside(likely, packed, ["z"]).select("a", "b", "z_a", "z_b").mapInArrow(_verify, "a long, b long"))
    labels = components(found)
    links = _rest(open_.select("key", "band", "rid"), inside, packed, labels)
    members.destroy()
    drop_frozen(open_, inside, packed, likely, found)
    heads = components(links)
    first = groups.join(labels.select(F.col("rid").alias("rep"), F.col("class").alias("c")), "rep", "left").select("same", F.coalesce("c", "rep").alias("c"))
    out = freeze(first.join(heads.select(F.col("rid").alias("c"), "class"), "c", "left").select("same", F.coalesce("class", "c").alias("class")))
    drop_frozen(groups, labels, links, heads)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frozen tables: rows (rid, id, same, ...), the class of each text (same, class),
    and per class its kept row (class, keep, id, same, rows): the one with the smallest id."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.unhex(F.md5(t.cast("binary"))).alias("same"), F.col(doc_id).alias("id"), t.alias("text"))
    small_batches(docs.sparkSession)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    sketches = freeze(whole.select(F.monotonically_increasing_id().alias("rid"), "same", "id", "text").mapInArrow(_sketch, f"rid long, same binary, id {kind}, n int, marks binary"))
    labels = link(sketches, whole)
    of = sketches.select("rid", "id", "same").join(labels, "same")
    heads = of.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "same", "rid")).alias("m"), F.count(F.lit(1)).alias("rows"))
    return sketches, labels, freeze(heads.select("class", F.col("m.rid").alias("keep"), "m.id", "m.same", "rows"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_rows, kept."""
    rows, labels, heads = near_duplicates(docs.select("doc_id", "text"))
    h = heads.select("class", "keep", F.col("id").alias("class_id"), F.col("rows").alias("class_rows"))
    d = rows.select("rid", "id", "same").join(labels, "same").join(h, "class")
    return d.select(F.col("id").alias("doc_id"), "class_id", "class_rows", (F.col("rid") == F.col("keep")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, with its own columns."""
    names = docs.columns
    t = F.coalesce("text", F.lit(""))
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), t.alias("text"), F.col("doc_id").alias("doc"))
    rows, labels, heads = near_duplicates(slim, "text", "doc")
    drop_frozen(rows, labels)
    # Repeated rows (equal id and text) meet already before they move, so none is hot. The
    # hint keeps the plan alike at every size.
    one = slim.select("row", "doc", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same")).groupBy("same", "doc").agg(F.first("row").alias("row"))
    keep = heads.select(F.col("same").alias("s"), F.col("id").alias("i"))
    kept = one.hint("merge").join(keep, (F.col("same") == F.col("s")) & F.col("doc").eqNullSafe(F.col("i")), "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
