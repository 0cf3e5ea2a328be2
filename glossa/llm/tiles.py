"""Near-duplicates among vectors: all pairs by int8 tile products with rigorous bounds.

Each vector is scaled to unit length and rounded to int8 by a scale of its own; the length e
of what the rounding took away bounds the error of any product with it: for unit vectors
u, v with quantised forms p, q, |u.v - p.q| <= e_u + |p| e_v. Vectors are dealt into tiles,
and every pair of tiles is a cell. A first pass multiplies codes only and flags the members
of pairs that can reach the threshold; a second one brings the flagged members' full vectors
into the cell and computes just those pairs in double precision.

Nothing emits pairs: a cell gives its number of links per member and a forest that spans
them, and components of all forests' edges are the groups. Equal vectors are one member with
a count, so copies are neither compared nor listed. The number of cells grows with the square
of the number of different vectors over ``TILE``, as an exact join without any assumption on
the vectors must; only codes are copied for it, a byte per number.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers link
with nothing, nor do vectors of different length; -0.0 counts as 0.0; repeated ids are
vectors of their own; a null id is never the smallest unless all ids of a component are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.bagminhash import components
from glossa.llm.batches import small_batches
from glossa.llm.common import drop_frozen, freeze, spread_join

#: Vectors of a tile at most (about), codes of a tile, numbers of one exact float32 product.
TILE, CODES, EXACT = 4096, 1 << 20, 1024
#: What float32 and double rounding can add to a bound.
SLACK = 1e-5


def _valid(vector: str) -> Column:
    """Neither null, empty nor zero, and all numbers finite."""
    v = f"`{vector}`"
    return F.expr(f"coalesce(size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity')) and exists({v}, x -> x <> 0), false)")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error lengths of rows of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # else squares of large numbers overflow
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair of two blocks (code, scale, error) can reach the
    threshold. Sums of at most EXACT products of codes are whole in float32."""
    total = 0
    for k in range(0, a[0].shape[1], EXACT):
        total = total + a[0][:, k : k + EXACT].astype(np.float32) @ b[0][:, k : k + EXACT].astype(np.float32).T
    # p.q + e_a + |p| e_b, with |p| of at most 1 + e_a, against the threshold; per row by the largest error of b first.
    edge = (threshold - SLACK - a[2] - (1 + a[2]) * b[2].max(initial=0)) / a[1]
    total *= b[1].astype(np.float32)[None, :]
    out = total >= (edge - np.abs(edge) * SLACK).astype(np.float32)[:, None]
    i, j = np.nonzero(out)
    bound = total[i, j].astype(float) * a[1][i] + a[2][i] + (1 + a[2][i]) * b[2][j]
    out[i, j] = bound >= threshold - SLACK
    return out


def _codes(batches):
    """(c, v) to (c, code, scale, error)."""
    for batch in batches:
        size = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
        end = np.cumsum(size)
        code, scale, error = [None] * len(size), np.zeros(len(size)), np.zeros(len(size))
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            q, s, e = quantise(unit(flat[(end[at] - width)[:, None] + np.arange(width)]))
            scale[at], error[at] = s, e
            for i, row in zip(at.tolist(), q, strict=True):
                code[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.binary()), pa.array(scale), pa.array(error)], ["c", "code", "scale", "error"])


def _block(column: pa.Array, r: int, width: int):
    """(c, (code, scale, error)) of a tile."""
    items = column[r].values
    c, code, scale, error = (items.field(k) for k in range(4))
    raw = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(-1, width)
    return c.to_numpy(), (raw, scale.to_numpy(), error.to_numpy())


def _flag(threshold: float):
    """Cells (width, i, j, x, y) to (width, i, j, c): members of pairs that can reach the
    threshold; y is null where the cell is one tile."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                width, i, j = (batch.column(k)[r].as_py() for k in range(3))
                name, x = _block(batch.column(3), r, width)
                other, y = _block(batch.column(4), r, width) if i != j else (name, x)
                hit = possible(x, y, threshold)
                if i == j:
                    np.fill_diagonal(hit, False)
                    found = name[hit.any(axis=1)]
                else:
                    found = np.concatenate([name[hit.any(axis=1)], other[hit.any(axis=0)]])
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)) for k in (width, i, j)] + [pa.array(found)], ["width", "i", "j", "c"])

    return run


def _links(threshold: float):
    """Flagged members (c, tile, copies, v) of a cell (i, j, m) to (a, b, n): b is null where n
    rows link with member a; else a and b link, and such rows span all links of the cell."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, items = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].values
                name, tile, copies = (items.field(k).to_numpy() for k in range(3))
                v = items.field(3)
                x = unit(v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(name), -1))
                form = quantise(x)
                left = np.flatnonzero(tile == i)
                right = np.flatnonzero(tile == j)
                group, n, edges = np.arange(len(name)), np.zeros(len(name), np.int64), []
                for first in range(0, len(left), 512):
                    some = left[first : first + 512]
                    open_ = possible(tuple(f[some] for f in form), tuple(f[right] for f in form), threshold)
                    for a, row in zip(some.tolist(), open_, strict=True):
                        b = right[row & (right > a if i == j else True)]
                        b = b[x[b] @ x[a] >= threshold]
                        if not len(b):
                            continue
                        n[a] += copies[b].sum()
                        n[b] += copies[a]
                        roots, at = np.unique(group[b], return_index=True)
                        for root, k in zip(roots.tolist(), at.tolist(), strict=True):
                            if root != group[a]:
                                edges.append((name[a], name[b[k]]))
                                group[group == root] = group[a]
                some = np.flatnonzero(n)
                a = np.concatenate([name[some], np.array([e[0] for e in edges], np.int64)])
                b = pa.array([None] * len(some) + [int(e[1]) for e in edges], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.concatenate([n[some], np.zeros(len(edges), np.int64)]))], ["a", "b", "n"])

    return run


def near_vectors(d: DataFrame, threshold: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links (other vectors at a cosine of ``threshold`` or more), component_id (the
    smallest id that links lead to) and kept, of every row of ``d``."""
    small_batches(d.sparkSession)
    rows = d.select(F.col(vec_id).alias("vec_id"), F.when(_valid(vector), F.expr(f"transform(`{vector}`, x -> if(x = 0, cast(0 as tinyint), x))")).alias("v"))
    name = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "v")), 16, "0") for k in (1, 2)])  # 128 bits
    rows = rows.withColumn("same", F.when(F.col("v").isNotNull(), name))
    one = rows.where("v is not null").groupBy("same").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.min("v").alias("v"))
    members = freeze(one.select(F.monotonically_increasing_id().alias("c"), "same", "copies", "least", "v", F.size("v").alias("width")))
    blocks = members.groupBy("width").agg(F.count(F.lit(1)).alias("n")).select(F.col("width").alias("w"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(CODES) / F.col("width")))))).cast("int").alias("tiles"))
    dealt = members.join(blocks, F.col("width") == F.col("w")).withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    dealt = freeze(dealt.select("c", "copies", "v", "width", "tile", "tiles"))
    coded = dealt.select("c", "v").mapInArrow(_codes, "c long, code binary, scale double, error double")
    tiles = freeze(coded.join(dealt.select("c", "width", "tile", "tiles"), "c").groupBy("width", "tile", "tiles").agg(F.collect_list(F.struct("c", "code", "scale", "error")).alias("m")))  # TILE vectors or so
    left = tiles.select("width", F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"), F.col("m").alias("x"))
    right = tiles.where("tile > 0").select("width", F.explode(F.expr("sequence(0, tile - 1)")).alias("i"), F.col("tile").alias("j"), F.col("m").alias("y"))
    cells = left.join(right, ["width", "i", "j"], "left").select("width", "i", "j", "x", "y")
    flagged = cells.mapInArrow(_flag(threshold), "width int, i int, j int, c long")
    full = flagged.join(dealt.select("c", "tile", "copies", "v"), "c").groupBy("width", "i", "j").agg(F.collect_list(F.struct("c", "tile", "copies", "v")).alias("m"))  # two tiles at most
    links = freeze(full.select("i", "j", "m").mapInArrow(_links(threshold), "a long, b long, n long"))
    heads = components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    known = members.select("c", "same", "copies", "least").join(counts, "c", "left").join(heads.select(F.col("rid").alias("c"), F.col("class").alias("head")), "c", "left")
    known = freeze(known.select("same", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "c").alias("head")))
    least = known.groupBy("head").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    of = freeze(spread_join(known, least, "head", "members", known.count()).select("same", "copies", "n_links", "component"))
    drop_frozen(members, dealt, tiles, links, heads, known)
    total = of.agg(F.sum("copies")).head()[0] or 0
    out = spread_join(rows.select("vec_id", "same"), of, "same", "copies", total, "left")  # a vector on very many rows is broadcast
    whole = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.col("vec_id").eqNullSafe(whole).alias("kept"))
