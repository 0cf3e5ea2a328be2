"""Mixing sources to target weights by Pfair scheduling.

Weights are taken as exact fractions w of their sum, over all blocks: block k of a source is
released at floor(k / w) and due at ceil((k + 1) / w); earliest deadline first fills the
slots, and on one processor with full utilisation it meets every deadline, so no source is
ever a block or more away from its share, however long the table. The schedule ends with
the last block of the last source but one; what the last source has left follows at its
deadlines, by formula.

The schedule is made in ranges of ``RANGE`` slots, each a row of its own, so nothing of it
passes the driver or one task. What earliest deadline first has done before slot T is known
without the slots before: all blocks due by T, and of the blocks under way at T (released
before it and due after it, one a source at most) the greedy choice by deadline among those
that still fit, as blocks released from s on have only T - s slots. That looks back to the
earliest release of a block under way, one block's length of the smallest source.

Rows are numbered within their source, and slots within the whole, over buckets whose
sizes are bounded, so a source with a third of all rows is spread like any other.

Defined cases: a null source is a source of its own; every row is kept; when a source
ends, its slots are passed over and the others keep their order; an empty table gives an
empty result; repeated rows each have a place; equal deadlines go by the source's name, and
rows of a block by a hash of their ids; texts are not read, so their length is free; of the
columns only id and source are read, so any further names may stand there. Weights whose
common denominator passes 22 digits are rounded to 22.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import drop_frozen, freeze, positions

#: Slots of one row of the schedule.
RANGE = 256
#: Rows of a bucket of the numbering, on average; fewer in small tables.
BUCKET_ROWS = 100_000
DIGITS = 22
_JOB = "struct<due: bigint, i: int, k: bigint>"


def shares(weights: dict) -> dict:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    largest = Fraction(10**DIGITS - 1 - len(exact)) / sum(exact.values(), Fraction(0))
    return {s: max(1, int(w * min(scale, largest))) for s, w in exact.items()}


def _released(k: str, w: str) -> str:
    return f"((cast({k} as decimal(13,0)) * total) div {w})"


def _due(k: str, w: str) -> str:
    return f"((cast({k} + 1 as decimal(13,0)) * total + {w} - 1) div {w})"


def _begun(slot: str, w: str) -> str:
    """Blocks released before the slot: the number of the first that is not."""
    return f"((cast({slot} as decimal(14,0)) * {w} + total - 1) div total)"


def _blocks(first: str, end: str, job: str) -> str:
    """An array of ``job``, by k, for the blocks of each source x from ``first`` before ``end``."""
    return f"flatten(transform(own, x -> if({first} < {end}, transform(sequence({first}, {end} - 1), k -> {job}), array())))"


def slots(spark: SparkSession, share: list, ranges: int) -> DataFrame:
    """(i, k, slot): which block k of source i (its place in ``share``, whole numbers) has each
    of the slots of that many ranges."""
    d = spark.range(ranges).select(
        (F.col("id") * RANGE).alias("t"),
        F.expr(f"cast('{sum(share)}' as decimal({DIGITS},0))").alias("total"),
        F.split(F.lit(",".join(map(str, share))), ",").cast(f"array<decimal({DIGITS},0)>").alias("w"),
    )
    d = d.withColumn("own", F.expr("transform(w, (w, i) -> named_struct('i', i, 'w', w, 'k', (cast(t as decimal(14,0)) * w) div total, 'next', " + _begun("t", "w") + "))"))
    job = lambda k: f"named_struct('due', {_due(k, 'x.w')}, 'i', x.i, 'k', {k})"
    # Under way: begun before t, not due by t.
    d = d.withColumn("under", F.expr(f"transform(filter(own, x -> x.k < x.next), x -> named_struct('at', {_released('x.k', 'x.w')}, 'job', {job('x.k')}))"))
    d = d.withColumn("back", F.expr("array_min(transform(under, u -> u.at))"))
    due = _blocks(_begun("back", "x.w"), "x.k", f"named_struct('at', {_released('k', 'x.w')}, 'job', cast(null as {_JOB}))")
    d = d.withColumn("entries", F.expr(f"sort_array(concat(under, {due}), false)"))
    others = "(a.others + if(e.job is null, 1, 0))"
    pool = f"slice(sort_array(if(e.job is null, a.pool, concat(a.pool, array(e.job)))), 1, cast(greatest(t - e.at - {others}, 0) as int))"
    left = "cast(t - aggregate(own, 0L, (a, x) -> a + x.k) as int)"
    d = d.withColumn("done", F.expr(f"aggregate(entries, named_struct('pool', cast(array() as array<{_JOB}>), 'others', 0L), (a, e) -> named_struct('pool', {pool}, 'others', {others}), a -> slice(a.pool, 1, {left}))"))
    d = d.withColumn("ready", F.expr("array_except(transform(under, u -> u.job), done)"))
    d = d.withColumn("come", F.expr(_blocks("x.next", _begun(f"t + {RANGE}", "x.w"), f"named_struct('at', {_released('k', 'x.w')}, 'job', {job('k')})")))
    at = lambda slot: f"transform(filter(come, c -> c.at = {slot}), c -> c.job)"
    step = f"named_struct('ready', sort_array(concat(slice(a.ready, 2, size(a.ready)), {at('t + s + 1')})), 'out', concat(a.out, slice(a.ready, 1, 1)))"
    first = f"named_struct('ready', sort_array(concat(ready, {at('t')})), 'out', cast(array() as array<{_JOB}>))"
    d = d.withColumn("out", F.expr(f"aggregate(sequence(0, {RANGE - 1}), {first}, (a, s) -> {step}, a -> a.out)"))
    # Never empty; the outer form spares the filter for empty arrays, which would compute all arrays twice.
    return d.select("t", F.posexplode_outer("out").alias("p", "job")).select("job.i", "job.k", (F.col("t") + F.col("p")).alias("slot"))


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> dict:
    """Target weights: each source's share of rows to a power (one row per source)."""
    return {r[0]: r[1] ** power for r in docs.groupBy(source).count().collect()}


def mix(docs: DataFrame, weights: dict, source: str = "source", doc_id: str = "doc_id", block_rows: int = 32, period: int | None = None, buckets: int = 4096) -> DataFrame:
    """doc_id, source, block, slot and position (gapless from 0: the mixed order). Weights
    are exact whatever the ``period``, which has no effect and is still accepted; ``buckets``
    is the least number of buckets of the numbering."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    if not weights:
        return d.select("doc_id", "source", *[F.lit(None).cast("long").alias(c) for c in ("block", "slot", "position")])
    needed = -(-d.count() // BUCKET_ROWS)
    d = d.withColumn("source", F.col("source").cast("string")).withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(max(buckets // 16, needed))))
    d = positions(d, ["source"], "_b", [F.xxhash64("doc_id", F.lit(1)), "doc_id"], "_n").drop("_b")
    d = d.withColumn("block", F.expr(f"_n div {block_rows}"))
    d = freeze(d)
    rows = {r[0]: r[1] for r in d.groupBy("source").count().collect()}  # one row per source
    missing = [s for s in rows if s not in weights]
    if missing:
        raise ValueError(f"no weight for sources {missing[:5]}")
    weights = {s: weights[s] for s in sorted(weights, key=lambda s: (s is not None, s or ""))}  # ties go by name
    share = list(shares(weights).values())
    total, blocks = sum(share), [-(-rows.get(s, 0) // block_rows) for s in weights]
    ends = sorted(-(-n * total // w) for n, w in zip(blocks, share, strict=True))
    ranges = -(-ends[-2] // RANGE) if len(ends) > 1 else 0
    names = spark.createDataFrame([(i, s, str(w), n) for i, (s, w, n) in enumerate(zip(weights, share, blocks, strict=True))], "_i int, _source string, _w string, _blocks long")
    numbered = d
    placed = d.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source")))  # one row per source
    plan = slots(spark, share, ranges).join(F.broadcast(names.select(F.col("_i").alias("i"), "_blocks")), "i").where("k < _blocks")
    plan = freeze(plan.select("i", "k", "slot"))  # so its size is known
    placed = placed.join(plan, (F.col("_i") == F.col("i")) & (F.col("block") == F.col("k")), "left")
    last = F.expr(_due("block", "w").replace("total", "_total")) - 1
    placed = placed.withColumn("w", F.col("_w").cast(f"decimal({DIGITS},0)")).withColumn("_total", F.lit(str(total)).cast(f"decimal({DIGITS},0)"))
    placed = placed.select("doc_id", "source", "block", F.coalesce("slot", last).alias("slot"), "_n")
    d = freeze(placed)  # thin rows: both numberings below read the same placing
    drop_frozen(numbered, plan)
    top = d.agg(F.max("slot")).head()[0] or 0
    # Buckets of consecutive slots. Where sources have ended, few blocks share a bucket.
    d = d.withColumn("_b", F.expr(f"slot div {max(1, -(-(top + 1) // max(buckets, needed)))}"))
    return positions(d, [], "_b", ["slot", "_n"], "position").select("doc_id", "source", "block", "slot", "position")
