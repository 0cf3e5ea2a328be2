"""Sharding by balanced label propagation.

Links are a bipartite table (node, hub): nodes of one hub are linked, a hub of two is an
edge, and a large group needs no pairs. Each round every hub counts its nodes' labels,
each node adds up its hubs' counts and wishes to move to the best label; wishes are
granted while the target is below its capacity, whole hubs together unless the hub alone
is a large part of a shard. Unlinked nodes then fill what is free, and one gapless
numbering by label cuts the shards, so row counts are at most one apart (the law
``rows``). Within a label linked nodes stand in the middle, so cuts fall on unlinked ones.

What reaches the driver is one count per pair of labels.

Defined cases: a null text counts as empty for its group and has size 1; repeated rows
are separate nodes of one group; an empty table gives an empty result; a group larger
than a shard is split: what its shard cannot hold stays spread; ties among labels go by a
hash of the leading hub; very long texts count by their bytes and do not move; further
columns are not read, so any names may stand there. Texts are equal by a 128-bit digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import freeze, positions, spread_join


def _unit(*cols) -> Column:
    """A number in [0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / (1 << 30)).cast("double")


def propagate(links: DataFrame, n_shards: int, capacity: int, rounds: int = 6) -> DataFrame:
    """(node, hub) to (node, label, hub): hub is one of the node's, for placing it.
    At most about ``capacity`` nodes get a label."""
    state = freeze(links.select("node").distinct().withColumn("label", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(n_shards)).cast("int")))
    total = state.count()
    if not total:
        return links.groupBy("node").agg(F.min("hub").alias("hub")).withColumn("label", F.lit(0))
    slots = [f"sum(if(label = {s}, 1, 0))" for s in range(n_shards)]
    for r in range(rounds):
        votes = links.join(state.select("node", "label"), "node").groupBy("hub").agg(F.array(*[F.expr(x) for x in slots]).alias("votes"), F.count(F.lit(1)).alias("hub_rows"))
        seen = spread_join(links, freeze(votes), "hub", "hub_rows", total)
        best = seen.groupBy("node").agg(F.array(*[F.sum(F.col("votes")[s]) for s in range(n_shards)]).alias("votes"), F.max_by("hub", F.struct("hub_rows", "hub")).alias("lead"), F.max("hub_rows").alias("lead_rows"))
        # Ties go by a hash of the leading hub, so all nodes of a hub agree.
        best = best.withColumn("votes", F.expr("transform(votes, (v, s) -> v * 1024 + pmod(xxhash64(lead, s), 1024))"))
        wish = best.join(state.select("node", "label"), "node").withColumn("to", F.expr("cast(array_position(votes, array_max(votes)) - 1 as int)"))
        wish = freeze(wish.withColumn("to", F.when(F.expr("votes[to] > votes[label]"), F.col("to")).otherwise(F.col("label"))).drop("votes"))
        flow = {(a, b): n for a, b, n in wish.groupBy("label", "to").count().collect()}  # one row per pair of labels
        load = [sum(n for (a, _), n in flow.items() if a == s) for s in range(n_shards)]
        leave = [sum(n for (a, b), n in flow.items() if a == s != b) for s in range(n_shards)]
        come = [sum(n for (a, b), n in flow.items() if b == s != a) for s in range(n_shards)]
        # Leavers free room only as far as they are granted; half is counted on.
        grant = [min(1.0, max(0.0, capacity - load[s] + leave[s] / 2) / come[s]) if come[s] else 1.0 for s in range(n_shards)]
        draw = F.when(F.col("lead_rows") * 4 > capacity, _unit("node", F.lit(r))).otherwise(_unit("lead", F.lit(r)))
        granted = F.array(*[F.lit(g) for g in grant])[F.col("to")]
        state = freeze(wish.select("node", F.when(draw < granted, F.col("to")).otherwise(F.col("label")).alias("label"), F.col("lead").alias("hub")))
        if not sum(come):
            break
    return state


def cut_links(placed: DataFrame, links: DataFrame, shard: str = "shard") -> DataFrame:
    """One row: rows that stand outside the shard where most of their hub stands."""
    per = links.join(placed.select("node", shard), "node").groupBy("hub", shard).count()
    return per.groupBy("hub").agg((F.sum("count") - F.max("count")).alias("outside")).agg(F.sum("outside").alias("cut"))


def place(nodes: DataFrame, links: DataFrame, n_shards: int, rounds: int = 6, spread: int = 256) -> DataFrame:
    """``nodes`` (node long, and more) with shard and slot; counts are at most one apart."""
    total = nodes.count()
    state = propagate(links, n_shards, -(-total // n_shards), rounds)
    # At last the nodes of a leading hub go where most of them are: they stand side by side in
    # the numbering, and only what lies across one of its cuts is split.
    count = state.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    most = count.groupBy("hub").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.sum("n").alias("hub_rows"))
    labels = freeze(spread_join(state.select("node", "hub"), most, "hub", "hub_rows", max(total, 1)).select("node", "label", "hub"))
    load = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}  # one row per label
    room = [max(0, total / n_shards - load.get(s, 0)) for s in range(n_shards)]
    edges, at = [], 0.0
    for x in room:
        at += x / (sum(room) or 1)
        edges.append(at)
    d = nodes.join(labels.withColumnRenamed("hub", "_hub"), "node", "left")
    u = _unit("node", F.lit(11))
    free = F.coalesce(*[F.when(u < e, F.lit(s)) for s, e in enumerate(edges[:-1])], F.lit(n_shards - 1))
    d = d.withColumn("_zone", F.when(F.col("label").isNotNull(), 1).otherwise(2 * F.pmod(F.xxhash64("node", F.lit(13)), F.lit(2)).cast("int")))
    d = d.withColumn("label", F.coalesce("label", free))
    # A hub of a thousandth of all rows or more has buckets of its own, by its nodes' hashes.
    wide = F.row_number().over(Window.orderBy("_hub"))  # at most 1000 rows
    hubs = labels.groupBy("hub").count().where(F.col("count") * 1000 >= total).select(F.col("hub").alias("_hub")).withColumn("_wide", wide)
    d = d.join(F.broadcast(hubs), "_hub", "left")
    by_node, by_hub = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(spread)), F.pmod(F.xxhash64("_hub", F.lit(17)), F.lit(spread))
    fine = F.when(F.col("_wide").isNotNull() | F.col("_hub").isNull(), by_node).otherwise(by_hub)
    d = d.withColumn("_bucket", (((F.col("label") * 3 + F.col("_zone")) * 1001 + F.coalesce("_wide", F.lit(0))) * spread + fine).cast("int"))
    d = positions(d, [], "_bucket", ["_hub", "node"], "_pos")
    d = d.withColumn("shard", F.expr(f"cast(_pos * {n_shards} div {max(total, 1)} as int)"))
    return d.withColumn("slot", F.col("_pos") - F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")).drop("_hub", "_zone", "_wide", "_bucket", "_pos", "label")


def shard_equal_texts(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: equal texts are linked."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.md5(t.cast("binary"))).alias("_h"))
    base = freeze(base.withColumn("node", F.monotonically_increasing_id()))
    groups = base.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    links = freeze(spread_join(base.select("node", "_h"), groups, "_h", "_n", max(base.count(), 1)).select("node", F.col("_h").alias("hub")))
    placed = place(base.drop("_h"), links, n_shards, rounds)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
