"""Corpora: statistics, term deduplication, training pairs, overlap reports, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.spans import ids_within, running_ids


def statistics(passages: DataFrame, by: list[str], doc: str, text: str = "text") -> DataFrame:
    """Documents, passages, characters and blank-separated tokens."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return passages.groupBy(*by).agg(
        F.countDistinct(doc).alias("n_docs"),
        F.count(F.lit(1)).alias("n_passages"),
        F.sum(F.char_length(text)).cast("long").alias("n_chars"),
        F.sum(words).cast("long").alias("n_tokens"),
    )


def throughput(stats: DataFrame, seconds: float) -> DataFrame:
    """Milliseconds per document, passage and thousand tokens, characters per second."""
    ms = F.lit(seconds * 1000.0)
    per = lambda n, f=1: F.when(F.col(n) > 0, ms * f / F.col(n)).otherwise(0.0)
    return stats.select("*", per("n_docs").alias("ms_per_doc"), per("n_passages").alias("ms_per_passage"), per("n_tokens", 1000).alias("ms_per_1k_tokens"), (F.col("n_chars") / F.lit(seconds)).alias("chars_per_s"))


def dedupe_terms(terms: DataFrame, concept: str, name: str, order: str) -> DataFrame:
    """One spelling per concept and case-folded name: the first; ``pos`` from 0."""
    d = terms.select(F.col(concept).alias("concept"), T.col(T.squeeze(name)).alias("term"), F.col(order).alias("ord")).where("term <> ''")
    # An aggregate, not a window: a frequent name is combined before it is shuffled.
    d = d.groupBy("concept", F.lower("term").alias("folded")).agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord"))
    pos = F.row_number().over(Window.partitionBy("concept").orderBy("ord", "folded")) - 1
    return d.select("concept", "term", "ord", pos.alias("pos"))


def training_pairs(terms: DataFrame) -> DataFrame:
    """(concept, left, right): all unordered pairs of a concept's deduplicated terms.
    All pairs are the result here; a concept has few names."""
    a = terms.select("concept", F.col("term").alias("left_term"), F.col("pos").alias("_a"))
    b = terms.select("concept", F.col("term").alias("right_term"), F.col("pos").alias("_b"))
    return a.join(b, "concept").where("_a < _b").select("concept", "left_term", "right_term")


def pair_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat_ws("||", "concept", "left_term", "right_term").alias("value"))


def drop_ambiguous(names: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(concept, name) without names of several concepts and without concepts of fewer
    than ``least`` names; a concept keeps at most ``most`` names, in order of name."""
    d = names.select("concept", "name").distinct()
    single = d.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("concept").alias("concept")).where("n = 1").select("concept", "name")
    if most is not None:
        single = single.withColumn("_n", F.row_number().over(Window.partitionBy("concept").orderBy("name"))).where(F.col("_n") <= most).drop("_n")
    enough = single.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("concept")
    return single.join(enough, "concept", "left_semi")


def ambiguity_statistics(names: DataFrame, least: int = 2) -> DataFrame:
    """One row: concepts and names before and after, names dropped, concepts dropped."""
    d = names.select("concept", "name").distinct()
    kept = drop_ambiguous(names, least)
    before = d.agg(F.countDistinct("concept").alias("concepts_before"), F.count(F.lit(1)).alias("names_before"))
    after = kept.agg(F.countDistinct("concept").alias("concepts_after"), F.count(F.lit(1)).alias("names_after"))
    lost = d.groupBy("name").count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("ambiguous_names"))
    one = before.crossJoin(after).crossJoin(lost)  # one row each
    return one.withColumn("concepts_dropped", F.col("concepts_before") - F.col("concepts_after"))


def overlap(forms: DataFrame, aliases: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Per corpus: distinct surface forms, how many are ontology names, percent."""
    f = forms.select(F.col(corpus).alias("corpus"), "form").distinct()
    d = f.join(aliases.select(F.col("form")).distinct().withColumn("_hit", F.lit(1)), "form", "left")
    d = d.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_forms"), F.count("_hit").alias("n_matched"))
    return d.withColumn("percent", F.round(100 * F.col("n_matched") / F.col("n_forms"), 2))


def label_schema(types: DataFrame, type_: str) -> DataFrame:
    """(label_id, label): O, then B- and I- of every type in order."""
    d = types.where(F.col(type_).isNotNull()).select(F.col(type_).alias("t")).distinct()
    place = F.row_number().over(Window.orderBy("t"))  # one row per type
    d = d.withColumn("n", place).select(F.explode(F.array(F.struct((2 * F.col("n") - 1).alias("label_id"), F.concat(F.lit("B-"), "t").alias("label")), F.struct((2 * F.col("n")).alias("label_id"), F.concat(F.lit("I-"), "t").alias("label")))).alias("x"))
    first = types.sparkSession.createDataFrame([(0, "O")], "label_id int, label string")
    return first.union(d.select("x.label_id", "x.label"))


def recode(annotations: DataFrame, type_: str, to: dict[str, str], drop: tuple[str, ...]) -> DataFrame:
    """Annotations with types renamed; dropped types and missing ones go."""
    value = F.col(type_)
    for a, b in to.items():
        value = F.when(F.col(type_) == a, b).otherwise(value)
    return annotations.where(~F.col(type_).isin(*drop)).withColumn(type_, value).where(F.col(type_).isNotNull())


#: Modulus and factors of the draws: plain arithmetic, alike everywhere.
PRIME, FACTORS = 2_147_483_647, (48_271, 69_621, 40_692)


def draw(x, *salts) -> Column:
    """A number below PRIME that depends on whole numbers."""
    mixed = F.pmod(F.col(x).cast("long") if isinstance(x, str) else x, F.lit(PRIME))
    for salt in salts:
        mixed = F.pmod(mixed * FACTORS[0] + F.pmod(F.lit(salt) if isinstance(salt, int) else salt, F.lit(PRIME)) * FACTORS[1] + 11, F.lit(PRIME))
    return F.pmod(mixed * FACTORS[2] + 1, F.lit(PRIME))


def supported(rows: DataFrame, label: str, least: int) -> DataFrame:
    """Labels with at least ``least`` rows, and their number."""
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def balanced_sample(rows: DataFrame, label: str, key: str, labels: int, each: int, seed: int = 0) -> DataFrame:
    """``labels`` labels of those with enough rows, drawn by a seeded hash, and ``each`` rows
    of every one of them."""
    draw_ = lambda c, s: F.pmod(F.col(c).cast("long") * 2654435761 + s * 40503, F.lit(1_000_003))
    chosen = supported(rows, label, each).withColumn("_d", draw_(label, seed)).orderBy("_d", label).limit(labels).select(label)
    d = rows.join(F.broadcast(chosen), label)  # `labels` rows
    w = Window.partitionBy(label).orderBy(draw_(key, seed + 1), key)
    return d.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= each)


def label_index(rows: DataFrame, label: str, key: str, least: int = 1, seed: int | None = None) -> DataFrame:
    """(label_id, label, n, pos, key): the rows of labels with at least ``least`` of them. Labels
    are numbered from 0 without gaps in their order, and so are the rows of each: by key, or
    by a seeded draw of the (whole) key. No label's rows meet in one task."""
    names = running_ids(supported(rows, label, least), [label], "label_id").select("label_id", F.col(label).alias("label"), "n")
    order = [F.col("key")] if seed is None else [draw("key", seed), F.col("key")]
    d = rows.select(F.col(label).alias("label"), F.col(key).alias("key")).join(names, "label")
    if seed is not None:
        d = d.withColumn("_draw", order[0])
    return ids_within(d, "label_id", ["key"] if seed is None else ["_draw", "key"], "pos").select("label_id", "label", "n", "pos", "key")


def batch_plan(rows: DataFrame, label: str, key: str, labels: int, each: int, batches: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """(batch, slot, label, key): the batches of one epoch: in each, ``labels`` labels of those
    with at least ``each`` rows, and ``each`` rows of every one, both without repetition, in
    shuffled order. The same epoch and seed give the same plan; epochs differ.

    Labels and, within a label, rows lie in an order drawn for the epoch; a batch takes every
    s-th from a start on, so a draw is a formula and two equal joins: nothing is sorted or
    ranked per batch but its own slots."""
    if labels < 2 or each < 2:
        raise ValueError("a batch needs two labels and two rows of each at least")
    index = label_index(rows, label, key, each, seed + epoch)
    found = supported(rows, label, each).count()
    if found < labels:
        raise ValueError(f"{labels} labels with {each} rows each are needed; {found} were found")

    def taken(n: Column, count: int, start: Column, step: Column) -> Column:
        """``count`` different numbers below ``n``."""
        stride = 1 + F.pmod(step, F.floor((n - 1) / (count - 1)).cast("long"))
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.pmod(start + k.cast("long") * stride, n))

    salt = seed + epoch
    b = rows.sparkSession.range(batches).select(F.col("id").alias("batch"))
    b = b.select("batch", F.explode(taken(F.lit(found).cast("long"), labels, draw("batch", salt, 1), draw("batch", salt, 2))).alias("place"))
    order = running_ids(index.groupBy("label_id").agg(F.first("n").alias("n")).withColumn("_draw", draw("label_id", salt)), ["_draw", "label_id"], "place").select("place", "label_id", "n")
    picks = b.join(order, "place")
    both = F.col("batch") * 1_000_003 + F.col("label_id")
    picks = picks.select("batch", "label_id", F.explode(taken(F.col("n"), each, draw(both, salt, 3), draw(both, salt, 4))).alias("pos"))
    d = picks.join(index.select("label_id", "pos", "label", "key"), ["label_id", "pos"])
    slot = F.row_number().over(Window.partitionBy("batch").orderBy(draw("key", salt, F.col("batch"), 5), "key")) - 1  # one batch
    return d.select("batch", slot.cast("long").alias("slot"), "label", "key")


def contrastive_loss(batch: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id", temperature: float = 0.05) -> DataFrame:
    """One row: the supervised contrastive loss of one training batch (a bounded set)."""
    norm = f"sqrt(aggregate({vector}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"
    b = batch.select(F.col(key).alias("i"), F.col(label).alias("y"), F.expr(f"transform({vector}, x -> cast(x as double) / {norm})").alias("v"))
    other = F.broadcast(b.select(F.col("i").alias("j"), F.col("y").alias("z"), F.col("v").alias("u")))
    dot = F.expr(f"aggregate(zip_with(v, u, (p, q) -> p * q), 0D, (s, x) -> s + x) / {temperature}")
    d = b.join(other, F.col("i") != F.col("j")).withColumn("s", dot)
    top = d.groupBy("i").agg(F.max("s").alias("m"))
    d = d.join(top, "i").groupBy("i").agg(F.log(F.sum(F.exp(F.col("s") - F.col("m")))).alias("lse"), F.first("m").alias("m"), F.sum(F.when(F.col("y") == F.col("z"), F.col("s"))).alias("pos"), F.sum((F.col("y") == F.col("z")).cast("int")).alias("n"))
    each = -(F.col("pos") / F.col("n") - F.col("m") - F.col("lse"))
    return d.where("n > 0").agg(F.avg(each).alias("loss"), F.count(F.lit(1)).alias("anchors"))
