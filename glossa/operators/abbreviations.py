"""Abbreviations: lookup tables, key matching, document definitions, resolution."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.udfs import sequence_ratio
from glossa.functions.vector import nearest


def lookup(rows: DataFrame) -> DataFrame:
    """Rows (short_form, identifier, line) to one row per key: its ids and their number,
    and the longest short form (the first on ties) with its id."""
    d = rows.withColumn("key", T.col(T.abbreviation_key("short_form"))).where("key <> '' and identifier is not null")
    # Repeated rows become one by numbers alone, before texts are compared.
    d = d.groupBy("key", "short_form", "identifier").agg(F.max(-F.col("line")).alias("first"), F.count(F.lit(1)).alias("n"))
    return d.groupBy("key").agg(
        F.countDistinct("identifier").alias("n_ids"),
        F.max_by(F.struct("short_form", "identifier"), F.struct(F.char_length("short_form"), "first")).alias("best"),
        F.sum("n").alias("n_rows"),
    ).select("key", "n_ids", "n_rows", F.col("best.short_form").alias("short_form"), F.col("best.identifier").alias("identifier"))


def match_exact(mentions: DataFrame, keys: DataFrame, mention: str = "mention") -> DataFrame:
    """Mentions that look like short forms, with the lookup row of their own key."""
    d = mentions.where(T.col(T.abbreviation_like(mention))).withColumn("key", T.col(T.abbreviation_key(mention)))
    return d.join(keys, "key")


def match_nearest(mentions: DataFrame, keys: DataFrame, encoder) -> DataFrame:
    """Mentions (mention, ...) whose key is longer than four characters, with the lookup row
    of the most similar key by the encoder's vectors, if the similarity reaches the
    mention's threshold: matched_key, score and the row's columns. Each distinct key is
    encoded once. Short keys must match exactly and never get here."""
    d = mentions.withColumn("_key", T.col(T.abbreviation_key("mention"))).where(T.col(T.threshold("mention")) < 1.0)
    q = d.select(F.col("_key").alias("query")).distinct()
    return pass_nearest(d, keys, nearest(q.select("query", encoder("query").alias("embedding")), keys.select(F.col("key").alias("term"), encoder("key").alias("embedding")), 1, "query", "term"))


def pass_nearest(mentions: DataFrame, keys: DataFrame, near: DataFrame) -> DataFrame:
    """Of mentions (mention, _key, ...) and the nearest keys of their keys (query_id,
    term_id, distance), the rows that reach the mention's threshold."""
    near = near.select(F.col("query_id").alias("_key"), F.col("term_id").alias("matched_key"), F.round(1 - F.col("distance"), 9).alias("score"))
    d = mentions.join(near, "_key").where(F.col("score") >= T.col(T.threshold("mention")))
    return d.join(keys.withColumnRenamed("key", "matched_key"), "matched_key").drop("_key")


def last_forms(defined: DataFrame) -> DataFrame:
    """(doc_key, key, long_form, ord) to one row per document and key: the last long form, and
    the place of the first one."""
    d = defined.groupBy("doc_key", "key", "long_form").agg(F.min("ord").alias("first"), F.max("ord").alias("ord"))
    return d.groupBy("doc_key", "key").agg(F.max(F.struct("ord", "long_form"))["long_form"].alias("long_form"), F.min("first").alias("first"))


def cascade(wanted: DataFrame, defined: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(doc_key, key) of ``wanted`` with the document's long form: by the key itself, by
    the key with or without its final s, or by the most similar key of the document that
    reaches the threshold, the first one in the document on ties. defined: (doc_key, key,
    long_form, ord), the last long form of a key counts, or the ``last_forms`` of such rows."""
    last = defined if "first" in defined.columns else last_forms(defined)
    w = wanted.select("doc_key", F.col("key").alias("wanted")).distinct()
    other = F.filter(T.col(T.variant_keys("wanted")), lambda k: k != F.col("wanted"))
    exact = w.select("doc_key", "wanted", F.lit(1).alias("prio"), F.lit("exact_key").alias("method"), F.col("wanted").alias("key"))
    variant = w.select("doc_key", "wanted", F.lit(2), F.lit("exact_variant"), F.explode(other))
    hits = exact.union(variant).join(last, ["doc_key", "key"]).withColumn("score", F.lit(1.0))
    if fuzzy:
        pairs = fuzzy_pairs(w, last).withColumn("score", sequence_ratio("wanted", "key"))
        pairs = pairs.select("doc_key", "wanted", F.lit(3).alias("prio"), F.lit("fuzzy").alias("method"), "key", "long_form", "first", "score")
        hits = hits.unionByName(pairs.where(F.col("score") >= T.col(T.threshold("wanted"))))
    best = hits.groupBy("doc_key", "wanted").agg(F.min(F.struct("prio", -F.col("score"), "first", "key", "method", "long_form", "score")).alias("best"))
    return best.select("doc_key", F.col("wanted").alias("key"), F.col("best.method").alias("method"), F.col("best.key").alias("matched_key"), F.col("best.long_form").alias("long_form"), F.col("best.score").alias("score"))


def fuzzy_pairs(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs of wanted keys (doc_key, wanted) and keys (doc_key, key, ...) of one document whose
    ratio can reach the threshold: keys of four characters or less never pass, and twice
    the common characters over all characters bounds the ratio from above."""
    pairs = wanted.where(T.col(T.threshold("wanted")) < 1.0).join(keys, "doc_key")
    limit = T.col(T.threshold("wanted"))
    # The lengths alone decide most pairs, and cost nothing.
    return pairs.where(T.col(T.length_bound("wanted", "key")) >= limit).where(T.col(T.ratio_bound("wanted", "key")) >= limit)


def resolve(mentions: DataFrame, keys: DataFrame, defined: DataFrame, fuzzy: bool = True, encoder=None) -> DataFrame:
    """Mentions (doc_key, mention) with ``kind``: direct (the key has one id),
    ambiguous_long_form (the document defines it), ambiguous_unresolved, or none. A key is
    found exactly or, with an ``encoder`` and for longer keys, as the nearest one;
    ``key_method`` and ``key_score`` tell which."""
    d = mentions.withColumn("key", F.when(T.col(T.abbreviation_like("mention")), T.col(T.abbreviation_key("mention"))))
    d = d.join(keys, "key", "left").withColumn("key_method", F.when(F.col("n_ids").isNotNull(), "exact_short_abbreviation")).withColumn("key_score", F.when(F.col("n_ids").isNotNull(), 1.0))
    if encoder is not None:
        open_ = mentions.where(T.col(T.abbreviation_like("mention"))).select("mention").distinct()
        names = [c for c in keys.columns if c != "key"]
        near = match_nearest(open_, keys, encoder).select(F.col("mention").alias("_m"), F.col("matched_key").alias("_key"), F.col("score").alias("_score"), *[F.col(c).alias(f"_{c}") for c in names])
        d = d.join(near, F.col("mention") == F.col("_m"), "left")
        by = F.col("n_ids").isNull() & F.col("_key").isNotNull()
        d = d.withColumns({"key_method": F.when(by, "encoder_abbreviation_match").otherwise(F.col("key_method")), "key_score": F.when(by, F.col("_score")).otherwise(F.col("key_score")), "key": F.when(by, F.col("_key")).otherwise(F.col("key")), **{c: F.when(by, F.col(f"_{c}")).otherwise(F.col(c)) for c in names}})
        d = d.drop("_m", "_key", "_score", *[f"_{c}" for c in names])
    long = cascade(d.where("n_ids > 1").select("doc_key", "key"), defined, fuzzy).select("doc_key", "key", "long_form", "method", F.col("matched_key").alias("definition_key"), "score")
    d = d.join(long, ["doc_key", "key"], "left")
    kind = F.when(F.col("n_ids").isNull(), "none").when(F.col("n_ids") == 1, "direct").when(F.col("long_form").isNotNull(), "ambiguous_long_form").otherwise("ambiguous_unresolved")
    return d.withColumn("kind", kind).withColumn("identifier", F.when(kind == "direct", F.col("identifier")))


_PAIR = re.compile(r"\(([^()]{2,})\)")


def definitions(text: str) -> list[tuple[str, str]]:
    """(short form, long form) pairs by the published algorithm of Schwartz and Hearst
    (2003): the characters of a bracketed short form are sought from the right in the
    words before it; the first one must begin a word."""
    found = []
    for m in _PAIR.finditer(text or ""):
        short = re.split(r"[;,]", m[1])[0].strip()
        if not (2 <= len(short) <= 10 and len(short.split()) <= 2 and short[0].isalnum() and any(c.isalpha() for c in short)):
            continue
        left = re.split(r"[.;:()\[\]](?=\s|$)", text[: m.start()])[-1]
        words = left.split()
        window = " ".join(words[-min(len(short) + 5, 2 * len(short)) :])
        at, k = len(window) - 1, len(short) - 1
        while k >= 0:
            c = short[k].lower()
            if not c.isalnum():
                k -= 1
                continue
            while at >= 0 and (window[at].lower() != c or (k == 0 and at > 0 and window[at - 1].isalnum())):
                at -= 1
            if at < 0:
                break
            at, k = at - 1, k - 1
        if k >= 0:
            continue
        long = window[at + 1 :]
        if len(long) > len(short) and short.lower() not in long.lower().split():
            found.append((short, long))
    return found


def document_definitions(docs: DataFrame, doc_key: str = "doc_key", text: str = "text") -> DataFrame:
    """(doc_key, key, long_form, ord) of all definitions in each document's text."""

    @F.pandas_udf("array<struct<short: string, long: string>>")
    def find(x: pd.Series) -> pd.Series:
        return x.map(lambda s: [{"short": a, "long": b} for a, b in definitions(s)])

    some = docs.where(F.contains(F.col(text), F.lit("(")))  # only texts that can have one
    d = some.select(F.col(doc_key).alias("doc_key"), F.posexplode(find(text)).alias("ord", "_p"))
    return d.select("doc_key", T.col(T.abbreviation_key("_p.short")).alias("key"), F.col("_p.long").alias("long_form"), "ord").where("key <> ''")


def document_texts(passages: DataFrame) -> DataFrame:
    """(doc_key, text): a document's passages in order, joined by line ends."""
    both = F.array_sort(F.collect_list(F.struct("passage_idx", "text")))
    return passages.groupBy("doc_key").agg(F.array_join(F.transform(both, lambda p: p["text"]), "\n").alias("text"))

