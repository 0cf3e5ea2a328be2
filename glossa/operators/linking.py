"""Linking mentions to ontology concepts: terms, retrieval, reranking, decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.udfs import sequence_ratio
from glossa.functions.vector import Index, nearest
from glossa.operators.abbreviations import last_forms, resolve
from glossa.sources.paths import drop, keep

# The weights of the final score.
WEIGHTS = {"embedding_score": 1.0, "exact": 0.35, "name_jaccard": 0.20, "label_jaccard": 0.15, "parenthetical": 0.10, "sequence": 0.05, "preferred": 0.03}


def ontology_terms(ontology: DataFrame) -> DataFrame:
    """(concept_id, preferred_label, synonyms, and record where the records have an order) to
    one row per name: raw_name, its plural-normalised name, identifier, preferred_label,
    is_preferred, ord, record."""
    o = ontology.where("coalesce(concept_id, '') <> '' and coalesce(preferred_label, '') <> ''")
    names = F.concat(F.array("preferred_label"), F.filter(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != ""))
    record = F.col("record") if "record" in ontology.columns else F.lit(0)
    d = o.select(F.col("concept_id").alias("identifier"), "preferred_label", record.cast("long").alias("record"), F.posexplode(names).alias("ord", "raw_name"))
    return d.withColumn("name", T.col(T.plural_normalize("raw_name"))).withColumn("is_preferred", F.col("ord") == 0)


def concept_metadata(terms: DataFrame) -> DataFrame:
    """(identifier, preferred_label, names): the label of a concept's first record (the least
    one where records have no order), and its distinct names, sorted."""
    return terms.groupBy("identifier").agg(F.min(F.struct("record", "preferred_label"))["preferred_label"].alias("preferred_label"), F.sort_array(F.collect_set("raw_name")).alias("names"))


def best_per_concept(hits: DataFrame, query: str, concept: str, score: str, tie: list[str], top: int) -> DataFrame:
    """Each query's best hit of every concept, and of these the ``top`` best, ranked."""
    one = Window.partitionBy(query, concept).orderBy(F.desc(score), *tie)
    best = hits.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), *tie))).where(F.col("rank") <= top)


def rerank(candidates: DataFrame, names: DataFrame, sequence: bool = True) -> DataFrame:
    """Candidates (query, identifier, embedding_score, is_preferred, preferred_label) with
    the lexical features of all of the concept's names (identifier, name) and the final
    score; rank by final score, embedding score, identifier."""
    c = candidates.withColumn("_qw", T.col(T.words("query"))).withColumn("_qn", T.col(T.normalize("query")))
    n = names.select(F.col("identifier").alias("_id"), "name", T.col(T.words("name")).alias("_nw"), T.col(T.normalize("name")).alias("_nn")).distinct()
    d = c.join(n, F.col("identifier") == F.col("_id"), "left")
    d = d.withColumn("_seq", F.coalesce(sequence_ratio("_qn", "_nn"), F.lit(0.0)) if sequence else F.lit(0.0))
    d = d.groupBy(*candidates.columns).agg(
        F.max(F.coalesce(F.col("_qn") == F.col("_nn"), F.lit(False)).cast("double")).alias("exact"),
        F.max(F.coalesce(T.col(T.jaccard("_qw", "_nw")), F.lit(0.0))).alias("name_jaccard"),
        F.max(F.coalesce(T.col(T.parenthetical("query", "name")), F.lit(False)).cast("double")).alias("parenthetical"),
        F.max("_seq").alias("sequence"),
    )
    d = d.withColumn("label_jaccard", T.col(T.jaccard(T.words("query"), T.words("preferred_label")))).withColumn("preferred", F.col("is_preferred").cast("double"))
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    d = d.withColumn("final_score", score).drop("preferred")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final_score"), F.desc("embedding_score"), "identifier")))


def hashed_encoder(dimensions: int = 128):
    """The default encoder: hashed character trigrams, L2-normalised."""

    @F.pandas_udf("array<float>")
    def encode(x: pd.Series) -> pd.Series:
        from zlib import crc32

        def of(s: str):
            v = np.zeros(dimensions, np.float32)
            t = f"  {s or ''} ".lower()
            for i in range(len(t) - 2):
                h = crc32(t[i : i + 3].encode())
                v[h % dimensions] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return x.map(of)

    return encode


def _numbered(terms: DataFrame) -> DataFrame:
    return terms.withColumn("term", F.xxhash64("identifier", "record", "ord", "raw_name"))


def term_index(terms: DataFrame, encoder) -> Index:
    """The terms' vectors as an index, encoded once for any number of ``retrieve``."""
    return Index(_numbered(terms).select("term", encoder("name").alias("embedding")), "term")


def retrieve(queries: DataFrame, terms: DataFrame, encoder, top: int, hits: int, index: Index | None = None) -> DataFrame:
    """Distinct ``queries`` (query) with the ``top`` concepts of their ``hits`` nearest terms, by
    an index of the terms where there is one, with the same result."""
    t = _numbered(terms)
    q = queries.select("query", encoder("query").alias("embedding"))
    near = index.nearest(q, hits, "query") if index else nearest(q, t.select("term", encoder("name").alias("embedding")), hits, "query", "term")
    d = near.join(t, F.col("term_id") == F.col("term")).select(F.col("query_id").alias("query"), "identifier", "raw_name", "preferred_label", "is_preferred", (-F.col("distance")).alias("embedding_score"), "ord")
    return best_per_concept(d, "query", "identifier", "embedding_score", ["identifier", "ord"], top).drop("rank", "ord")


def _by_model(queries: DataFrame, terms: DataFrame, names: DataFrame, encoder, top: int, hits: int, index: Index | None) -> DataFrame:
    """(query, m_hits): the reranked concepts of every distinct query, best first."""
    ranked = rerank(retrieve(queries.select("query").distinct(), terms, encoder, top, hits, index), names)
    one = F.struct("rank", "identifier", F.col("raw_name").alias("name"), "embedding_score", F.col("final_score").alias("score"))
    return ranked.groupBy(F.col("query").alias("_q")).agg(F.sort_array(F.collect_list(one)).alias("m_hits"))  # `top` concepts


def link(mentions: DataFrame, ontology: DataFrame, keys: DataFrame, defined: DataFrame, encoder=None, top: int = 1, ambiguous_top: int = 5, ranks: int = 1, index: Index | None = None) -> DataFrame:
    """Distinct (doc_key, mention) to identifier, name, scores and the source of the
    decision: abbreviation_direct, abbreviation_ambiguous_via_long_form, model_normal or
    none. Rules come first; only what is left is encoded, each distinct query once. A long
    form without any candidate leaves the mention to the model itself. ``hits`` are the
    best ``ranks`` concepts (identifier, name, embedding_score, score), best first. An
    ``index`` of the ontology's terms (``term_index``) may serve several calls. Each input is
    read once: its distinct rows, the rules' decisions and the hits of long forms are kept,
    as several of the steps behind them read them."""
    encoder = encoder or hashed_encoder()
    terms = keep(ontology_terms(ontology))
    names = terms.select("identifier", F.col("raw_name").alias("name"))
    read = [keep(x) for x in (mentions.select("doc_key", "mention").distinct(), keys, last_forms(defined))]
    d = keep(resolve(*read, encoder=encoder))
    drop(*read)
    d = d.withColumn("_direct", F.col("kind") == "direct").withColumn("_long", F.when(F.col("kind") == "ambiguous_long_form", T.col(T.plural_normalize("long_form"))))
    deep = _by_model(d.where("_long is not null").select(F.col("_long").alias("query")), terms, names, encoder, max(ambiguous_top, ranks), max(50, 10 * ranks), index)
    deep = keep(deep)
    d = d.join(deep.select(F.col("_q").alias("_long"), F.col("m_hits").alias("_deep")), "_long", "left")
    d = d.withColumn("query", F.when(~F.col("_direct") & F.col("_deep").isNull(), T.col(T.plural_normalize("mention"))))
    k = max(top, ranks)
    normal = _by_model(d.where("query is not null").select("query"), terms, names, encoder, k, max(10 * k, 20), index)
    d = d.join(normal, F.col("query") == F.col("_q"), "left").withColumn("_found", F.coalesce("_deep", "m_hits"))
    direct, long = F.col("_direct"), F.col("_deep").isNotNull()
    source = F.when(direct, "abbreviation_direct").when(F.col("_found").isNull(), "none").when(long, "abbreviation_ambiguous_via_long_form").otherwise("model_normal")
    own = F.array(F.struct("identifier", F.col("short_form").alias("name"), F.col("key_score").alias("embedding_score"), F.col("key_score").alias("score")))
    found = F.transform(F.slice("_found", 1, ranks), lambda x: F.struct(x["identifier"].alias("identifier"), x["name"].alias("name"), x["embedding_score"].alias("embedding_score"), x["score"].alias("score")))
    d = d.withColumn("hits", F.when(direct, own).otherwise(found))
    first = F.get("hits", F.lit(0))
    return d.select(
        "doc_key",
        "mention",
        first["identifier"].alias("identifier"),
        first["name"].alias("name"),
        first["embedding_score"].alias("embedding_score"),
        first["score"].alias("final_score"),
        source.alias("source"),
        F.when(direct, "cosine_similarity").otherwise("negated_cosine_distance").alias("score_kind"),
        F.when(long, F.col("long_form")).alias("expanded_long_form"),
        F.when(long, F.col("method")).alias("definition_method"),
        F.when(long, F.col("definition_key")).alias("definition_key"),
        F.when(long, F.col("score")).alias("definition_score"),
        F.when(F.col("kind") != "none", F.col("key_method")).alias("abbreviation_method"),
        "hits",
    )


def hits_of(ranked: DataFrame) -> DataFrame:
    """(doc_key, mention, identifier, name, score, rank) to one row per mention: its best
    concept and all of them as ``hits``, by rank."""
    one = F.struct("rank", "identifier", "name", F.col("score").cast("double").alias("score"))
    d = ranked.groupBy("doc_key", "mention").agg(F.sort_array(F.collect_list(one)).alias("_h"))  # the ranks of one mention
    hits = F.transform("_h", lambda x: F.struct(x["identifier"].alias("identifier"), x["name"].alias("name"), x["score"].alias("embedding_score"), x["score"].alias("score")))
    return d.select("doc_key", "mention", F.col("_h")[0]["identifier"].alias("identifier"), F.col("_h")[0]["name"].alias("name"), F.col("_h")[0]["score"].alias("final_score"), hits.alias("hits"))


def baseline_link(mentions: DataFrame, terms: DataFrame, defined: DataFrame, encoder=None, threshold: float = 0.0, top: int = 10) -> DataFrame:
    """Distinct (doc_key, mention) to (identifier, name, score, rank) of the ``top`` concepts:
    hits of the document's long form of the mention come first, then those of the mention
    itself; of hits of one concept the first counts; scores of at least ``threshold`` rank."""
    encoder = encoder or hashed_encoder()
    m = mentions.select("doc_key", F.trim("mention").alias("mention")).where("mention <> ''").distinct()
    long = defined.groupBy("doc_key", F.col("key").alias("mention")).agg(F.max_by("long_form", "ord").alias("text"))
    expanded = m.join(long, ["doc_key", "mention"]).where("text <> mention").select("doc_key", "mention", "text", F.lit(0).alias("turn"))
    texts = expanded.unionByName(m.select("doc_key", "mention", F.col("mention").alias("text"), F.lit(1).alias("turn")))
    hits = retrieve(texts.select(F.col("text").alias("query")).distinct(), terms, encoder, top, 10 * top)
    hits = hits.select(F.col("query").alias("text"), F.expr(T.id_case("identifier")).alias("identifier"), F.col("preferred_label").alias("name"), (1 + F.col("embedding_score")).alias("score")).where(F.col("score") >= threshold)
    one = texts.join(hits, "text").groupBy("doc_key", "mention", "identifier").agg(F.min_by(F.struct("name", "score"), F.struct("turn", -F.col("score"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("doc_key", "mention").orderBy(F.desc("b.score"), "identifier"))
    return one.select("doc_key", "mention", "identifier", "b.name", "b.score", (rank - 1).alias("rank")).where(F.col("rank") < top)


def entry_names(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids (identifier) with their CL form and the canonical name of the entry (id, name)
    that is equal without regard to case; without one the id itself."""
    e = entries.groupBy(F.upper("id").alias("_u")).agg(F.min_by("name", "id").alias("_name"))
    d = ids.withColumn("identifier", F.expr(T.id_case("identifier"))).withColumn("_u", F.upper("identifier"))
    return d.join(e, "_u", "left").withColumn("name", F.coalesce("_name", "identifier")).drop("_u", "_name")


def decision_counts(links: DataFrame) -> DataFrame:
    """Links by the source of the decision."""
    return links.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
