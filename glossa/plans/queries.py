"""Registered queries of the text-mining operators, over the driver's tables.

Stand-ins: ``part`` is the ontology (concept p_brand, name p_name, order p_partkey),
``documents`` are passages, words of documents are mentions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.udfs import byte_offsets, nfkc, sequence_ratio
from glossa.functions.vector import Index, distances, nearest
from glossa.operators import abbreviations as A
from glossa.operators import corpus as C
from glossa.operators import evaluate as V
from glossa.operators import flows
from glossa.operators import linking as L
from glossa.operators import recognize as R
from glossa.operators import spans as S
from glossa.sources import annotated, bioc, files, pieces
from glossa.streaming import annotate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/glossa-files"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _names(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select("p_name").distinct()


def _words(spark, sf, *ends: str) -> DataFrame:
    """(doc_id, pos, token, start, end): ASCII words of all documents, or those with an ending."""
    return S.token_spans(_t(spark, sf, "documents"), "doc_id", "text", S.ASCII, ends)


def _word_rows(spark, sf) -> DataFrame:
    return S.token_rows(_t(spark, sf, "documents"), "doc_id", "text", S.ASCII)


def _long(x: str):
    return F.col(x).cast("long").alias(x)


# ---------------------------------------------------------------- scans and statistics


@query
def passage_scan_filter(spark, sf):
    d = _t(spark, sf, "documents").where("length(text) > 0").select("doc_id", "source", F.char_length("text").cast("long").alias("n"))
    return S.ids_within(d, "source", ["doc_id"], "record_id").select("doc_id", "source", _long("record_id"), "n")


@query
def passage_running_id(spark, sf):
    d = _t(spark, sf, "documents").where("length(text) > 0").select("doc_id")
    return S.running_ids(d, ["doc_id"]).select("doc_id", _long("id"))


@query
def corpus_stats(spark, sf):
    return C.statistics(_t(spark, sf, "documents"), ["lang", "source"], "doc_id")


@query
def corpus_throughput(spark, sf):
    d = C.throughput(C.statistics(_t(spark, sf, "documents"), ["lang"], "doc_id"), 2.0)
    return d.select("lang", *[F.round(c, 6).alias(c) for c in ("ms_per_doc", "ms_per_passage", "ms_per_1k_tokens", "chars_per_s")])


@query
def token_totals(spark, sf):
    n = F.size(T.col(T.tokens("text")))
    return _t(spark, sf, "conversations").groupBy("role").agg(F.sum(n).cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))


@query
def concat_collections(spark, sf):
    a = _t(spark, sf, "documents").select(F.lit("documents").alias("file"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"))
    b = _t(spark, sf, "benchmark").select(F.lit("benchmark"), "item_id", F.md5(F.col("text").cast("binary")))
    return a.union(b)


@query
def rebuild_document(spark, sf):
    p = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("passage_idx"), "text")
    return A.document_texts(p).select(F.col("doc_key").alias("conv_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- text functions


@query
def token_split(spark, sf):
    d = _t(spark, sf, "documents").withColumn("w", T.col(T.tokens("text")))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|").cast("binary")).alias("digest"))


@query
def plural_normalize(spark, sf):
    d = _t(spark, sf, "documents").withColumn("p", T.col(T.plural_normalize("text")))
    return d.select("doc_id", F.char_length("p").cast("long").alias("n"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query
def text_keys(spark, sf):
    x = F.concat(F.upper(F.substring("p_name", 1, 3)), F.lit("-"), F.col("p_brand"), F.lit("  s"))
    d = _t(spark, sf, "part").select("p_partkey", "p_name", x.alias("x"))
    return d.select(
        "p_partkey",
        T.col(T.normalize("x")).alias("normal"),
        T.col(T.abbreviation_key("x")).alias("abbr_key"),
        F.array_join(T.col(T.variant_keys("x")), "|").alias("variants"),
        T.col(T.threshold("x")).alias("threshold"),
        T.col(T.abbreviation_like("x")).alias("looks_short"),
        T.col(T.abbreviation_like("p_name")).alias("name_looks_short"),
    )


@query
def relaxed_key(spark, sf):
    a = _t(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat(F.lit("(\u201c"), "p_name", F.lit("\u2019s\u201d\u2014\uff21_Cells).")).alias("x"))
    b = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), F.concat("n_name", F.lit("ies")))
    return a.union(b).select("id", nfkc("x").alias("x")).select("id", T.col(T.relaxed("x")).alias("relaxed"))


@query
def identifier_split(spark, sf):
    d = _ids(spark, sf).select("id", F.explode_outer(T.col(T.split_identifiers("x"))).alias("part"), T.col(T.id_case("x")).alias("cased"), F.array_join(T.col(T.ontology_ids("x")), "|").alias("found"))
    return d


def _ids(spark, sf):
    k = "p_partkey"
    x = f"""case {k} % 7 when 0 then concat('CL:', {k}) when 1 then concat('(skos:exact)CL:', {k}) when 2 then concat('(skos:related)CL:', {k})
        when 3 then concat('CL:', {k}, ';CL:', p_size) when 4 then concat('cl_', {k}, ', CL:', p_size) when 5 then '-' else 'None' end"""
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("passage_key"), F.col("p_type").alias("type"), F.expr(x).alias("x"))


@query
def identifier_gates(spark, sf):
    d = V.gated_ids(_ids(spark, sf).withColumnRenamed("x", "identifier"))
    return d.groupBy("type", "gate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gold_id").alias("n_ids"))


@query
def token_jaccard_pairs(spark, sf):
    """Pairs of names that share a word: joined by word, so no pair without one is made."""
    n = _names(spark, sf).select("p_name", T.col(T.words("p_name")).alias("w"))
    e = n.select("p_name", "w", F.explode("w").alias("word"))
    a, b = e.select("word", F.col("p_name").alias("a"), F.col("w").alias("wa")), e.select("word", F.col("p_name").alias("b"), F.col("w").alias("wb"))
    d = a.join(b, "word").where("a < b").select("a", "b", "wa", "wb").distinct()
    return d.select("a", "b", F.round(T.col(T.jaccard("wa", "wb")), 9).alias("jaccard"))


@query
def parenthetical_relation(spark, sf):
    d = _t(spark, sf, "part").select("p_partkey", "p_name", F.concat("p_brand", F.lit(" ("), F.upper("p_name"), F.lit(")")).alias("full"), F.concat(F.lit("("), "p_brand", F.lit(")")).alias("other"))
    return d.select("p_partkey", T.col(T.parenthetical("p_name", "full")).alias("related"), T.col(T.parenthetical("p_name", "other")).alias("unrelated"))


@query
def sequence_ratio_pairs(spark, sf):
    """Names that share a word, with their matching-blocks ratio."""
    d = token_jaccard_pairs(spark, sf)
    return d.select("a", "b", F.round(sequence_ratio(T.col(T.normalize("a")), T.col(T.normalize("b"))), 9).alias("ratio"))


@query
def byte_offset_map(spark, sf):
    """The byte offsets of all characters and of the text's end."""
    S.bounded_batches(spark)
    d = _t(spark, sf, "documents").select("doc_id", "text", F.char_length("text").cast("long").alias("n")).withColumn("m", byte_offsets("text"))
    return d.select("doc_id", "n", F.md5(F.array_join(F.col("m").cast("array<string>"), ",").cast("binary")).alias("digest"))


@query
def passage_keys(spark, sf):
    """Both kinds of passage keys, and document keys, where ids are missing."""
    x = "map('passage_id', if(turn % 3 = 0, concat('p', turn), ''), 'article-id_pmid', if(turn % 2 = 0, concat('a', conv_id), ''))"
    d = _t(spark, sf, "conversations").select("conv_id", "turn", F.expr("if(conv_id % 5 = 0, '', cast(conv_id as string))").alias("doc"), F.expr(x).alias("infons"))
    keys = {"passage_key": T.passage_key("doc", "turn", "infons"), "sourced_key": T.sourced_passage_key("if(conv_id % 2 = 0, 'a/b.xml', '')", "doc", "turn", "infons")}
    keys["document_key"] = T.document_key("doc", "infons['article-id_pmid']", "infons['passage_id']")
    return d.select("conv_id", "turn", *[T.col(x).alias(k) for k, x in keys.items()])


@query
def json_entities_parse(spark, sf):
    """Entities given as JSON texts, made of the spans of all documents, as typed lists."""
    e = _gold(spark, sf).select("passage_key", F.struct("start", "end", F.col("type").alias("label"), "text").alias("e"))
    texts = e.groupBy(F.col("passage_key").alias("doc_id")).agg(F.to_json(F.collect_list("e")).alias("entities"))
    d = _t(spark, sf, "documents").select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.sort_array(files.parse_entities()).alias("e"))
    lines = F.transform("e", lambda x: F.concat_ws(":", x["start"], x["end"], x["label"], x["text"]))
    return d.select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join(lines, ",").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- ontology and abbreviations


def _ontology(spark, sf) -> DataFrame:
    p = _t(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("n"))
    return p.select(F.col("p_brand").alias("concept_id"), F.element_at("n", 1).alias("preferred_label"), F.expr("slice(n, 2, size(n))").alias("synonyms"))


@query
def ontology_terms(spark, sf):
    d = L.ontology_terms(_ontology(spark, sf))
    return d.select("identifier", "preferred_label", "raw_name", "name", "is_preferred", _long("ord"))


@query
def concept_metadata(spark, sf):
    d = L.concept_metadata(L.ontology_terms(_ontology(spark, sf)))
    return d.select("identifier", "preferred_label", F.size("names").cast("long").alias("n_names"), F.array_join("names", "|").alias("names"))


def _abbr_rows(spark, sf) -> DataFrame:
    """Short forms: the first letters of a name's words, with dashes for even keys."""
    x = "array_join(transform(split(p_name, ' '), w -> upper(left(w, 2))), if(p_partkey % 2 = 0, '-', ''))"
    return _t(spark, sf, "part").select(F.expr(x).alias("short_form"), F.concat(F.lit("CL:"), "p_size").alias("identifier"), F.col("p_partkey").alias("line"))


@query
def abbrev_lookup(spark, sf):
    return A.lookup(_abbr_rows(spark, sf))


def _short_mentions(spark, sf) -> DataFrame:
    x = "array_join(transform(split(p_name, ' '), w -> upper(left(w, 2))), ' ')"
    s = _t(spark, sf, "part").select(F.expr(f"concat({x}, if(p_partkey % 3 = 0, 's', ''))").alias("mention"), F.expr("concat('d', p_partkey % 50)").alias("doc_key"))
    return s.distinct()


def _defined(spark, sf) -> DataFrame:
    x = "array_join(transform(split(p_name, ' '), w -> upper(left(w, 2))), '')"
    return _t(spark, sf, "part").select(F.expr("concat('d', p_partkey % 50)").alias("doc_key"), F.expr(f"concat({x}, if(p_partkey % 2 = 0, 's', ''))").alias("key"), F.col("p_name").alias("long_form"), F.col("p_partkey").alias("ord"))


@query
def abbrev_exact_join(spark, sf):
    m = _short_mentions(spark, sf).select("mention").distinct()
    return A.match_exact(m, A.lookup(_abbr_rows(spark, sf))).select("mention", "key", "n_ids", "short_form", "identifier")


@query
def doc_shortform_cascade(spark, sf):
    w = _short_mentions(spark, sf).select("doc_key", T.col(T.abbreviation_key("mention")).alias("key"))
    return A.cascade(w, _defined(spark, sf), fuzzy=False).select("doc_key", "key", "method", "matched_key", "long_form")


@query
def doc_shortform_fuzzy(spark, sf):
    w = _short_mentions(spark, sf).select("doc_key", T.col(T.abbreviation_key("mention")).alias("key"))
    return A.cascade(w, _defined(spark, sf)).select("doc_key", "key", "method", "matched_key", "long_form", F.round("score", 9).alias("score"))


@query
def abbrev_resolve(spark, sf):
    d = A.resolve(_short_mentions(spark, sf), A.lookup(_abbr_rows(spark, sf)), _defined(spark, sf), fuzzy=False)
    return d.select("doc_key", "mention", "kind", "identifier", F.when(F.col("kind") == "ambiguous_long_form", F.col("long_form")).alias("long_form"))


@query
def document_definitions(spark, sf):
    d = _t(spark, sf, "part").select(F.col("p_partkey").alias("doc_key"), F.expr("concat('We saw ', p_name, ' (', array_join(transform(split(p_name, ' '), w -> upper(left(w, 1))), ''), ') here.')").alias("text"))
    return A.document_definitions(d).select(F.col("doc_key").alias("p_partkey"), "key", "long_form", _long("ord"))


# ---------------------------------------------------------------- retrieval and linking


def _near(spark, sf, k) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    return nearest(e.where("vec_id % 50 = 0").select("vec_id", "embedding"), e, k, "vec_id", "vec_id")


@query
def link_topk_terms(spark, sf):
    return _near(spark, sf, 20).select("query_id", F.col("term_id").alias("vec_id"), F.col("distance"), _long("rank"))


@query
def link_topk_indexed(spark, sf):
    """The same hits as of all cells, by an index of clusters."""
    e = _t(spark, sf, "embeddings")
    d = Index(e, "vec_id").nearest(e.where("vec_id % 50 = 0"), 20, "vec_id")
    return d.select("query_id", F.col("term_id").alias("vec_id"), F.col("distance"), _long("rank"))


@query
def link_topk_concepts(spark, sf):
    """Nearest 20 terms of each query, best per concept, 5 best concepts."""
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("term_id"), "label")
    d = _near(spark, sf, 20).drop("rank").join(e, "term_id").withColumn("score", -F.col("distance"))
    best = L.best_per_concept(d, "query_id", "label", "score", ["term_id"], 5)
    return best.select("query_id", "label", F.col("term_id").alias("vec_id"), "distance", _long("rank"))


@query
def abbrev_nearest_key(spark, sf):
    """Long mentions with their nearest key by given vectors: queries are dimmed copies."""
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select("vec_id", F.expr("transform(embedding, (x, i) -> if(i % 8 = 0, x * 0.5F, x))").alias("embedding"))
    near = nearest(q, e, 1, "vec_id", "vec_id")
    m = q.select(F.col("vec_id").alias("_key"), "vec_id", F.expr("left('ABCDEFGHIJK', 3 + cast(vec_id % 8 as int))").alias("mention"))
    keys = e.select(F.col("vec_id").alias("key"), F.col("label").cast("long").alias("n_ids"))
    return A.pass_nearest(m, keys, near).select("mention", "vec_id", F.col("matched_key").alias("key_id"), "n_ids", "score")


@query
def cosine_pairs(spark, sf):
    """Every query against all rows: cells of blocks, a matrix product each."""
    e = _t(spark, sf, "embeddings")
    return distances(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id").select("query_id", F.col("term_id").alias("vec_id"), "distance")


def _reranked(spark, sf) -> DataFrame:
    """All names as queries against the brands that have a word of theirs."""
    part = _t(spark, sf, "part")
    n = part.select(F.col("p_brand").alias("identifier"), F.col("p_name").alias("name")).distinct()
    q = part.select(F.col("p_name").alias("query")).distinct()
    qw = q.select("query", F.explode(F.split("query", " ")).alias("w"))
    first = n.groupBy("identifier").agg(F.min("name").alias("preferred_label"))
    nw = n.select("identifier", F.explode(F.split("name", " ")).alias("w")).distinct()
    c = qw.join(nw, "w").groupBy("query", "identifier").agg(F.count(F.lit(1)).alias("shared")).join(first, "identifier")
    c = c.select("query", "identifier", "preferred_label", (F.col("shared") / -10.0).alias("embedding_score"), (F.col("query") == F.col("preferred_label")).alias("is_preferred"))
    return L.rerank(c, n, sequence=False)


@query
def rerank_candidates(spark, sf):
    """Candidates of all names with their features and scores."""
    return _reranked(spark, sf).select("query", "identifier", *[F.round(x, 9).alias(x) for x in ("exact", "name_jaccard", "label_jaccard", "parenthetical", "final_score")])


@query
def mention_distinct(spark, sf):
    w = _words(spark, sf)
    return w.groupBy(F.lower("token").alias("norm")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _gazetteer(spark, sf) -> DataFrame:
    """Terms: the words of the benchmark, with their first item."""
    b = S.token_spans(_t(spark, sf, "benchmark"), "item_id", "text", S.ASCII)
    return b.groupBy(F.lower("token").alias("term")).agg(F.min("item_id").alias("concept"))


@query
def mention_link_join(spark, sf):
    w = _words(spark, sf).withColumn("norm", F.lower("token"))
    g = _gazetteer(spark, sf)
    d = w.join(g, w.norm == g.term, "left")
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.count("concept").alias("n_linked"), F.countDistinct("concept").alias("n_concepts"))


@query
def decision_counters(spark, sf):
    d = A.resolve(_short_mentions(spark, sf), A.lookup(_abbr_rows(spark, sf)), _defined(spark, sf), fuzzy=False)
    return L.decision_counts(d.withColumnRenamed("kind", "source"))


@query
def stream_mentions(spark, sf):
    """All documents as a stream: every distinct word is linked once, by the batch that first
    brings it; state and batches lie in the shared folder."""
    docs = _t(spark, sf, "documents")
    g = _gazetteer(spark, sf)
    folder = _folder(spark, "stream")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf}/documents.parque[t]")  # a pattern: one file or a folder of files
    words = S.token_spans(stream, "doc_id", "text", S.ASCII).select(F.lower("token").alias("mention"))
    find = lambda m: m.join(g.withColumnRenamed("term", "mention"), "mention", "left").select("mention", "concept")
    annotate.link_new(words, find, f"{folder}/links", f"{folder}/state").awaitTermination()
    return spark.read.schema("mention string, concept long").parquet(f"{folder}/links").select("mention", F.coalesce("concept", F.lit(-1)).cast("long").alias("concept"))


@query
def link_mentions(spark, sf):
    """The whole linker with its default encoder."""
    m = _short_mentions(spark, sf)
    long = _t(spark, sf, "part").select(F.expr("concat('d', p_partkey % 50)").alias("doc_key"), F.col("p_name").alias("mention"))
    d = L.link(m.select("doc_key", "mention").union(long), _ontology(spark, sf), A.lookup(_abbr_rows(spark, sf)), _defined(spark, sf))
    return d.select("doc_key", "mention", "identifier", "name", F.round("final_score", 6).alias("final_score"), "source")


@query
def contrastive_loss(spark, sf):
    e = _t(spark, sf, "embeddings")
    d = C.contrastive_loss(C.balanced_sample(e, "label", "vec_id", 8, 4))
    return d.select(F.round("loss", 6).alias("loss"), "anchors")


# ---------------------------------------------------------------- chunks, labels, tags


@query
def chunk_windows(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.size(T.col(T.tokens("text"))).alias("n"))
    return S.chunks(d, "doc_id", "n").select("doc_id", _long("chunk"), _long("first"), _long("last"))


def _logits(spark, sf) -> DataFrame:
    d = _t(spark, sf, "embeddings").select(F.expr("vec_id div 3").alias("token"), F.col("vec_id").alias("chunk"), F.posexplode("embedding").alias("label", "logit"))
    return d.withColumn("logit", F.col("logit").cast("double"))


@query
def logit_average(spark, sf):
    d = S.average_logits(_logits(spark, sf), ["token"], "label", "logit")
    return d.select("token", _long("label"), F.round("mean_logit", 9).alias("mean_logit"), "n_chunks")


@query
def logit_argmax(spark, sf):
    d = S.average_logits(_logits(spark, sf), ["token"], "label", "logit")
    return S.best_label(d, ["token"], "label").select("token", _long("label"))


@query
def bio_decode(spark, sf):
    """Events of a user as tags: every fourth is O, every fifth begins a span."""
    tag = F.when(F.col("event_id") % 4 == 0, "O").otherwise(F.concat(F.when(F.col("event_id") % 5 == 0, "B-").otherwise("I-"), "event_type"))
    d = _t(spark, sf, "events").select("user_id", "ts", "event_id", tag.alias("tag"), (F.col("event_id") * 2).alias("s"), (F.col("event_id") * 2 + F.when(F.col("event_id") % 11 == 0, 0).otherwise(1)).alias("e"))
    return S.decode_tags(d, "user_id", ["ts", "event_id"], "tag", "s", "e").select("user_id", "label", "start", "end", "n_tokens")


def _entities(spark, sf) -> DataFrame:
    """Entities: from each word ending in 'ing' or 'tion' on, its second half and 12 more characters."""
    w = _words(spark, sf).where("token rlike '(ing|tion)$'")
    return w.select("doc_id", F.col("pos").alias("entity"), F.when(F.endswith("token", F.lit("ing")), "ing").otherwise("tion").alias("label"), F.expr("start + char_length(token) div 2").cast("int").alias("start"), F.expr("end + 12").cast("int").alias("end"))


@query
def bio_encode(spark, sf):
    d = S.encode_tags(_word_rows(spark, sf), _entities(spark, sf), "doc_id")
    return d.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("long")).alias("pos_sum"))


@query
def bio_encode_skip(spark, sf):
    d = S.encode_tags(_word_rows(spark, sf), _entities(spark, sf), "doc_id", "skip")
    return d.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("long")).alias("pos_sum"))


@query
def chunk_labels(spark, sf):
    """Labels of all windows' tokens; the window's two special places are -100."""
    tagged = S.tag_texts(_t(spark, sf, "documents"), _entities(spark, sf), "doc_id", "text", S.ASCII)
    label = F.expr("transform(tags, t -> case t when 'O' then 0 when 'B-ing' then 1 when 'I-ing' then 2 when 'B-tion' then 3 else 4 end)")
    d = tagged.where("size(tags) > 0").select("doc_id", F.size("tags").alias("n"), label.alias("labels"))
    starts, width = S.window_starts("n", 128, 32)
    sums = F.expr(f"transform({starts}, f -> named_struct('label_sum', aggregate(slice(labels, f + 1, {width}), -200L, (a, x) -> a + x), 'n', cast(least({width}, n - f) + 2 as long)))")
    return d.select("doc_id", F.posexplode(sums).alias("chunk", "w")).select("doc_id", _long("chunk"), "w.label_sum", "w.n")


@query
def recognize_windows(spark, sf):
    """Recognition of all documents by a linear model over windows, fitted on their labels."""
    tagged = S.tag_texts(_t(spark, sf, "documents"), _entities(spark, sf), "doc_id", "text", S.ASCII)
    model = R.fit_linear(R.tagged_windows(tagged, "doc_id", 128, 32), ["O", "B-ing", "I-ing", "B-tion", "I-tion"])
    d = R.recognize(_t(spark, sf, "documents"), R.windowed(model, 128, 32), "doc_id", word=S.ASCII)
    return d.select("doc_id", "label", _long("start"), _long("end"), "n_tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def label_schema(spark, sf):
    return C.label_schema(_t(spark, sf, "events"), "event_type").select(_long("label_id"), "label")


@query
def label_recode(spark, sf):
    d = _t(spark, sf, "events")
    first, second = "click", "view"
    return C.recode(d, "event_type", {first: second}, ("purchase",)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def balanced_sample(spark, sf):
    d = C.balanced_sample(_t(spark, sf, "embeddings"), "label", "vec_id", 5, 3)
    return d.select(_long("label"), "vec_id", _long("pick"))


@query
def label_index(spark, sf):
    """The rows of every label that has three or more, by dense numbers of labels and rows."""
    d = C.label_index(_t(spark, sf, "embeddings"), "label", "vec_id", 3)
    return d.groupBy("label_id", "label", "n").agg(F.sum((F.col("pos") + 1) * F.col("key")).alias("mark")).select("label_id", _long("label"), "n", "mark")


@query
def batch_plan(spark, sf):
    """The second epoch's batches: four labels, three rows of each."""
    d = C.batch_plan(_t(spark, sf, "embeddings"), "label", "vec_id", 4, 3, 200, 1)
    return d.select("batch", "slot", _long("label"), F.col("key").alias("vec_id"))


# ---------------------------------------------------------------- span joins


def _gold(spark, sf) -> DataFrame:
    w = _words(spark, sf, "ing", "tion")
    kind = F.when(F.endswith("token", F.lit("ing")), "ing").otherwise("tion")
    return w.select(F.col("doc_id").alias("passage_key"), F.col("pos").alias("id"), kind.alias("type"), "start", "end", F.col("token").alias("text"))


def _pred(spark, sf) -> DataFrame:
    w = _words(spark, sf, "ing", "ion").where("char_length(token) >= 6")
    kind = F.when(F.endswith("token", F.lit("ing")), "ing").otherwise("tion")
    begin = F.when(F.col("pos") % 3 == 0, F.greatest(F.col("start") - 4, F.lit(0))).otherwise(F.col("start"))
    return w.select(F.col("doc_id").alias("passage_key"), F.col("pos").alias("id"), kind.alias("type"), begin.cast("int").alias("start"), "end", F.col("token").alias("text"))


def _located(d: DataFrame) -> DataFrame:
    return d.withColumn("locations", F.concat_ws("-", "start", "end"))


@query
def span_overlap_pairs(spark, sf):
    both = _pred(spark, sf).select("passage_key", (2 * F.col("id")).alias("i"), "start", "end").union(_gold(spark, sf).select("passage_key", 2 * F.col("id") + 1, "start", "end"))
    d = S.overlapping_pairs(both, "passage_key", "i")
    return d.groupBy("passage_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("long") * 3 + F.col("b")).alias("mark"))


@query
def span_containment_join(spark, sf):
    """Spans in passages of 400 characters; those that cross an edge go."""
    p = _t(spark, sf, "documents").select("doc_id", F.char_length("text").alias("n")).select("doc_id", "n", F.posexplode(F.expr("sequence(0, n, 400)")).alias("passage", "start"))
    p = p.select("doc_id", "passage", "start", F.expr("least(start + 400, n)").alias("end"))
    d = S.contained(_gold(spark, sf).withColumnRenamed("passage_key", "doc_id"), p, "doc_id")
    return d.select("doc_id", _long("id"), _long("passage"), _long("local_start"))


@query
def span_token_overlap_join(spark, sf):
    d = S.token_overlaps(_gold(spark, sf), _pred(spark, sf), _t(spark, sf, "documents").withColumnRenamed("doc_id", "passage_key"), "passage_key")
    return d.groupBy("passage_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ref").cast("long") * 3 + F.col("pred")).alias("mark"))


@query
def strict_span_prf(spark, sf):
    d = V.strict_spans(_located(_gold(spark, sf)), _located(_pred(spark, sf)))
    return d.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def relaxed_span_prf(spark, sf):
    d = V.relaxed_spans(_gold(spark, sf), _pred(spark, sf), _t(spark, sf, "documents").withColumnRenamed("doc_id", "passage_key"), ["the", "being"])
    return d.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _link_pred(spark, sf) -> DataFrame:
    d = _ids(spark, sf)
    ranks = d.select("passage_key", "type", "id", F.explode(F.expr("sequence(0, 11)")).alias("rank"))
    pred = F.when((F.col("id") + F.col("rank")) % 9 == 0, "-").otherwise(F.concat(F.lit("CL:"), F.col("id") + F.col("rank") - 3))
    d = ranks.select("passage_key", "type", "id", "rank", pred.alias("pred_id"), F.concat(F.lit("0."), F.lit(99) - F.col("rank") * 7).alias("score"))
    return d


def _placed(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("passage_key", "type", "id").orderBy("rank")
    return d.withColumn("place", F.row_number().over(w) - 1)


@query
def link_prf_topk(spark, sf):
    gold = V.gold_ids(_ids(spark, sf).withColumnRenamed("x", "identifier"), "allLabels")
    d = V.link_scores(gold, _placed(V.ranked_ids(_link_pred(spark, sf))), ["passage_key", "type"])
    return d.select(_long("top"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def link_prf_grid(spark, sf):
    """Every gate and every part type as entity type set, with a score threshold."""
    pred = _placed(V.ranked_ids(_link_pred(spark, sf), 0.5))
    gold = V.gated_ids(_ids(spark, sf).withColumnRenamed("x", "identifier"))
    best = pred.where("place < 5").select("type", "passage_key", F.col("pred_id").alias("i"), F.explode(F.array(*[F.lit(g) for g in V.GATES])).alias("gate"))
    d = V.scores(V.set_counts(gold.select("gate", "type", "passage_key", F.col("gold_id").alias("i")), best, ["passage_key", "i"], ["gate", "type"]))
    return d.select("gate", "type", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _linked(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Spans of all documents with ids, and predicted spans with ranked ids of two models."""
    n = F.char_length("text")
    place = F.array(F.struct(F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length")))
    own = F.concat(F.lit("CL:"), n)
    kind = F.col("id") % 5
    x = F.when(kind == 1, F.concat(F.lit("(skos:related)"), own)).when(kind == 2, F.concat(own, F.lit(";CL:"), n + 1)).when(kind == 3, "-").otherwise(own)
    gold = _gold(spark, sf).select(F.col("id").alias("ann"), "passage_key", "type", place.alias("locations"), x.alias("identifier"))
    p = _pred(spark, sf).select("*", F.explode(F.expr("sequence(0, 5)")).alias("rank")).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"))
    pred = F.when((F.col("id") + F.col("rank")) % 7 == 0, "-").otherwise(F.concat(F.lit("CL:"), n + F.when(F.col("model") == "a", F.col("rank") - 1).otherwise(-F.col("rank"))))
    return gold, p.select(F.col("id").alias("ann"), "passage_key", "type", place.alias("locations"), "text", "model", "rank", pred.alias("pred_id"), F.concat(F.lit("0."), 90 - F.col("rank") * 10).alias("score"))


@query
def evaluate_link_suite(spark, sf):
    """Models, gates, sets of types, all three modes and tops in one pass, with a blacklist."""
    gold, pred = _linked(spark, sf)
    passages = _t(spark, sf, "documents").withColumnRenamed("doc_id", "passage_key")
    d = V.link_grid(gold, pred, passages, ["a", "b"], V.GATES, {"both": None, "ing": ["ing"]}, (1, 3, 5), V.MODES, 0.5, ["being"])
    return d.select("model", "gate", "type_set", "score_mode", _long("top"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _passage_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("passage_key"), F.lit(0).alias("offset"), "text")
    p = d.where("passage_key % 7 <> 0").select(F.expr("if(passage_key % 11 = 0, passage_key + 1000000000, passage_key)").alias("passage_key"), F.expr("if(passage_key % 13 = 0, 1, offset)").alias("offset"), F.expr("if(passage_key % 17 = 0, concat(text, '.'), text)").alias("text"))
    return d, p


@query
def verify_passages(spark, sf):
    return V.verify_passages(*_passage_sides(spark, sf))


@query
def drop_unknown_passages(spark, sf):
    refs, preds = _passage_sides(spark, sf)
    return V.drop_unknown(preds, refs).select("passage_key", _long("offset"))


# ---------------------------------------------------------------- files


def _files(spark, sf) -> DataFrame:
    """(path, content): a file per conversation, its turns as passages one after the other."""
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    clean = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    at = "aggregate(slice(p, 1, i), 0, (a, x) -> a + char_length(x.text) + 1)"
    passage = f"concat('<passage><infon key=\"type\">', x.role, '</infon><offset>', {at}, '</offset><text>', {clean.format('x.text')}, '</text></passage>')"
    body = f"array_join(transform(p, (x, i) -> {passage}), '')"
    text = f"concat('<collection><source>made</source><document><id>', conv_id, '</id>', {body}, '</document></collection>')"
    return c.select(F.format_string("conv-%08d.xml", "conv_id").alias("path"), F.expr(text).cast("binary").alias("content"))


def _document_spans(docs: DataFrame) -> DataFrame:
    """(path, doc_id, start, end, label): words of passages in ing and tion, by place."""
    p = bioc.passages(docs).withColumn("key", F.concat_ws("|", "doc_id", "passage_idx"))
    w = S.token_spans(p, "key", "text", S.ASCII).where("token rlike '(ing|tion)$'")
    d = w.join(p.select("key", "path", "doc_id", "passage_offset"), "key")
    kind = F.when(F.endswith("token", F.lit("ing")), "ing").otherwise("tion")
    return d.select("path", "doc_id", *[(F.col(c) + F.col("passage_offset")).cast("int").alias(c) for c in ("start", "end")], kind.alias("label"))


def _file_spans(spark, sf) -> DataFrame:
    return _document_spans(annotated.documents(_files(spark, sf)))


def _written(spark, sf) -> DataFrame:
    return annotated.with_spans(_files(spark, sf), _file_spans(spark, sf))


@query
def xml_passages(spark, sf):
    d = bioc.passages(annotated.documents(_files(spark, sf)))
    return d.select("path", "doc_id", _long("passage_idx"), _long("passage_offset"), F.col("infons")["type"].alias("type"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def xml_corpus_counts(spark, sf):
    return flows.corpus_counts(annotated.documents(_written(spark, sf), "xml"))


@query
def xml_concatenate(spark, sf):
    """All files as one collection: lines of one document each, between header and end."""
    d = annotated.concatenate(_files(spark, sf))
    return d.select("place", F.md5(F.when(F.col("place").isin("0", "2"), F.col("value")).otherwise(F.regexp_extract("value", "<id>([^<]*)</id>", 1)).cast("binary")).alias("digest"))


@query
def xml_spans_write(spark, sf):
    """Spans written into files and read back: every annotation with its number."""
    a = bioc.annotations(bioc.passages(annotated.documents(_written(spark, sf), "xml")))
    return a.select("path", "ann_id", "type", _long("passage_idx"), F.col("locations")[0]["offset"].cast("long").alias("offset"), F.col("locations")[0]["length"].cast("long").alias("length"), "text")


@query
def xml_by_document(spark, sf):
    """All conversations in one collection's files, edited by document: every annotation."""
    folder = _folder(spark, "collection")
    annotated.concatenate(_files(spark, sf)).repartitionByRange(4, "place", "path", "n").sortWithinPartitions("place", "path", "n").select("value").write.text(folder)
    whole = lambda d: annotated.documents(d.where(pieces.is_document()).select("path", F.concat(F.lit("<collection>"), F.expr("substring(value, instr(value, '<document'))"), F.lit(pieces.END + "</collection>")).alias("xml")), "xml")
    d = pieces.read(spark, folder)
    a = bioc.annotations(bioc.passages(whole(pieces.with_spans(d, _document_spans(whole(d))))))
    return a.select("doc_id", "type", _long("passage_idx"), F.col("locations")[0]["offset"].cast("long").alias("offset"), F.col("locations")[0]["length"].cast("long").alias("length"), "text")


@query
def xml_entities(spark, sf):
    e = bioc.entities(bioc.annotations(bioc.passages(annotated.documents(_written(spark, sf), "xml"))))
    return e.select("path", "entity_id", _long("start"), _long("end"), "surface")


@query
def xml_links_write(spark, sf):
    """Links of annotations' normalised texts written as infons: matched and missing."""
    files = _written(spark, sf).select("path", F.col("xml").cast("binary").alias("content"))
    found = annotated.mentions(annotated.documents(files))
    n = F.char_length("normal")
    links = found.select("doc_key", F.col("normal").alias("mention")).distinct().withColumn("normal", F.col("mention")).where(n % 2 == 0)
    links = links.select("doc_key", "mention", F.concat(F.lit("CL:"), n).alias("identifier"), F.col("mention").alias("name"), F.lit(0.5).alias("final_score"))
    d = annotated.with_links(files, found, links, "m", True)
    a = bioc.annotations(bioc.passages(annotated.documents(d, "xml"))).where(F.col("infons")["m_id_0"].isNotNull())
    ids = a.groupBy("path").agg(F.countDistinct(F.col("infons")["m_id_0"]).alias("n_ids"), F.min(F.col("infons")["m_identifier_name_0"]).alias("least_name"))
    return d.select("path", "matched", "missing").join(ids, "path", "left").select("path", "matched", "missing", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), "least_name")


@query
def link_ranks_round_trip(spark, sf):
    """Ten ranked links of each mention into files, back from them, and scored at three tops."""
    xml = _written(spark, sf).select("path", F.col("xml").cast("binary").alias("content"))
    found = annotated.mentions(annotated.documents(xml))
    n = F.char_length("mention")
    m = found.select("doc_key", F.col("normal").alias("mention")).distinct().where(n % 3 != 0)
    ranked = m.select("doc_key", "mention", F.explode(F.expr("sequence(0, 9)")).alias("rank")).withColumns({"identifier": F.concat(F.lit("CL:"), n + F.col("rank")), "name": F.col("mention"), "score": 1 / (1 + F.col("rank"))})
    done = annotated.with_links(xml, found, L.hits_of(ranked), "m", True, 6)
    a = bioc.annotations(bioc.passages(annotated.documents(done, "xml"))).select(F.concat_ws("|", "path", "passage_idx").alias("passage_key"), F.col("ann_id").alias("ann"), "type", "locations", "text", "infons")
    gold = a.withColumn("identifier", F.concat(F.lit("CL:"), F.char_length("text") + F.expr("cast(substring(ann, 2) as int) % 12")))
    d = V.evaluate_links(gold, V.predicted_ids(a, "m"), ("allLabels",), None, threshold=0.0)
    return d.select(_long("top"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def training_records(spark, sf):
    d = flows.training_records(annotated.documents(_written(spark, sf), "xml"), rename={"ing": "act"}, without=("none",))
    e = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["start"], x["end"], x["label"], x["text"])), ",")
    return d.select("id", "document_id", _long("passage_id"), _long("passage_offset"), F.size("entities").cast("long").alias("n"), F.md5(e.cast("binary")).alias("digest"))


@query
def evaluate_link_grid(spark, sf):
    """All gates and tops, of gold mentions and end to end, of two sets of types."""
    place = F.array(F.struct(F.col("id").cast("int").alias("offset"), F.lit(1).alias("length")))
    gold = _ids(spark, sf).select(F.col("id").alias("ann"), "passage_key", "type", place.alias("locations"), F.col("x").alias("identifier"))
    moved = F.array(F.struct((F.col("id") + (F.col("id") % 4 == 0).cast("int")).cast("int").alias("offset"), F.lit(1).alias("length")))
    pred = _link_pred(spark, sf).select(F.col("id").alias("ann"), "passage_key", "type", moved.alias("locations"), "rank", "pred_id", "score")
    d = V.link_grid(gold, pred, type_sets={"all": None, "sizes": ["LARGE", "MEDIUM", "SMALL"]})
    return d.select("type_set", "score_mode", "gate", _long("top"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def file_datasets(spark, sf):
    """Documents as JSON lines, read back as a data set, its columns inferred."""
    path = _folder(spark, "docs") + ".jsonl"
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("document_id"))
    files.write_json(d, path)
    back = files.dataset(spark, path, "id long, text string, document_id string")
    c = files.infer_columns(back.columns)
    return back.select(F.col(c["record_id"]).alias("doc_id"), F.col(c["document_id"]).alias("lang"), F.md5(F.col(c["text"]).cast("binary")).alias("digest"))


@query
def file_predictions(spark, sf):
    """Spans of all documents written as predictions, and back as one row per entity."""
    path = _folder(spark, "predictions")
    e = F.struct(F.col("type").alias("label"), F.col("start").alias("start_local"), F.col("end").alias("end_local"), (F.col("start") + 7).alias("start"), (F.col("end") + 7).alias("end"), "text")
    own = _gold(spark, sf).groupBy(F.col("passage_key").alias("doc_id")).agg(F.sort_array(F.collect_list(e)).alias("predicted_entities"))
    d = _t(spark, sf, "documents").join(own, "doc_id", "left")
    files.write_predictions(d.select(F.col("doc_id").alias("id"), "text", F.lit(7).alias("passage_offset"), F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("passage_id"), "predicted_entities"), path)
    kind = "document_id string, predicted_entities array<struct<label:string,start:int,end:int>>"
    back = files.predicted_entities(spark.read.schema(kind).json(f"{path}/lines"))
    return back.select("document_id", "label", _long("start"), _long("end"))


@query
def file_training_pairs(spark, sf):
    """Training pairs as lines, and the distinct names of each concept from them."""
    path = _folder(spark, "pairs")
    files.write_lines(C.pair_lines(C.training_pairs(_terms(spark, sf))), path)
    return files.pairs(spark, path)


@query
def file_dictionary(spark, sf):
    path = _folder(spark, "dictionary")
    files.write_dictionary(_terms(spark, sf), path)
    return spark.read.text(path).select(F.split("value", "\t")[0].alias("term"), F.split("value", "\t")[1].alias("concept"))


@query
def file_abbreviations(spark, sf):
    """Short forms as a tab-separated table with its header, and the lookup of its rows."""
    path = _folder(spark, "abbreviations") + ".tsv"
    rows = _abbr_rows(spark, sf).select(F.concat_ws("\t", "short_form", F.concat("identifier", F.lit(";CL:0")), F.lit("more")).alias("value"), F.col("line").alias("n"))
    head = spark.createDataFrame([("\t".join(files.ABBREVIATION_HEADER), -1)], "value string, n int")
    head.union(rows).repartitionByRange(4, "n").sortWithinPartitions("n").select("value").write.text(path)
    return A.lookup(files.abbreviations(spark, path)).select("key", "n_ids", "n_rows")


@query
def file_ontology(spark, sf):
    """The ontology as JSON lines, strictly read, as terms."""
    path = _folder(spark, "ontology")
    o = _ontology(spark, sf).select(F.col("concept_id").alias("norm_concept_id"), F.col("preferred_label").alias("norm_preferred_label"), "synonyms", F.lit("x").alias("namespace"))
    o.write.json(path)
    d = L.ontology_terms(files.ontology(spark, path))
    return d.select("identifier", "raw_name", "name", "is_preferred", _long("ord"))


@query
def file_ontology_tolerant(spark, sf):
    """The ontology under other field names, over several lines an object, with obsolete and
    foreign concepts: the relaxed keys of what is left."""
    path = _folder(spark, "tolerant")
    mark, other = F.expr("conv(right(concept_id, 1), 10, 10) = 3"), F.expr("conv(right(concept_id, 1), 10, 10) = 4")
    o = _ontology(spark, sf).select(F.concat(F.when(other, "GO:").otherwise("CL_"), F.regexp_replace("concept_id", "[^0-9]", "")).alias("id"), F.col("preferred_label").alias("label"), F.struct(F.col("synonyms").alias("near"), F.lit(None).cast("string").alias("none")).alias("alias"), mark.alias("deprecated"))
    o.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.text(path)
    return files.relaxed_aliases(files.tolerant_ontology(spark, path))


@query
def file_xml_each(spark, sf):
    """One annotated file per conversation, read back by folder and named."""
    folder = _folder(spark, "each")
    annotated.save_each(_written(spark, sf).select("path", "xml"), folder, ".out.xml")
    docs = bioc.read(spark, folder, "*.xml")
    a = bioc.annotations(bioc.passages(docs))
    return a.groupBy(F.expr("element_at(split(path, '/'), -1)").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("locations")[0]["offset"]).cast("long").alias("offsets"))


def _noted(spark, sf) -> DataFrame:
    """Documents of one passage per turn whose first word is annotated, with ids and a mark of
    vague ones; every third turn must not be annotated, every fourth one has sentences of
    which the second one lacks its text."""
    clean = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    c = _t(spark, sf, "conversations").where("length(text) > 0").withColumn("w", F.regexp_extract("text", "^([A-Za-z]*)", 1)).withColumn("n", F.char_length("w"))
    note = """if(n = 0, '', concat('<annotation id="A"><infon key="identifier">(skos:', if(n % 2 = 0, 'exact', 'related'), ')CL:', n, '</infon><infon key="Semantic_Type">s', n, '</infon><infon key="type">', if(n = 3, 'cell_vague', role),
        '</infon><location offset="9" length="1"/><location offset="5" length="', n - 1, '"/><text>', w, '</text></annotation>'))"""
    cut = "char_length(text) div 2"
    sentences = f"""if(turn % 4 = 0, concat('<sentence><offset>5</offset><text>', {clean.format(f"substring(text, 1, {cut})")}, '</text></sentence><sentence><offset>', 5 + {cut}, '</offset></sentence>'), '')"""
    body = f"""concat('<collection><document><id>', conv_id, '</id><passage>', if(turn % 3 = 0, '<infon key="annotatable"></infon>', ''), '<offset>5</offset><text>', {clean.format('text')}, '</text>', {sentences}, {note}, '</passage></document></collection>')"""
    return annotated.documents(c.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.expr(body).alias("xml")), "xml")


@query
def xml_corpus_mentions(spark, sf):
    """The distinct spellings of each gold concept, of exact relations."""
    return flows.corpus_mentions(_noted(spark, sf), ("exact",)).groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.min(F.lower("term")).alias("least"), F.countDistinct("pos").alias("n_pos"))


@query
def xml_types(spark, sf):
    """Annotations by the first of their types in the file."""
    return bioc.annotations(bioc.passages(_noted(spark, sf))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def xml_spans_of(spark, sf):
    """Annotations of two places that lie within their passages, and the texts there."""
    a = bioc.annotations(bioc.passages(_noted(spark, sf))).withColumn("text", F.lit(""))
    return bioc.spans_of(V.of_types(a.withColumn("type", F.col("infons")["type"]))).select("path", "type", F.col("locations")[0]["offset"].cast("long").alias("first"), "text")


@query
def xml_text_units(spark, sf):
    """Passages or their sentences; a sentence without text has the passage's."""
    u = flows.text_units(_noted(spark, sf))
    return u.select("path", _long("sentence_idx"), _long("unit_offset"), F.md5(F.col("text").cast("binary")).alias("digest")).withColumn("sentence_idx", F.coalesce("sentence_idx", F.lit(-1)))


@query
def xml_link_mentions(spark, sf):
    """Mentions to link: in passages that may be annotated, without vague ones."""
    m = annotated.mentions(_noted(spark, sf))
    return m.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"), F.min("mention").alias("least"))


@query
def entry_names(spark, sf):
    """Ids in any case with the canonical names of entries."""
    ids = _t(spark, sf, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "cl_").otherwise("CL:"), "p_size").alias("identifier")).distinct()
    entries = _t(spark, sf, "part").where("p_size % 3 <> 0").select(F.concat(F.lit("Cl:"), "p_size").alias("id"), F.first("p_type").over(Window.partitionBy("p_size").orderBy("p_type")).alias("name"))
    return L.entry_names(ids, entries).select("identifier", "name")


@query
def evaluate_link_top(spark, sf):
    """One top of the link evaluation, of two types."""
    gold, pred = _linked(spark, sf)
    d = V.choose_top(V.evaluate_links(gold, pred.where("model = 'a'").drop("model"), types=["ing"], mode="end_to_end"), "top5")
    return d.select("gate", _long("top"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def rerank_ranks(spark, sf):
    """The places of reranked candidates."""
    return _reranked(spark, sf).select("query", "identifier", _long("rank"))


# ---------------------------------------------------------------- corpora


def _terms(spark, sf) -> DataFrame:
    x = "case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then concat(' ', replace(p_name, ' ', '  ')) else p_name end"
    return C.dedupe_terms(_t(spark, sf, "part").withColumn("x", F.expr(x)), "p_brand", "x", "p_partkey")


@query
def term_dedupe(spark, sf):
    return _terms(spark, sf).select("concept", "term", _long("pos"))


@query
def training_pairs(spark, sf):
    return C.training_pairs(_terms(spark, sf))


def _concept_names(spark, sf) -> DataFrame:
    x = "if(p_partkey % 2 = 0, p_name, concat(p_name, ' ', p_brand))"
    return _t(spark, sf, "part").select(F.col("p_brand").alias("concept"), F.expr(x).alias("name"))


@query
def ambiguous_name_filter(spark, sf):
    return C.drop_ambiguous(_concept_names(spark, sf))


@query
def ambiguous_name_statistics(spark, sf):
    return C.ambiguity_statistics(_concept_names(spark, sf))


@query
def corpus_overlap(spark, sf):
    docs = _t(spark, sf, "documents").where("doc_id is not null")
    f = S.token_spans(docs, "lang", "text", S.ASCII).select(F.col("lang").alias("corpus"), F.lower("token").alias("form"))
    return C.overlap(f, _gazetteer(spark, sf).withColumnRenamed("term", "form"))


@query
def annotate_e2e(spark, sf):
    """Recognise gazetteer terms in all documents and link each span by its text."""
    g = _gazetteer(spark, sf)
    docs = _t(spark, sf, "documents")
    d = R.recognize(docs, R.gazetteer(g, longest=1), "doc_id")
    d = d.withColumn("term", F.lower("text")).join(g, "term", "left")
    return d.select("doc_id", _long("start"), _long("end"), "text", "concept")
