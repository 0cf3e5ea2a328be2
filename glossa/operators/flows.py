"""Whole flows over files: recognise, link, annotate, prepare training data, report overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.udfs import nfkc
from glossa.operators import abbreviations as A
from glossa.operators import corpus as C
from glossa.operators import linking as L
from glossa.operators import recognize as R
from glossa.operators import spans as S
from glossa.operators.recognize import Recognizer, recognize
from glossa.sources import annotated, bioc, files, paths

# Types that training renames, and those that it leaves out.
TRAIN_AS = {"cell_phenotype": "cell_type", "cell_hetero": "cell_type"}
TRAIN_WITHOUT = ("cell_vague",)


def text_units(docs: DataFrame) -> DataFrame:
    """(path, doc_id, passage_idx, sentence_idx, unit_offset, text): the sentences of a
    passage, or the passage itself (sentence_idx is null) where it has none. A sentence
    without a text has the passage's from its offset to the next one's."""
    d = docs.select("path", "doc_id", F.posexplode("passage").alias("passage_idx", "p"))
    d = d.withColumn("_s", F.when(F.size("p.sentence") > 0, F.col("p.sentence")))
    d = d.select("path", "doc_id", "passage_idx", "p", F.col("_s").alias("all"), F.posexplode_outer("_s").alias("sentence_idx", "s"))
    end = F.coalesce(F.get("all", F.col("sentence_idx") + 1)["offset"], F.col("p.offset") + F.char_length("p.text"))
    cut = F.substring(F.col("p.text"), F.col("s.offset") - F.col("p.offset") + 1, end - F.col("s.offset"))
    text = F.when(F.col("sentence_idx").isNull(), F.col("p.text")).otherwise(F.coalesce("s.text", cut))
    return d.select("path", "doc_id", "passage_idx", "sentence_idx", F.coalesce("s.offset", "p.offset").alias("unit_offset"), text.alias("text")).where("length(text) > 0")


def recognized_spans(docs: DataFrame, recognizer: Recognizer) -> DataFrame:
    """(path, doc_id, start, end, label): spans of all units, from the document's start."""
    key = F.concat_ws("\u0001", "path", "doc_id", "passage_idx", "sentence_idx")
    u = text_units(docs).withColumn("unit", key)
    d = recognize(u.select("unit", "text"), recognizer, "unit").select("unit", "label", "start", "end")
    d = d.join(u.select("unit", "path", "doc_id", "unit_offset"), "unit")
    return d.select("path", "doc_id", *[(F.col(c) + F.col("unit_offset")).cast("int").alias(c) for c in ("start", "end")], "label")


def recognize_files(spark: SparkSession, inputs: list[str], output: str, recognizer: Recognizer, suffix: str = ".xml") -> list[str]:
    """The files with the recognised spans as their annotations, one file per input."""
    found = recognized_spans(bioc.read(spark, inputs), recognizer)
    return annotated.save_each(annotated.with_spans(annotated.files(spark, inputs), found), output, suffix)


def link_files(spark: SparkSession, inputs: list[str], output: str, ontology: DataFrame, keys: DataFrame | None = None, encoder=None, model: str = "model", scores: bool = False, suffix: str = ".normalized.xml", ranks: int = 1) -> tuple[list[str], DataFrame]:
    """The files with links in their annotations' infons, one file per input, and (path,
    matched, missing). Every distinct mention of a document is linked once; definitions
    come from the documents' own texts. ``ranks`` concepts of each are written."""
    docs = bioc.read(spark, inputs)
    found = annotated.mentions(docs)
    p = bioc.passages(docs).where(T.annotatable("infons"))
    key = F.expr(T.document_key("doc_id", "infons['article-id_pmid']", "infons['passage_id']"))
    defined = A.document_definitions(A.document_texts(p.select(key.alias("doc_key"), "passage_idx", "text")))
    if keys is None:
        keys = A.lookup(spark.createDataFrame([], "short_form string, identifier string, line long"))
    links = L.link(found.select("doc_key", F.col("normal").alias("mention")).distinct(), ontology, keys, defined, encoder, ranks=ranks)
    rows = annotated.with_links(annotated.files(spark, inputs), found, links, model, scores)
    done = annotated.save_each(rows.select("path", "xml"), output, suffix)
    return done, rows.select("path", "matched", "missing")


def annotate_files(spark: SparkSession, source: str, output: str, recognizer: Recognizer, ontology: DataFrame, keys: DataFrame | None = None, encoder=None, model: str = "model") -> list[str]:
    """A file or folder through recognition and linking: ``<stem>.normalized.xml`` each. The
    recognised files stay in ``output``/recognized."""
    between = recognize_files(spark, paths.xml_files(spark, source), f"{output}/recognized", recognizer)
    return link_files(spark, between, output, ontology, keys, encoder, model)[0]


def training_records(docs: DataFrame, policy: str = "last", rename: dict[str, str] = TRAIN_AS, without: tuple[str, ...] = TRAIN_WITHOUT) -> DataFrame:
    """(id, document_id, passage_id, passage_offset, text, entities) of passages with text:
    entities in order of the file, of the training types. ``error`` fails on entities that
    overlap, ``last`` keeps all of them; the last one owns what several cover. Ids are gapless in order
    of path, document and passage."""
    if policy not in ("last", "error"):
        raise ValueError(f"unknown policy {policy}")
    p = bioc.passages(docs)
    e = C.recode(bioc.entities(bioc.annotations(p)).withColumn("type", F.coalesce(F.col("infons")["type"], F.lit("Unknown"))), "type", rename, without)
    at = ["path", "doc_id", "passage_idx"]
    if policy == "error":
        w = Window.partitionBy(*at).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        e = e.withColumn("_reach", F.max("end").over(w))
        e = e.where(F.assert_true(F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True)), F.lit("entities overlap")).isNull())
    text = F.coalesce(F.when(F.col("text") != "", F.col("text")), "surface")
    entity = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("type").alias("label"), text.alias("text"))
    placed = F.array_sort(F.collect_list(F.struct("ann_idx", "loc_idx", entity.alias("e"))))
    own = e.groupBy(*at).agg(F.transform(placed, lambda x: x["e"]).alias("entities"))
    kind = own.schema["entities"].dataType
    d = p.select(*at, "passage_offset", "text").join(own, at, "left")
    d = d.withColumn("entities", F.coalesce("entities", F.array().cast(kind)))
    d = S.running_ids(d, at)
    return d.select("id", F.col("doc_id").alias("document_id"), F.col("passage_idx").alias("passage_id"), "passage_offset", "text", "entities")


def training_chunks(records: DataFrame, labels: DataFrame, mode: str = "expand", max_length: int = 512, overlap: int = 128) -> DataFrame:
    """(id, chunk, pos, start, end, tag, label_id): the tokens of every window of every
    record with their labels; labels: (label_id, label)."""
    e = records.select("id", F.posexplode("entities").alias("entity", "e")).select("id", "entity", "e.label", "e.start", "e.end")
    d = R.tagged_windows(S.tag_rows(S.token_rows(records, "id"), e, "id", mode), "id", max_length, overlap)
    d = d.select("id", "chunk", "first", F.posexplode("tokens").alias("_k", "_t")).select("id", "chunk", (F.col("first") + F.col("_k")).alias("pos"), "_t.start", "_t.end", "_t.tag")
    named = labels.select(F.col("label").alias("tag"), "label_id")
    return d.join(F.broadcast(named), "tag", "left").select("id", "chunk", "pos", "start", "end", "tag", "label_id")  # two labels a type


def prepare_training(spark: SparkSession, sources: list[str], split: str = "train.xml", policy: str = "last", mode: str = "expand", max_length: int = 512, overlap: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, label schema and labelled windows of a split's files."""
    records = training_records(bioc.read(spark, paths.split_files(spark, sources, split)), policy)
    labels = C.label_schema(records.select(F.explode("entities.label").alias("type")), "type")
    return records, labels, training_chunks(records, labels, mode, max_length, overlap)


def corpus_mentions(docs: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(concept, term, pos): the distinct spellings of each gold concept's mentions, in
    order of files; only of ``relations`` where they are given."""
    a = bioc.annotations(bioc.passages(docs, keep_empty=True))
    d = a.select("path", "doc_id", "passage_idx", "ann_idx", F.expr(T.squeeze("text")).alias("term"), F.explode(T.col(T.related_ids("infons['identifier']"))).alias("r"))
    d = d.select("path", "doc_id", "passage_idx", "ann_idx", "term", F.col("r")["0"].alias("relation"), F.col("r")["1"].alias("concept")).where("term <> ''")
    if relations:
        d = d.where(F.col("relation").isin(*relations))
    order = F.struct("path", "doc_id", "passage_idx", "ann_idx")
    once = d.groupBy("concept", F.lower("term").alias("folded")).agg(F.min_by("term", order).alias("term"), F.min(order).alias("o"))
    pos = F.row_number().over(Window.partitionBy("concept").orderBy("o", "folded")) - 1
    return once.select("concept", "term", pos.alias("pos"))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(path, n_docs, n_passages, n_chars, n_tokens, n_mentions) of documents as of
    ``bioc.read``: passages with text, and their annotations."""
    p = bioc.passages(docs)
    m = p.groupBy("path").agg(F.sum(F.coalesce(F.size("annotation"), F.lit(0)).cast("long")).alias("n_mentions"))
    return C.statistics(p, ["path"], "doc_id").join(m, "path")


def vocabulary_overlap(spark: SparkSession, corpora: dict[str, list[str]], ontology: DataFrame, without_vague: tuple[str, ...] = ("CellLink",)) -> DataFrame:
    """Per corpus: distinct surface forms of its annotations, how many are ontology names
    by their relaxed keys, percent."""
    aliases = files.relaxed_aliases(ontology)
    out = None
    for name, own in corpora.items():
        if not own:
            continue
        a = bioc.annotations(bioc.passages(bioc.read(spark, own), keep_empty=True))
        if name in without_vague:
            a = a.where(F.coalesce("type", F.lit("")) != annotated.VAGUE)
        # The compatibility form comes first: forms that differ without it are one.
        d = a.select(F.lit(name).alias("corpus"), nfkc("text").alias("text")).select("corpus", F.expr(T.squeeze("text")).alias("surface")).where("surface <> ''").distinct()
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no files in any corpus")
    keyed = out.withColumn("form", T.col(T.relaxed("surface")))
    hits = keyed.join(aliases.withColumn("_hit", F.lit(1)), "form", "left")
    d = hits.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_forms"), F.count("_hit").alias("n_matched"))
    return d.withColumn("percent", F.round(100 * F.col("n_matched") / F.col("n_forms"), 2))


def aligned_labels(own: list[str], model: dict[int, str] | None) -> list[str]:
    """The model's label order where it names the same labels and is no default
    (LABEL_0, ...); else the own order."""
    if not model:
        return own
    theirs = [model[k] for k in sorted(model, key=int)]
    default = [f"LABEL_{k}" for k in range(len(own))]
    return own if theirs == default or sorted(theirs) != sorted(own) else theirs


def effective_length(wanted: int | None, tokenizer: int | None, positions: int | None, fallback: int = 512, sane: int = 100_000) -> int:
    """Longest input: what is wanted, within the tokenizer's limit; else the least of the
    limits that make sense; else ``fallback``."""
    real = [x for x in (tokenizer, positions) if x and 0 < x < sane]
    if wanted is not None:
        return min(wanted, tokenizer) if tokenizer and 0 < tokenizer < sane else wanted
    return min(real, default=fallback)
