"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import table


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.bagminhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.sharding import shard_equal_texts

    return shard_equal_texts(table(spark, sf_dir, "documents"), 8)


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.webp import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.ctw import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.pii import BASE, digest, find_spans

    d = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = f"filter(spans, s -> s.kind < {len(BASE)})"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(BASE)]
    added = F.expr(f"cast(size(spans) - size({base}) as bigint)").alias("n_added")
    return d.select("doc_id", *counts, F.sha2(F.expr(digest(base)), 256).alias("base_sha256"), F.expr(digest("spans")).alias("spans"), added)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.mixing import mix, tempered_weights

    docs = table(spark, sf_dir, "documents")
    return mix(docs, tempered_weights(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.rff_quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.treaps import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.tiles import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op13_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.merging import branches, merge

    d = merge(branches(table(spark, sf_dir, "documents")))
    return d.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
