"""The corpus pipeline: stages over ``documents``, each on all that the one before kept.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's rows to the shared
folder and rereads them for the next one.

Defined cases: empty tables pass through all stages; null texts count as empty; rows with
equal ids are separate rows, except that near-duplicates keep one row of each class; very
long texts are processed whole; ties go as each stage's operator states; names of further
columns may clash with those used here, as each stage carries the row in one struct.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bagminhash, mixing, packing, pii, rff_quality
from glossa.llm.common import drop_frozen, freeze, table

#: Rows with a quality score below this go.
MIN_QUALITY = 0.3
#: Pieces of a range of the mixed order that are packed together.
RANGE_ROWS = 10_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    model = rff_quality.fit(docs, table(spark, sf_dir, "labels"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = rff_quality.score(docs.select(row, "text"), model, ["_row"])
    return scored.where(F.col("score") >= MIN_QUALITY).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return bagminhash.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order of their sources, in files of consecutive ranges.
    ``docs`` is read twice and numbered by its rows' order, so it is to be a table read from
    files (or any frame that gives its rows in one order)."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    rows = docs.select(row, F.col("source").alias("_source"), F.monotonically_increasing_id().alias("_id"))
    order = mixing.mix(rows.select("_id", "_source"), mixing.tempered_weights(rows, "_source"), "_source", "_id")
    placed = rows.hint("merge").join(order.select(F.col("doc_id").alias("_id"), "position"), "_id")
    # No sort in one task: ranges of positions, each sorted.
    placed = placed.repartitionByRange("position").sortWithinPartitions("position")
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in names])


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and _place: the row's number from 0 in the order in which ``docs`` was
    written, by file name and row (readers deal files by size); else, of its partitions."""
    try:
        d = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_place"))
    files = sorted((r[0], r[1]) for r in d.groupBy("_file").agg(F.max("_row")).collect())  # one row per file
    if not files:
        return d.select("doc_id", "text", "_row").withColumnRenamed("_row", "_place")
    starts = [0, *accumulate(n + 1 for _, n in files)]
    begin = docs.sparkSession.createDataFrame([(f, at) for (f, _), at in zip(files, starts, strict=False)], "_name string, _start long")
    return d.join(F.broadcast(begin), F.col("_file") == F.col("_name")).select("doc_id", "text", (F.col("_start") + F.col("_row")).alias("_place"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed from consecutive ranges of the mixed order, with
    the sequence's ``position`` along it; see glossa.llm.packing."""
    return packing.pack_in_order(_in_order(docs), "_place", part_rows=RANGE_ROWS)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("pii", private),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
        if last is not None:
            drop_frozen(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
