"""Annotation of a stream of XML files, and linking of the mentions that a stream brings.

Batches are written as ``batch=<number>`` folders, so a batch that runs again after a failure
writes over its own rows. Documents need no state; mentions do: which ones were seen stays
in the state store of the second stream, so every distinct mention is linked once, in
whatever batch it first comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.recognize import Recognizer, recognize
from glossa.sources import bioc

SPANS = "doc_id string, passage_idx int, label string, start int, end int, n_tokens long, text string, mention string"


def _put(d: DataFrame, out: str, number: int) -> None:
    d.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, doc_id, passage), one row per document of new files."""
    x = spark.readStream.format("xml").option("rowTag", "document").option("ignoreSurroundingSpaces", "false").schema(bioc.DOCUMENT).load(folder)
    return x.select(F.col("_metadata.file_path").alias("path"), F.trim("id").alias("doc_id"), "passage")


def _spans(docs: DataFrame, recognizer: Recognizer) -> DataFrame:
    """Spans of documents as of SPANS; places count from the document's start."""
    p = bioc.passages(docs).withColumn("passage_id", F.concat_ws("|", "path", "doc_id", "passage_idx"))
    found = recognize(p.select("passage_id", "text"), recognizer)
    where = p.select("passage_id", "doc_id", "passage_idx", "passage_offset")
    d = found.join(where, "passage_id").withColumns({c: F.col(c) + F.col("passage_offset") for c in ("start", "end")})
    return d.withColumn("mention", T.col(T.normalize("text"))).select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in SPANS.split(", ")])


def annotate(docs: DataFrame, recognizer: Recognizer, links: DataFrame, out: str, checkpoint: str):
    """Recognise and link by surface form, one micro-batch of documents at a time. Returns the
    started query, which ends when all files are read. links: (term, identifier), terms in
    normal form."""

    def batch(d: DataFrame, number: int) -> None:
        found = _spans(d, recognizer).join(links, F.col("mention") == F.col("term"), "left").drop("term", "mention")
        _put(found, out, number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recognize_stream(docs: DataFrame, recognizer: Recognizer, out: str, checkpoint: str):
    """The recognised spans of a stream of documents, as of SPANS, to ``out``."""
    write = docs.writeStream.foreachBatch(lambda d, number: _put(_spans(d, recognizer), out, number))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def link_new(mentions: DataFrame, linker: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Link each distinct mention of a stream (mention) once: the state store keeps those that
    were seen, and ``linker`` gets only new ones, as a table (mention)."""
    new = mentions.select("mention").where("mention <> ''").dropDuplicates(["mention"])
    write = new.writeStream.foreachBatch(lambda d, number: _put(linker(d), out, number))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spans_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The stream of spans that ``recognize_stream`` writes."""
    reader = spark.readStream.schema(SPANS)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{folder.rstrip('/')}/batch=*")


def linked(spark: SparkSession, spans: str, links: str) -> DataFrame:
    """All spans so far with what their mentions are linked to."""
    return spark.read.schema(SPANS).parquet(f"{spans.rstrip('/')}/batch=*").join(spark.read.parquet(links).drop("batch"), "mention", "left")
