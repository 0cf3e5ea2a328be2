"""Helpers for Arrow-batched operators and their bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import crc_of_id

#: Bytes of text that one step of numpy works on; longer texts are a step of their own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch, or one row.
BATCH_BYTES = 32 << 20


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hold Arrow batches of this session to a number of rows and of bytes that fit a
    worker's memory, whatever the rows' size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    column = pa.compute.fill_null(column, "") if column.null_count else column
    wide = column.type in (pa.large_string(), pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and offsets; nulls are empty."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, fold: int = 5) -> DataFrame:
    """(text, label) of the ``rows`` training documents (crc32 of the id, by ``fold``, is
    not 0) that are first by a hash of the id: the documented bound of what is fitted on.
    Labels that are not 0 or 1 do not count, repeated labels of an id count once, and of
    several documents of one id the one with the least digest of its text counts."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and _id is not null").groupBy("_id").agg(F.max("label").alias("label"))
    known = known.where(crc_of_id("_id") % fold != 0)
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most `rows` ids: their size is bounded. Combined before the shuffle, so an id on very many rows sends one a task.
    own = d.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("b"))
    return own.select("b.text", "b.label")


def held_out(fold: int = 5):
    return (crc_of_id("doc_id") % fold == 0).alias("held_out")
