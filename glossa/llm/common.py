"""Shared pieces: reading tables, cutting lineage, gapless numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where none is set, a folder in the
    warehouse, which all executors share too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/glossa-frozen"
    return found.rstrip("/")


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost
    executors, and fixes values that a recomputation could change. ``drop_frozen`` it when
    nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._frozen = path
    return out


def drop_frozen(*frames: DataFrame) -> None:
    """Delete the files under frozen tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._frozen)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def positions(df: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Number rows gaplessly from 0 within ``group``: buckets in ascending order, rows
    of a bucket by ``order``. Only a bucket meets in one task, so the caller chooses
    buckets of bounded size. The offsets, one row per group and bucket, join on the key by
    which the rows lie already; Spark broadcasts them only where they turn out small."""
    key = F.struct(*group, bucket)  # fields of a struct compare with nulls equal
    sizes = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key.alias("_key_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order)).cast("long")
    joined = df.withColumn("_key", key).withColumn("_rank", rank).join(offsets, F.col("_key") == F.col("_key_of"))
    return joined.withColumn(out, F.col("_offset") + F.col("_rank") - 1).drop("_rank", "_offset", "_key", "_key_of")


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """``left`` joined to ``right`` (one row per ``key``; ``rows`` tells how many rows of
    ``left`` have it). Keys with 1 / ``share`` of all rows or more, of which there are at
    most ``share``, are broadcast, so that a hot key stays spread; the others shuffle."""
    add = [c for c in right.columns if c != key]
    r = right.select(F.col(key).alias("_k"), *add)
    hot = F.broadcast(r.where(F.col(rows) * share >= total).withColumn("_hot", F.lit(True)))
    first = left.join(hot, F.col(key) == F.col("_k"), "left")
    done = first.where("_hot").drop("_k", "_hot")
    rest = first.where("_hot is null").drop("_k", "_hot", *add)
    cold = r.where(F.col(rows) * share < total)
    return done.unionByName(rest.join(cold, F.col(key) == F.col("_k"), how).drop("_k").select(*done.columns))
