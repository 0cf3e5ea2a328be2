"""Passage-structured XML: reading to flat frames, writing back with offsets kept.

The schema is fixed, never inferred. Offsets are code points from the document's start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INFON = "array<struct<_key:string,_VALUE:string>>"
_NOTE = f"array<struct<_id:string,infon:{_INFON},location:array<struct<_offset:int,_length:int>>,text:string>>"
DOCUMENT = f"id string, infon {_INFON}, passage array<struct<infon:{_INFON},offset:int,text:string,sentence:array<struct<offset:int,text:string,annotation:{_NOTE}>>,annotation:{_NOTE}>>"


def infons(x: str) -> str:
    """SQL: key-value elements to a map; the last of equal keys counts."""
    last = f"map_from_entries(transform(array_distinct(transform({x}, i -> i._key)), k -> struct(k, element_at(filter({x}, i -> i._key = k), -1)._VALUE)))"
    return f"if({x} is null, map(), {last})"


def read(spark: SparkSession, path: str | list[str], names: str = "*") -> DataFrame:
    """(path, doc_id, passage): one row per document. Prefixes of tags within it do not count. Of
    a folder only files whose names match ``names`` count; a folder takes one listing, a list
    of paths one for each of them."""
    x = spark.read.format("xml").option("pathGlobFilter", names).option("rowTag", "document").option("ignoreSurroundingSpaces", "false").option("ignoreNamespace", "true").schema(DOCUMENT).load(path)
    return x.select(F.col("_metadata.file_path").alias("path"), F.trim("id").alias("doc_id"), "passage")


def header(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, date, key) of each file's collection."""
    x = spark.read.format("xml").option("rowTag", "collection").schema("source string, date string, key string").load(path)
    return x.select(F.col("_metadata.file_path").alias("path"), "source", "date", "key")


def passages(docs: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(path, doc_id, passage_idx, passage_offset, text, infons, annotation)."""
    d = docs.select("path", "doc_id", F.posexplode("passage").alias("passage_idx", "p"))
    d = d.select("path", "doc_id", "passage_idx", F.col("p.offset").alias("passage_offset"), F.col("p.text").alias("text"), F.expr(infons("p.infon")).alias("infons"), F.col("p.annotation").alias("annotation"))
    return d if keep_empty else d.where("length(text) > 0")


def annotations(p: DataFrame) -> DataFrame:
    """One row per annotation: ann_id, infons, type, locations (offset, length), text."""
    d = p.select("path", "doc_id", "passage_idx", "passage_offset", F.col("text").alias("passage_text"), F.posexplode("annotation").alias("ann_idx", "a"))
    d = d.select("path", "doc_id", "passage_idx", "passage_offset", "passage_text", "ann_idx", F.col("a._id").alias("ann_id"), F.expr(infons("a.infon")).alias("infons"), F.col("a.infon").alias("_infons"), F.expr("transform(a.location, l -> named_struct('offset', l._offset, 'length', l._length))").alias("locations"), F.col("a.text").alias("text"))
    return d.withColumn("type", F.expr(first_type("_infons"))).drop("_infons")


#: Keys of an annotation's type.
TYPE_KEYS = ("type", "semantic_type", "entity_type")


def first_type(x: str) -> str:
    """SQL: the value of the first infon, in order of the file, whose key in any case is one
    of the type's and whose value is not blank."""
    known = ", ".join(f"'{k}'" for k in TYPE_KEYS)
    return f"get(transform(filter({x}, i -> lower(trim(i._key)) in ({known}) and trim(i._VALUE) <> ''), i -> trim(i._VALUE)), 0)"


def entities(a: DataFrame) -> DataFrame:
    """One row per location that has a length and lies within its passage, ids ann:loc."""
    d = a.select("*", F.posexplode("locations").alias("loc_idx", "l"))
    d = d.withColumn("start", F.expr("l.offset - passage_offset")).withColumn("end", F.expr("l.offset - passage_offset + l.length"))
    d = d.where("l.length > 0 and start >= 0 and end <= char_length(passage_text)")
    return d.withColumn("entity_id", F.concat_ws(":", "ann_id", "loc_idx")).withColumn("surface", F.expr("substring(passage_text, start + 1, end - start)")).drop("l")


def text_of_locations(text: str, offset: str, locations: str) -> str:
    """SQL: what a passage's text has at the locations, in order of offset, joined by blanks."""
    return f"array_join(transform(array_sort({locations}), l -> substring({text}, l.offset - {offset} + 1, l.length)), ' ')"


def spans_of(a: DataFrame) -> DataFrame:
    """Annotations as spans of one or more locations, with ``locations`` sorted: those with a
    type, with all locations of some length and within the passage; an annotation without a
    location fails. ``text`` is the annotation's own, else that of its locations."""
    some = F.assert_true(F.coalesce(F.size("locations"), F.lit(0)) > 0, F.lit("an annotation has no location"))
    d = a.where("infons['type'] is not null").where(some.isNull())
    inside = "forall(locations, l -> l.length > 0 and l.offset >= passage_offset and l.offset + l.length <= passage_offset + char_length(passage_text))"
    d = d.where(inside).withColumn("locations", F.array_sort("locations")).withColumn("type", F.expr("infons['type']"))
    return d.withColumn("text", F.expr(f"coalesce(nullif(text, ''), {text_of_locations('passage_text', 'passage_offset', 'locations')})"))


def stem(name: str) -> str:
    """SQL: a file's name without .bioc.xml or .xml."""
    return f"regexp_replace({name}, '(\\\\.bioc)?\\\\.xml$', '')"
