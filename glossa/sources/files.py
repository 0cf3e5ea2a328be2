"""Text, table and JSON sources and sinks around the XML source."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.udfs import flatten_synonyms, nfkc

# The header of an abbreviation table.
ABBREVIATION_HEADER = ("short_form", "matched_cl_id")
# Alternative names of ontology fields, the first present one counts.
FIELDS = {
    "concept_id": ("norm_concept_id", "concept_id", "id", "obo_id", "identifier"),
    "preferred_label": ("norm_preferred_label", "preferred_label", "label", "name", "prefLabel"),
    "synonyms": ("synonyms", "synonym", "aliases", "alias", "alt_labels"),
}
# Marks of concepts that are no longer used; any one rules a concept out.
OBSOLETE = ("obsolete", "is_obsolete", "deprecated")
PASSAGE = "id bigint, document_id string, passage_id int, passage_offset int, text string, entities array<struct<start:int,end:int,label:string,text:string>>"


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, preferred_label, synonyms, namespace, record) of JSON lines; records are
    numbered in order of the file; a malformed line fails."""
    d = spark.read.schema("norm_concept_id string, norm_preferred_label string, synonyms array<string>, namespace string").option("mode", "FAILFAST").json(path)
    return d.select(F.col("norm_concept_id").alias("concept_id"), F.col("norm_preferred_label").alias("preferred_label"), "synonyms", "namespace", F.monotonically_increasing_id().alias("record")).where("coalesce(concept_id, '') <> '' and coalesce(preferred_label, '') <> ''")


def split_json(text: str) -> list[str]:
    """The records of JSON lines, of one array, or of objects one after the other."""
    out, at, reader = [], 0, json.JSONDecoder()
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text):
            return out
        value, at = reader.raw_decode(text, at)
        out += [json.dumps(v) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]


def is_object(text: str) -> bool:
    """Whether a text is one JSON object and no more."""
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def cut_line(line: str, depth: int, base: int) -> list[tuple[bool, str]]:
    """The pieces of a line that begins ``depth`` brackets deep, cut after every closing bracket
    that leads back to ``base``; whether a piece begins there."""
    out, begin, fresh, quoted, skip = [], 0, depth <= base, False, False
    for i, c in enumerate(line):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == base:
                out.append((fresh, line[begin : i + 1]))
                begin, fresh = i + 1, True
    if not fresh or line[begin:].strip(" \t\r,]"):
        out.append((fresh, line[begin:]))
    return out


#: SQL: a line without its strings, and the brackets that it opens more than it closes.
_BARE = r"""regexp_replace(value, '"(?:[^"\\\\]|\\\\.)*"', '')"""
_DEPTH = "char_length(regexp_replace(_bare, '[^\\\\[{]', '')) - char_length(regexp_replace(_bare, '[^\\\\]}]', ''))"


def _over_lines(spark: SparkSession, odd: DataFrame) -> DataFrame:
    """(path, r): the records of files whose lines are no whole objects. odd: (path).

    A line never begins inside a string, so its depth in brackets is the sum of what all
    lines before it open: ranges of a file are summed alone, their sums run over the file's
    few ranges, and lines run within their range. A piece at the files' base depth (1 where
    the file is an array) begins a record; a record's pieces meet by the place where it
    begins, wherever the ranges' seams lie, so no file is one task."""
    paths = [r.path for r in odd.collect()]  # one row per odd file
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(paths).select(*meta, F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^\ufeff", "").alias("value")).where("trim(value) <> ''")
    lines = lines.withColumn("_bare", F.expr(_BARE)).withColumn("_opens", F.expr(_DEPTH))
    within = Window.partitionBy("path", "block").orderBy("line")
    lines = lines.withColumn("_inside", F.sum("_opens").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = lines.groupBy("path", "block").agg(F.sum("_opens").alias("sum"), F.min_by("_bare", "line").alias("first"))
    over = Window.partitionBy("path").orderBy("block")  # one row per range of a file
    ranges = ranges.withColumn("before", F.coalesce(F.sum("sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("base", F.startswith(F.trim(F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), F.lit("[")).cast("int"))
    d = lines.join(ranges.select("path", "block", "before", "base"), ["path", "block"])
    d = d.select("path", "block", "line", "value", "base", (F.col("before") + F.coalesce("_inside", F.lit(0))).cast("int").alias("depth"))

    @F.pandas_udf("array<struct<fresh: boolean, text: string>>")
    def pieces(value: pd.Series, depth: pd.Series, base: pd.Series) -> pd.Series:
        cut = lambda v, k, b: [{"fresh": f, "text": t} for f, t in cut_line(v[v.index("[") + 1 :] if b and k == 0 and "[" in v else v, k if not (b and k == 0) else 1, b)]
        return pd.Series([cut(*x) for x in zip(value, depth, base, strict=True)])

    d = d.select("path", "block", "line", F.posexplode(pieces("value", "depth", "base")).alias("n", "p")).select("path", "block", "line", "n", "p.fresh", "p.text")
    own = F.when(F.col("fresh"), F.struct("block", "line", "n"))
    here = F.last(own, True).over(Window.partitionBy("path", "block").orderBy("line", "n").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_begin", here)
    last = d.where("fresh").groupBy("path", "block").agg(F.max(F.struct("block", "line", "n")).alias("_last"))
    seams = d.select("path", "block").distinct().join(last, ["path", "block"], "left").withColumn("_before", F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1))).select("path", "block", "_before")
    d = d.join(seams, ["path", "block"]).withColumn("_begin", F.coalesce("_begin", "_before"))
    one = F.sort_array(F.collect_list(F.struct("block", "line", "n", "text")))  # of one record
    whole = d.groupBy("path", "_begin").agg(F.array_join(F.transform(one, lambda x: x["text"]), "\n").alias("value"))

    @F.pandas_udf("array<string>")
    def records(x: pd.Series) -> pd.Series:
        return x.map(lambda t: split_json(t.strip(" \t\r\n,")))

    return whole.select("path", F.explode(records("value")).alias("r"))


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, r): the JSON records of lines, of arrays, or of objects one after the other.

    Lines are read as lines, so a large file is many tasks. Only files of which some line is
    no whole object (arrays, or objects over several lines) are put together from their
    lines' depths, also as many tasks. A file that is no JSON fails."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("r")).where("r <> ''")

    @F.pandas_udf("boolean")
    def whole(x: pd.Series) -> pd.Series:
        return x.map(is_object)

    odd = lines.where(~whole("r")).select("path").distinct()
    names = [x.path for x in odd.collect()]  # one row per odd file
    if not names:
        return lines
    return lines.where(~F.col("path").isin(names)).union(_over_lines(spark, spark.createDataFrame([(n,) for n in names], "path string")))


def _present(names: tuple[str, ...]) -> Column:
    """The first field that is not null, empty text or an empty list."""
    found = [F.get_json_object("r", f"$.{n}") for n in names]
    return F.coalesce(*[F.when(~f.isin("", "[]"), f) for f in found])


def tolerant_ontology(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(concept_id, preferred_label, synonyms) under any of the known field names, without
    obsolete concepts and without ids that are not CL ids. A concept without a label keeps
    its synonyms; its label is null."""
    d = json_records(spark, path)
    mark = lambda n: F.coalesce(~F.lower(F.get_json_object("r", f"$.{n}")).isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))
    d = d.where(~(mark(OBSOLETE[0]) | mark(OBSOLETE[1]) | mark(OBSOLETE[2]))).select(*[_present(names).alias(k) for k, names in FIELDS.items()])
    d = d.withColumn("concept_id", F.get(T.col(T.ontology_ids("concept_id")), F.lit(0))).where("concept_id is not null")
    label = F.expr(T.squeeze("preferred_label"))
    return d.select("concept_id", F.when(label != "", label).alias("preferred_label"), flatten_synonyms("synonyms").alias("synonyms"))


def relaxed_aliases(ontology: DataFrame) -> DataFrame:
    """(form): the distinct relaxed keys of all labels and synonyms."""
    names = ontology.select(F.explode(F.concat(F.array("preferred_label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    return names.select(nfkc("name").alias("name")).select(T.col(T.relaxed("name")).alias("form")).where("form <> ''").distinct()


def is_abbreviation_table(spark: SparkSession, path: str) -> bool:
    """A .tsv file, or folder of files in order of their names, whose first line that is not
    empty begins with the known header."""
    if not path.lower().endswith(".tsv"):
        return False
    first = spark.read.text(sorted(spark.read.text(path).inputFiles())[:1] or path).where("trim(value) <> ''").head()  # the first rows only
    return first is not None and tuple(x.strip() for x in first[0].lstrip("\ufeff").split("\t")[:2]) == ABBREVIATION_HEADER


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, short_form, identifier) of a tab-separated table, which must pass
    ``is_abbreviation_table``; rows without both fields go, and of several ids the first
    one counts."""
    if not is_abbreviation_table(spark, path):
        raise ValueError(f"no abbreviation table: {path}")
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("f"))
    d = d.where(F.size("f") >= 2).select("path", "line", F.trim(F.col("f")[0]).alias("short_form"), F.trim(F.split(F.col("f")[1], "[,;]")[0]).alias("identifier"))
    return d.where((F.col("short_form") != "") & (F.regexp_replace("short_form", "\ufeff", "") != ABBREVIATION_HEADER[0])).where(~F.col("identifier").isin("", "-", "None", "none"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(concept, name): the names of ``concept||left||right`` lines; a bad line fails."""
    d = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\|\|", 3).alias("f"), "value")
    d = d.where(F.assert_true(F.size("f") == 3, F.concat(F.lit("not a pair: "), "value")).isNull())
    return d.select(F.col("f")[0].alias("concept"), F.explode(F.array(F.trim(F.col("f")[1]), F.trim(F.col("f")[2]))).alias("name")).where("name <> ''").distinct()


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Passage records of JSON lines; missing entities are an empty list."""
    d = spark.read.schema(PASSAGE).json(path)
    return d.withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,label:string,text:string>>")))


def parse_entities(x: str = "entities") -> Column:
    """A JSON string of entities as a typed list; null is empty, a missing bound fails."""
    kind = "array<struct<start:int,end:int,label:string,text:string>>"
    d = F.coalesce(F.from_json(x, kind), F.array().cast(kind))
    ok = F.forall(d, lambda e: e["start"].isNotNull() & e["end"].isNotNull() & e["label"].isNotNull())
    return F.when(F.assert_true(ok, F.lit("an entity lacks a field")).isNull(), d)


def write_dictionary(terms: DataFrame, path: str) -> None:
    """term, tab, concept per line."""
    terms.select(F.concat_ws("\t", "term", "concept").alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A data set by its file's extension: json and jsonl, csv with a header, parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("json", "jsonl"):
        first = spark.read.text(path).where("trim(value) <> ''").head()
        return reader.option("multiLine", str(bool(first and first[0].lstrip().startswith("["))).lower()).json(path)
    if kind == "csv":
        return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown kind of data set: {path}")


def infer_columns(columns: list[str], text: str | None = None, entities: str | None = None) -> dict[str, str | None]:
    """Which columns hold what: by name, and else the first one holds the text."""
    known = lambda name: name if name in columns else None
    found = {"text": text or known("text") or columns[0], "entities": entities or known("entities")}
    return found | {"document_id": known("document_id"), "passage_id": known("passage_id"), "passage_offset": known("passage_offset"), "record_id": known("id")}


def limit_rows(d: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first rows in a total order, all without a limit (the limit is the feature)."""
    return d if limit is None else d.orderBy(*order).limit(limit)


def write_predictions(predictions: DataFrame, folder: str) -> None:
    """Predictions as JSON lines (``folder``/lines) and as one JSON array per part
    (``folder``/array; a part without rows may be empty): id, text, passage_offset, document_id, passage_id and
    predicted_entities (label, start_local, end_local, start, end, text)."""
    entity = "array<struct<label:string,start_local:int,end_local:int,start:int,end:int,text:string>>"
    d = predictions.select("id", "text", "passage_offset", "document_id", "passage_id", F.coalesce(F.col("predicted_entities").cast(entity), F.array().cast(entity)).alias("predicted_entities"))
    d.write.mode("overwrite").json(f"{folder}/lines")

    def array(batches):
        lead = "["
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": [lead + ",\n".join(batch["value"])]})
                lead = ","
        yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})

    one = d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(array, "value string")
    one.write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/array")


def predicted_entities(predictions: DataFrame) -> DataFrame:
    """(document_id, label, start, end): one row per predicted entity."""
    d = predictions.select(F.coalesce(F.col("document_id").cast("string"), F.lit("")).alias("document_id"), F.explode("predicted_entities").alias("e"))
    return d.select("document_id", F.col("e.label").cast("string").alias("label"), F.col("e.start").cast("int").alias("start"), F.col("e.end").cast("int").alias("end"))


def write_manifest(spark: SparkSession, facts: dict, path: str) -> None:
    """Facts of a run as one indented JSON file, through the path's own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(facts, indent=2, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
