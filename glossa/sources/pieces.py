"""Annotated XML files that are larger than a task: read, edited and written by document.

A file is cut at the ends of its documents, by the text reader's own ranges, so a large file
is many tasks; what stands before a document (a collection's header, white space) goes with
it, and what follows the last one is a piece of its own. A document's text is edited where
its annotations stand and nowhere else, so all other bytes stay as they are. Numbers that run
through a file come from sums of its ranges. The pieces are written in order, one file per
input, by a task that streams them; white space after a file's end is left out.

Comments and quoted sections must not hold a document's end, and tags have no prefixes.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.sources import annotated

END = "</document>"
_PASSAGE = re.compile(r"<passage\b[^>]*>.*?</passage>", re.S)
_SENTENCE = re.compile(r"(<sentence\b[^>]*>.*?</sentence>)", re.S)
_OLD = re.compile(r"\s*<(annotation|relation)\b(?:[^>]*/>|.*?</\1>)", re.S)
_NOTE = re.compile(r"<annotation\b[^>]*>.*?</annotation>", re.S)
_ID = r"(?s)<document\b[^>]*>.*?<id>\s*(.*?)\s*</id>"


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, line, value): the pieces of files, without the documents' ends, in order."""
    d = spark.read.option("lineSep", END).text(paths)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def is_document() -> Column:
    return F.col("value").rlike(r"<document[\s>]")


def document_id() -> Column:
    return F.regexp_extract("value", _ID, 1)


def sums_before(d: DataFrame, value: str, out: str) -> DataFrame:
    """Rows (path, block, line, ...) with the sum of ``value`` over all rows of the file before
    them: ranges are summed alone, and their sums run over the few ranges of a file."""
    within = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = d.groupBy("path", "block").agg(F.sum(value).alias("_sum")).select("path", "block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    d = d.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0))).join(ranges, ["path", "block"])
    return d.withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _edit(value: str, passage: Callable[[str, ET.Element], str]) -> str:
    return _PASSAGE.sub(lambda m: passage(m[0], ET.fromstring(m[0])), value)


def cut_at_numbers(value: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """A document with its passages' annotations replaced by ``spans`` (start, end, label) that
    they hold, cut where the numbers of the new ones go; relations go."""
    mark = "\u0001"  # no character of XML

    def passage(text: str, p: ET.Element) -> str:
        offset, own = int((p.findtext("offset") or "0").strip() or 0), p.findtext("text") or ""
        kept = "".join(x if k % 2 else _OLD.sub("", x) for k, x in enumerate(_SENTENCE.split(text)))
        new = []
        for start, end, label in sorted(spans):
            if offset <= start < end <= offset + len(own):
                note = ET.Element("annotation", id="@")
                ET.SubElement(note, "infon", key="type").text = label
                ET.SubElement(note, "location", offset=str(start), length=str(end - start))
                ET.SubElement(note, "text").text = own[start - offset : end - offset]
                new.append(ET.tostring(note, encoding="unicode").replace('id="@"', f'id="{mark}"', 1))
        at = kept.rindex("</passage>")
        return kept[:at] + "".join(new) + kept[at:]

    return _edit(value, passage).split(mark)


def with_spans(d: DataFrame, spans: DataFrame) -> DataFrame:
    """Pieces with spans (path, doc_id, start, end, label) as their only annotations, numbered
    T1 to Tn through each file: (path, block, line, value, n_annotations)."""
    own = spans.groupBy("path", F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end", "label")).alias("found"))  # of one document
    own = own.withColumn("_id", F.col("_id").cast("string"))
    d = d.withColumn("_id", F.when(is_document(), document_id())).join(own, ["path", "_id"], "left")

    @F.pandas_udf("array<string>")
    def cut(value: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[v] if f is None or "<document" not in v else cut_at_numbers(v, [(x["start"], x["end"], x["label"]) for x in f]) for v, f in zip(value, found, strict=True)])

    none = F.array().cast(own.schema["found"].dataType)
    found = F.when(is_document(), F.coalesce("found", none))
    d = d.select("path", "block", "line", cut("value", found).alias("parts")).withColumn("n_annotations", (F.size("parts") - 1).cast("long"))
    d = sums_before(d, "n_annotations", "_first")
    value = F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("T"), (F.col("_first") + i).cast("string"), x))), "")
    return d.select("path", "block", "line", value.alias("value"), "n_annotations")


def put_links(value: str, links: list[dict], model: str, scores: bool = False, digits: int | None = None) -> tuple[str, int, int]:
    """A document with links as infons of its annotations, as ``annotated.put_links`` makes
    them, and the numbers of annotations with a link and without."""
    count = [0, 0]
    head = re.search(_ID, value)
    name = head[1] if head else ""

    def passage(text: str, p: ET.Element) -> str:
        def note(m: re.Match) -> str:
            one = ET.Element("collection")
            document = ET.SubElement(one, "document")
            ET.SubElement(document, "id").text = name
            own = ET.SubElement(document, "passage")
            own.extend([*p.findall("infon"), *p.findall("text"), ET.fromstring(m[0])])
            done, matched, missing = annotated.put_links(ET.tostring(one), links, model, scores, digits)
            count[0] += matched
            count[1] += missing
            if not matched:
                return m[0]
            old, new = m[0], ""
            for i in ET.fromstring(done).findall(".//annotation/infon"):
                key, line = i.get("key"), ET.tostring(i, encoding="unicode")
                pattern = rf'<infon key="{re.escape(key)}"\s*(?:/>|>.*?</infon>)'
                if not key.startswith(f"{model}_"):
                    continue
                if re.search(pattern, old, re.S):
                    old = re.sub(pattern, lambda _, line=line: line, old, count=1, flags=re.S)
                else:
                    new += line
            at = max(old.rfind("</infon>") + len("</infon>"), old.index(">") + 1) if "</infon>" in old else old.index(">") + 1
            return old[:at] + new + old[at:]

        return "".join(x if k % 2 else _NOTE.sub(note, x) for k, x in enumerate(_SENTENCE.split(text)))

    return _edit(value, passage), count[0], count[1]


def with_links(d: DataFrame, found: DataFrame, links: DataFrame, model: str = "model", scores: bool = False, digits: int | None = None) -> DataFrame:
    """Pieces with links (see ``annotated.with_links``; mentions and links of one document go
    to its own piece): (path, block, line, value, matched, missing)."""
    names, kinds = zip(*[x.split() for x in annotated.LINK.split(", ")], strict=True)
    have = links.select(*[(F.col(c) if c in links.columns else F.lit(None)).cast(k).alias(c) for c, k in zip(names, kinds, strict=True)]).withColumnRenamed("mention", "normal")
    own = found.join(have, ["doc_key", "normal"]).groupBy("path", F.col("doc_key").alias("_id")).agg(F.collect_list(F.struct(*names)).alias("found"))  # of one document
    d = d.withColumn("_id", F.when(is_document(), document_id())).join(own, ["path", "_id"], "left")

    @F.pandas_udf("struct<value: string, matched: long, missing: long>")
    def put(value: pd.Series, links: pd.Series) -> pd.DataFrame:
        rows = [put_links(v, [] if f is None else [x if isinstance(x, dict) else x.asDict(True) for x in f], model, scores, digits) for v, f in zip(value, links, strict=True)]
        return pd.DataFrame(rows, columns=["value", "matched", "missing"])

    return d.select("path", "block", "line", put("value", "found").alias("x")).select("path", "block", "line", "x.*")


def save(d: DataFrame, folder: str, suffix: str = ".xml") -> list[str]:
    """Write pieces as one file per input, in order, and return the files' paths."""
    # Every piece ends in the same character, which is the writer's line separator.
    whole = F.when(is_document(), F.concat("value", F.lit(END))).otherwise(F.regexp_replace("value", r"\s+$", ""))
    rows = d.select("path", "block", "line", whole.alias("xml")).where("endswith(xml, '>')").withColumn("xml", F.expr("left(xml, char_length(xml) - 1)"))
    return annotated.save_each(rows, folder, suffix, ">", ["block", "line"])

