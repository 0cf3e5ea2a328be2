"""Annotated XML files: spans and links written into a file's own structure, one file each.

A file is one row, so its header, document infons, sentences and what else it holds stay as
they are. Files are edited where they lie, by the tasks that read them; only names pass the
driver. A file must fit in a task's memory, which is the format's own unit.
"""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.spans import bounded_batches, slices
from glossa.sources import bioc

#: Files that a step in Python holds as objects.
STEP = 16

#: Annotations of this type are neither linked nor counted.
VAGUE = "cell_vague"
LINK = "doc_key string, mention string, identifier string, name string, final_score double, expanded_long_form string, definition_method string, definition_key string, definition_score double, hits array<struct<identifier:string,name:string,embedding_score:double,score:double>>"


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content): one row per file."""
    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")


def documents(rows: DataFrame, text: str = "content") -> DataFrame:
    """Files (path, content or xml) to (path, doc_id, passage), as ``bioc.read`` gives."""
    kind = f"document array<struct<{', '.join(re.sub('^(id|infon|passage) ', lambda m: m[1] + ': ', x) for x in re.split(r', (?=infon |passage )', bioc.DOCUMENT))}>>"
    d = rows.select("path", F.from_xml(F.col(text).cast("string"), F.lit(kind), {"ignoreSurroundingSpaces": "false", "ignoreNamespace": "true"}).alias("c"))
    return d.select("path", F.explode("c.document").alias("d")).select("path", F.trim("d.id").alias("doc_id"), "d.passage")


def _parse(content: bytes) -> tuple[str, ET.Element]:
    """What stands before the root element, and the root."""
    root = ET.fromstring(content)
    head = re.match(rb"(?:\s*<[?!][^>]*>)*\s*", content)
    return head[0].decode("utf-8", "replace"), root


def _text(head: str, root: ET.Element) -> str:
    return head + ET.tostring(root, encoding="unicode")


def _infons(e: ET.Element) -> dict[str, ET.Element]:
    return {i.get("key"): i for i in e.findall("infon")}


def _passages(document: ET.Element):
    """(passage, offset, text) of a document."""
    for p in document.findall("passage"):
        yield p, int((p.findtext("offset") or "0").strip() or 0), p.findtext("text") or ""


def put_spans(content: bytes, spans: list[dict]) -> tuple[str, int]:
    """The file with ``spans`` (doc_id, start, end, label) as its passages' only annotations,
    T1 to Tn, without the passages' relations; spans that no passage holds whole go."""
    head, root = _parse(content)
    own: dict[str, list] = {}
    for s in spans:
        own.setdefault(s["doc_id"], []).append((int(s["start"]), int(s["end"]), s["label"]))
    n = 0
    for document in root.iter("document"):
        found = sorted(own.get((document.findtext("id") or "").strip(), []))
        for passage, offset, text in _passages(document):
            for old in [*passage.findall("annotation"), *passage.findall("relation")]:
                passage.remove(old)
            for start, end, label in found:
                if not offset <= start < end <= offset + len(text):
                    continue
                n += 1
                note = ET.SubElement(passage, "annotation", id=f"T{n}")
                ET.SubElement(note, "infon", key="type").text = label
                ET.SubElement(note, "location", offset=str(start), length=str(end - start))
                ET.SubElement(note, "text").text = text[start - offset : end - offset]
    return _text(head, root), n


def put_links(content: bytes, links: list[dict], model: str, scores: bool = False, digits: int | None = None) -> tuple[str, int, int]:
    """The file with the links (as of LINK; ``mention`` is the annotation's own text) as
    infons of its annotations, a set for each rank of their hits; the numbers of
    annotations with a link and without. Scores have ``digits`` decimals, or all."""
    shown = lambda x: x if digits is None or x is None else f"{x:.{digits}f}"
    head, root = _parse(content)
    known = {(x["doc_key"], x["mention"]): x for x in links}
    matched = missing = 0
    for document in root.iter("document"):
        doc_id = (document.findtext("id") or "").strip()
        for passage, _, text in _passages(document):
            infons = _infons(passage)
            mark = infons.get("annotatable")
            if not text or (mark is not None and not mark.text):
                continue
            of = lambda k, infons=infons: (infons[k].text or "") if k in infons else ""
            key = doc_id or of("article-id_pmid") or of("passage_id")
            for note in passage.findall("annotation"):
                own = _infons(note)
                if "type" in own and own["type"].text == VAGUE:
                    continue
                best = known.get((key, note.findtext("text") or ""))
                if best is None or not best["identifier"]:
                    missing += 1
                    continue
                matched += 1
                new, hits = {}, best.get("hits")
                for rank, hit in enumerate([{**best, "score": best["final_score"]}] if hits is None else hits):
                    new[f"{model}_id_{rank}"], new[f"{model}_identifier_name_{rank}"] = hit["identifier"], hit["name"]
                    if scores:
                        new[f"{model}_identifier_score_{rank}"] = shown(hit["score"])
                new[f"{model}_expanded_long_form"] = best["expanded_long_form"]
                new[f"{model}_ab3p_method"] = best["definition_method"]
                new[f"{model}_ab3p_matched_key"] = best["definition_key"]
                new[f"{model}_ab3p_match_score"] = best["definition_score"]
                for k, v in new.items():
                    if v is None or v != v:
                        continue
                    if k not in own:
                        own[k] = ET.Element("infon", key=k)
                        note.insert(len(note.findall("infon")), own[k])
                    own[k].text = str(v)
    return _text(head, root), matched, missing


def concatenate(rows: DataFrame) -> DataFrame:
    """Files (path, content) as one collection: (place, path, n, value), to be written in that
    order. Place 0 is the head and header of the first file by path, 1 a document each, 2
    the end."""
    first = rows.orderBy("path").limit(1)  # the header's file

    def head(batches):
        for b in batches:
            out = []
            for c in b["content"]:
                before, root = _parse(c)
                for document in root.findall("document"):
                    root.remove(document)
                root.text, root.tail = root.text or "", None
                text = ET.tostring(root, encoding="unicode", short_empty_elements=False)
                out.append(before + text[: text.rindex("</")].rstrip())
            yield pd.DataFrame({"place": "0", "path": b["path"], "n": 0, "value": out})

    def each(batches):
        for b in batches:
            for path, c in zip(b["path"], b["content"], strict=True):
                values = []
                for document in _parse(c)[1].findall("document"):
                    document.tail = None
                    values.append(ET.tostring(document, encoding="unicode"))
                yield pd.DataFrame({"place": "1", "path": path, "n": range(len(values)), "value": values})

    kind = "place string, path string, n long, value string"
    end = first.select(F.lit("2").alias("place"), "path", F.lit(0).cast("long").alias("n"), F.lit("</collection>").alias("value"))
    return first.mapInPandas(head, kind).union(rows.mapInPandas(each, kind)).union(end)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Files (path, content) and spans (path, doc_id, start, end, label) to (path, xml,
    n_annotations)."""
    own = spans.groupBy("path").agg(F.collect_list(F.struct("doc_id", "start", "end", "label")).alias("found"))  # of one file
    d = rows.join(own, "path", "left").select("path", "content", F.coalesce("found", F.array().cast(own.schema["found"].dataType)).alias("found"))

    bounded_batches(rows.sparkSession)

    def run(batches):
        for b in slices(batches, STEP):
            done = [put_spans(c, f) for c, f in zip(b["content"].to_pylist(), b["found"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["path"], pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "xml", "n_annotations"])

    return d.mapInArrow(run, "path string, xml string, n_annotations long")


def mentions(rows: DataFrame) -> DataFrame:
    """(path, doc_key, mention, normal): distinct annotation texts of documents read by
    ``bioc.read``, in annotatable passages with a text and not vague, with the plural-
    normalised text that is linked."""
    p = bioc.passages(rows).where(T.annotatable("infons"))
    key = T.document_key("doc_id", "infons['article-id_pmid']", "infons['passage_id']")
    p = p.withColumn("doc_key", F.expr(key))
    a = bioc.annotations(p.withColumn("doc_id", F.col("doc_key")))
    a = a.where(F.coalesce(F.col("infons")["type"], F.lit("")) != VAGUE)
    raw = F.coalesce("text", F.lit(""))
    return a.select("path", F.col("doc_id").alias("doc_key"), raw.alias("mention")).distinct().withColumn("normal", T.col(T.plural_normalize("mention")))


def with_links(rows: DataFrame, found: DataFrame, links: DataFrame, model: str = "model", scores: bool = False, digits: int | None = None) -> DataFrame:
    """Files (path, content), their mentions and links (doc_key, mention: the normalised
    text, and more, as of ``linking.link``; ``hits`` hold all ranks) to (path, xml, matched,
    missing)."""
    names, kinds = zip(*[x.split() for x in LINK.split(", ")], strict=True)
    have = links.select(*[(F.col(c) if c in links.columns else F.lit(None)).cast(k).alias(c) for c, k in zip(names, kinds, strict=True)]).withColumnRenamed("mention", "normal")
    each = found.join(have, ["doc_key", "normal"]).groupBy("path").agg(F.collect_list(F.struct(*names)).alias("found"))  # of one file
    d = rows.join(each, "path", "left").select("path", "content", F.coalesce("found", F.array().cast(each.schema["found"].dataType)).alias("found"))

    bounded_batches(rows.sparkSession)

    def run(batches):
        for b in slices(batches, STEP):
            done = [put_links(c, f, model, scores, digits) for c, f in zip(b["content"].to_pylist(), b["found"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["path"], *[pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]], ["path", "xml", "matched", "missing"])

    return d.mapInArrow(run, "path string, xml string, matched long, missing long")


def save_each(rows: DataFrame, folder: str, suffix: str = ".normalized.xml", line_sep: str = "\n", order: list[str] | None = None) -> list[str]:
    """Write (path, xml) as one file per input, ``<stem><suffix>``. Tasks write the files;
    the driver only moves them to their names. Two inputs of one stem are an error. With
    ``order`` an input is many rows, and one task writes them one after the other."""
    spark = rows.sparkSession
    name = F.concat(F.expr(bioc.stem("element_at(split(path, '/'), -1)")), F.lit(suffix))
    fs_of = lambda p: (spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(p))
    fs, stage = fs_of(f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}")
    named = rows.withColumn("name", name)
    if order:
        one = named.select("name", "path").distinct().groupBy("name").count().where("count > 1").take(1)
        if one:
            raise ValueError(f"several inputs are named {one[0].name}")
        named = named.repartition("name").sortWithinPartitions("name", *order)
    named.select("name", F.col("xml").alias("value")).write.partitionBy("name").option("lineSep", line_sep).text(stage.toString())
    out, done = [], set()
    try:
        # One listing of all parts, one of the names that are there; a move for each file.
        there = {p.getPath().getName() for p in fs.listStatus(fs_of(folder)[1])}
        parts = fs.globStatus(fs_of(f"{stage.toString()}/name=*/part-*")[1])
        for found in parts:
            part = found.getPath()
            target = unquote(part.toString().rsplit("/", 2)[1].partition("=")[2])
            if target in done:
                raise ValueError(f"several inputs are named {target}")
            done.add(target)
            end = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{target}")
            if target in there:
                fs.delete(end, False)
            fs.rename(part, end)
            out.append(end.toString())
    finally:
        fs.delete(stage, True)
    return sorted(out)
