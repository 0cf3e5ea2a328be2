"""Files larger than a task: by document, against the edit of whole files."""

import re

from pyspark.sql import functions as F

from glossa.sources import annotated, bioc, pieces
from tests.test_bioc import RICH, XML


def big(n=40):
    head = "<?xml version='1.0'?>\n<!DOCTYPE collection>\n<collection>\n <source>made  up</source><date/>\n"
    body = RICH[RICH.index("<document>") : RICH.index("</document>") + len("</document>")]
    docs = [body.replace("<id>7</id>", f"<id> {i} </id>").replace("<passage>", "<passage >" if i % 2 else "<passage>").replace(" (DC).</text>\n", f" (DC) &amp; {'x' * (i * 7 % 50)}.</text>\n") for i in range(n)]
    return head + "\n  \n".join(docs) + "\n</collection>"


def without_notes(text):
    return re.sub(r"\s*<(annotation|relation)\b.*?</\1>", "", text, flags=re.S)


def test_by_document(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(big(), encoding="utf-8")
    (tmp_path / "in" / "b.bioc.xml").write_text(XML, encoding="utf-8")
    root = f"file:{tmp_path}/in"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        d = pieces.read(spark, root)
        assert d.where("path like '%a.xml'").select("block").distinct().count() > 5
        rows = annotated.files(spark, f"{root}/*.xml")
        spans = annotated.documents(rows).select("path", "doc_id", F.explode(F.expr("array(struct(6 s, 13 e), struct(22 s, 37 e), struct(15 s, 30 e), struct(0 s, 5 e))")).alias("x")).select("path", "doc_id", F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.when(F.col("x.s") == 0, 'a<"b').otherwise("cell").alias("label"))
        spans = spans.where("doc_id <> '3'")
        done = pieces.save(pieces.with_spans(d, spans), f"file:{tmp_path}/out", ".xml")
        whole = annotated.save_each(annotated.with_spans(rows, spans), f"file:{tmp_path}/whole", ".xml")
        notes = lambda files: sorted((r.path.rsplit("/", 1)[1], r.doc_id, r.passage_idx, r.ann_id, r.type, r.text, str(r.locations)) for r in bioc.annotations(bioc.passages(bioc.read(spark, files), keep_empty=True)).collect())
        assert notes(done) == notes(whole) and len(notes(done)) == 3 * 40
        text = (tmp_path / "out" / "a.xml").read_text(encoding="utf-8")
        assert without_notes(text) == without_notes(big())
        assert re.findall(r'annotation id="(T\d+)"', text) == [f"T{k + 1}" for k in range(3 * 39)]
        files = rows.select("path", "content")
        found = annotated.mentions(annotated.documents(files))
        links = found.select("doc_key", F.col("normal").alias("mention")).distinct().where("doc_key <> '5'").select("doc_key", "mention", F.lit("CL:1").alias("identifier"), F.lit("T & c").alias("name"), F.lit(0.5).alias("final_score"))
        linked = pieces.with_links(d, found, links, "m", True)
        one = {r.path: (r.matched, r.missing) for r in linked.groupBy("path").agg(F.sum("matched").alias("matched"), F.sum("missing").alias("missing")).collect()}
        assert one == {r.path: (r.matched, r.missing) for r in annotated.with_links(files, found, links, "m", True).collect()}
        done = pieces.save(linked, f"file:{tmp_path}/linked", ".xml")
        text = (tmp_path / "linked" / "a.xml").read_text(encoding="utf-8")
        assert re.sub(r'<infon key="m_[^>]*>[^<]*</infon>', "", text) == big()
        ids = lambda files: sorted((r.path.rsplit("/", 1)[1], r.doc_id, r.ann_id, r.infons.get("m_id_0"), r.infons.get("m_identifier_name_0")) for r in bioc.annotations(bioc.passages(bioc.read(spark, files))).collect())
        assert ids(done) == ids(annotated.save_each(annotated.with_links(files, found, links, "m", True).select("path", "xml"), f"file:{tmp_path}/linked2", ".xml"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
