import re

import pytest
from pyspark.sql import functions as F

from glossa.operators import abbreviations as A
from glossa.operators import corpus as C
from glossa.operators import evaluate as V
from glossa.operators import flows
from glossa.operators import recognize as R
from glossa.sources import annotated, bioc, files

XML = """<?xml version="1.0" encoding="UTF-8"?>
<collection><source>made up</source><date>today</date><key>k</key>
<document><id>7</id>
<passage><infon key="type">title</infon><offset>0</offset><text>Naïve T cells 😀 here</text>
<annotation id="T1"><infon key="type">cell_type</infon><infon key="identifier">CL:1</infon><location offset="6" length="7"/><text>T cells</text></annotation>
<annotation id="T2"><infon key="entity_type">cell_vague</infon><location offset="14" length="0"/><location offset="16" length="99"/><text>x</text></annotation></passage>
<passage><infon key="type">abstract</infon><offset>21</offset><text></text></passage>
<passage><infon key="type">abstract</infon><offset>22</offset><text>Dendritic cells (DC).</text></passage>
</document>
</collection>
"""


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML, encoding="utf-8")
    docs = bioc.read(spark, f"file://{tmp_path}/a.xml")
    p = bioc.passages(docs)
    assert p.count() == 2
    a = bioc.annotations(p)
    assert [r.type for r in a.orderBy("ann_id").collect()] == ["cell_type", "cell_vague"]
    e = bioc.entities(a).collect()
    assert [(r.entity_id, r.surface, r.start, r.infons["identifier"]) for r in e] == [("T1:0", "T cells", 6, "CL:1")]
    assert bioc.header(spark, f"file://{tmp_path}/a.xml").head().source == "made up"


RICH = XML.replace("<document><id>7</id>", "<document><id>7</id><infon key=\"licence\">free</infon>").replace(
    "<text>Dendritic cells (DC).</text>", "<sentence><offset>22</offset><text>Dendritic cells (DC).</text></sentence><text>Dendritic cells (DC).</text><relation id=\"R1\"><infon key=\"type\">x</infon></relation>"
)


def test_spans_into_files(spark, tmp_path):
    """One file per input, with header, document infons and sentences as they were."""
    for name in ("a", "b"):
        (tmp_path / f"{name}.bioc.xml").write_text(RICH.replace("made up", f"made up {name}"), encoding="utf-8")
    rows = annotated.files(spark, f"file://{tmp_path}/*.xml")
    spans = rows.where("path like '%a.bioc.xml'").selectExpr("path", "'7' doc_id", "explode(array(struct(22 s, 37 e), struct(6 s, 13 e), struct(15 s, 30 e))) x").selectExpr("path", "doc_id", "x.s as start", "x.e as end", "'cell' as label")
    done = annotated.save_each(annotated.with_spans(rows, spans), f"file://{tmp_path}/out", ".xml")
    assert [x.rsplit("/", 1)[1] for x in done] == ["a.xml", "b.xml"]
    text = (tmp_path / "out" / "a.xml").read_text()
    assert "made up a" in text and "licence" in text and "<sentence>" in text and "<relation" not in text and text.startswith("<?xml")
    back = bioc.annotations(bioc.passages(bioc.read(spark, done), keep_empty=True)).orderBy("path", "ann_id").collect()
    assert [(r.ann_id, r.text, r.type, r.locations[0].offset) for r in back] == [("T1", "T\u00a0cells", "cell", 6), ("T2", "Dendritic cells", "cell", 22)]
    again = rows.unionAll(rows)
    with pytest.raises(Exception):  # noqa: B017
        annotated.save_each(annotated.with_spans(again.withColumn("path", F.concat(F.lit("file:/x/"), F.monotonically_increasing_id(), F.lit("/c.xml"))), spans), f"file://{tmp_path}/two")


def test_links_into_files(spark, tmp_path):
    text = RICH.replace('<passage><infon key="type">abstract</infon><offset>22', '<passage><infon key="annotatable"></infon><offset>22')
    xml, matched, missing = annotated.put_links(text.encode(), [{"doc_key": "7", "mention": "T\u00a0cells", "identifier": "CL:1", "name": "T cell", "final_score": 0.5, "expanded_long_form": None, "definition_method": "exact_key", "definition_key": None, "definition_score": float("nan")}], "m", True)
    assert (matched, missing) == (1, 1)
    assert re.findall(r'<infon key="(m_[^"]*)">([^<]*)<', xml) == [("m_id_0", "CL:1"), ("m_identifier_name_0", "T cell"), ("m_identifier_score_0", "0.5"), ("m_ab3p_method", "exact_key")]
    assert annotated.put_links(xml.encode(), [], "m")[1:] == (0, 2)


def test_annotate_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.bioc.xml").write_text(RICH, encoding="utf-8")
    ontology = spark.createDataFrame([("CL:84", "T cell", ["T lymphocyte"]), ("CL:451", "dendritic cell", None)], "concept_id string, preferred_label string, synonyms array<string>")
    terms = spark.createDataFrame([("T cells",), ("dendritic cells",), ("DC",)], "term string")
    keys = A.lookup(spark.createDataFrame([("DC", "CL:451", 0), ("DC", "CL:9", 1)], "short_form string, identifier string, line long"))
    done = flows.annotate_files(spark, f"file:{tmp_path}/in", f"file:{tmp_path}/out", R.gazetteer(terms), ontology, keys)
    assert [x.rsplit("/", 1)[1] for x in done] == ["a.normalized.xml", "b.normalized.xml"]
    a = bioc.annotations(bioc.passages(bioc.read(spark, done))).where("path like '%a.norm%'").orderBy("ann_id").collect()
    assert [(r.text.replace("\u00a0", " "), r.infons["model_id_0"]) for r in a] == [("T cells", "CL:84"), ("Dendritic cells", "CL:451"), ("DC", "CL:451")]
    assert a[2].infons["model_expanded_long_form"].lower() == "dendritic cells"
    got = V.predicted_ids(bioc.annotations(bioc.passages(bioc.read(spark, done))), "model")
    assert {(r.rank, r.pred_id) for r in got.collect()} == {(0, "CL:84"), (0, "CL:451")}


def test_training_data(spark, tmp_path):
    (tmp_path / "train.xml").write_text(RICH, encoding="utf-8")
    records, labels, chunks = flows.prepare_training(spark, [f"file:{tmp_path}"], max_length=6, overlap=1)
    r = records.orderBy("id").collect()
    assert [(x.id, x.document_id, x.passage_offset) for x in r] == [(0, "7", 0), (1, "7", 22)]
    assert [[(e.start, e.end, e.label) for e in x.entities] for x in r] == [[(6, 13, "cell_type")], []]
    assert [tuple(x) for x in labels.orderBy("label_id").collect()] == [(0, "O"), (1, "B-cell_type"), (2, "I-cell_type")]
    got = chunks.where("id = 0").orderBy("chunk", "pos").collect()
    assert [x.label_id for x in got] == [0, 1, 2, 0] and {x.chunk for x in got} == {0}
    m = flows.corpus_mentions(bioc.read(spark, f"file:{tmp_path}/train.xml"))
    assert [tuple(x) for x in m.collect()] == [("CL:1", "T cells", 0)]
    assert flows.corpus_mentions(bioc.read(spark, f"file:{tmp_path}/train.xml"), ("exact",)).count() == 0
    ontology = spark.createDataFrame([("CL:84", "T cell", None)], "concept_id string, preferred_label string, synonyms array<string>")
    o = flows.vocabulary_overlap(spark, {"CellLink": [f"file:{tmp_path}/train.xml"], "CRAFT": []}, ontology).collect()
    assert [(x.corpus, x.n_forms, x.n_matched, x.percent) for x in o] == [("CellLink", 1, 1, 100.0)]


def test_label_order_and_length():
    own = ["O", "B-x", "I-x"]
    assert flows.aligned_labels(own, {0: "O", 1: "I-x", 2: "B-x"}) == ["O", "I-x", "B-x"]
    assert flows.aligned_labels(own, {0: "LABEL_0", 1: "LABEL_1", 2: "LABEL_2"}) == own == flows.aligned_labels(own, {0: "O"}) == flows.aligned_labels(own, None)
    assert [flows.effective_length(*x) for x in ((None, None, None), (None, 10**30, 512), (None, 256, 512), (1024, 512, None), (128, 512, 512), (1024, 10**30, 512))] == [512, 512, 256, 512, 128, 1024]


def test_evaluations(spark):
    kind = "passage_key string, id int, type string, locations array<struct<offset:int,length:int>>, text string"
    refs = spark.createDataFrame([("p", 0, "x", [(0, 5), (12, 4)], "alpha gamm"), ("p", 1, "y", [(6, 5)], "betas"), ("p", 2, "cell_vague", [(0, 5)], "alpha")], kind)
    preds = spark.createDataFrame([("p", 0, "x", [(12, 5)], "gamma"), ("p", 1, "x", [(0, 5)], "alpha"), ("p", 2, "y", [(6, 5)], "betas"), ("q", 3, "x", [(0, 5)], "alpha")], kind)
    passages = spark.createDataFrame([("p", 0, "alpha betas gamma"), ("q", 0, "alpha")], "passage_key string, offset int, text string")
    one = passages.where("passage_key = 'p'")
    with pytest.raises(ValueError, match="q"):
        V.evaluate_spans(refs, one, preds, passages)
    counts = lambda d: tuple(d.select("tp", "fp", "fn").head())
    assert counts(V.evaluate_spans(refs, one, preds, passages, skip_extra=True)) == (1, 2, 1)
    assert counts(V.evaluate_spans(refs, one, preds, passages, "relax", skip_extra=True)) == (2, 1, 0)
    assert counts(V.evaluate_spans(refs, one, preds, passages, "relax", verify=False)) == (2, 2, 0)
    assert counts(V.evaluate_spans(refs, one, preds, passages, "relax", "y none", skip_extra=True)) == (1, 0, 0)
    assert counts(V.evaluate_spans(refs, one, preds, passages, "relax", skip_extra=True, blacklist=["GAMMA", "alpha"])) == (1, 2, 1)
    kind = "ann string, passage_key string, type string, locations array<struct<offset:int,length:int>>, identifier string"
    gold = spark.createDataFrame([("a", "p", "x", [(0, 5)], "CL:1"), ("b", "p", "x", [(6, 5)], "CL:2;CL:3")], kind)
    found = spark.createDataFrame([("a", "p", "x", [(0, 5)], 0, "-", "0.9"), ("a", "p", "x", [(0, 5)], 1, "CL:1", "0.8"), ("b", "p", "x", [(6, 4)], 0, "CL:3", "0.1")], "ann string, passage_key string, type string, locations array<struct<offset:int,length:int>>, rank int, pred_id string, score string")
    got = {(r.gate, r.top): (r.tp, r.fp, r.fn) for r in V.evaluate_links(gold, found).collect()}
    assert got["singleID", 1] == (1, 0, 0) and got["allLabels", 1] == (2, 0, 1)
    got = {(r.gate, r.top): (r.tp, r.fp, r.fn) for r in V.evaluate_links(gold, found, mode="end_to_end").collect()}
    assert got["allLabels", 1] == (1, 1, 2)
    got = V.choose_top(V.evaluate_links(gold, found, ("allLabels",), ["x"], threshold=0.5), "top5").collect()
    assert [(r.top, r.tp, r.fp, r.fn) for r in got] == [(5, 1, 0, 2)]
