import json

import pytest
from glossa.operators import abbreviations as A
from glossa.operators import linking as L
from glossa.operators import recognize as R
from glossa.sources import files, paths
from glossa.streaming import annotate
from tests.test_bioc import XML


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_ontologies(spark, tmp_path):
    good = [{"norm_concept_id": "CL:1", "norm_preferred_label": "T cells", "synonyms": ["T lymphocytes", ""]}, {"norm_concept_id": "CL:2"}]
    d = files.ontology(spark, put(tmp_path / "a.jsonl", "\n".join(map(json.dumps, good)) + "\n"))
    assert [(r.name, r.is_preferred) for r in L.ontology_terms(d).orderBy("ord").collect()] == [("T cell", True), ("T lymphocyte", False)]
    with pytest.raises(Exception):  # noqa: B017
        files.ontology(spark, put(tmp_path / "bad.jsonl", "{broken\n")).collect()
    rows = [{"id": "CL_0000001", "label": "a", "alias": {"x": ["b", "c"]}}, {"id": "GO:1", "label": "no"}, {"id": "CL:3", "name": "d", "obsolete": True}]
    rows += [{"norm_concept_id": "CL:7", "concept_id": "CL:8", "norm_preferred_label": "", "label": "seven", "deprecated": "no longer", "obsolete": False}]
    rows += [{"concept_id": "CL:9", "norm_concept_id": "CL:4", "label": "x", "norm_preferred_label": "four", "deprecated": False, "obsolete": 0}, {"id": "CL:5", "synonyms": [], "alias": ["five"]}]
    want = [("CL:0000001", "a", ["b", "c"]), ("CL:4", "four", []), ("CL:5", None, ["five"])]
    for text in (json.dumps(rows), "".join(map(json.dumps, rows)), "\n".join(map(json.dumps, rows))):
        got = files.tolerant_ontology(spark, put(tmp_path / "t.json", text)).collect()
        assert sorted((r.concept_id, r.preferred_label, r.synonyms) for r in got) == sorted(want)
    d = files.tolerant_ontology(spark, put(tmp_path / "t.json", "\n".join(map(json.dumps, rows))))
    assert sorted(r.form for r in files.relaxed_aliases(d).collect()) == ["a", "b", "c", "five", "four"]


def test_abbreviations(spark, tmp_path):
    path = put(tmp_path / "a.tsv", "short_form\tmatched_cl_id\nDC\tCL:1\nD-C\tCL:2;CL:9\nNK\tCL:3\tmore\nxx\t-\nbad\n")
    got = {r.key: (r.n_ids, r.short_form) for r in A.lookup(files.abbreviations(spark, path)).collect()}
    assert got == {"DC": (2, "D-C"), "NK": (1, "NK")}
    for name, text in (("a.txt", "short_form\tmatched_cl_id\nDC\tCL:1\n"), ("b.tsv", "form\tid\nDC\tCL:1\n")):
        with pytest.raises(ValueError, match="no abbreviation table"):
            files.abbreviations(spark, put(tmp_path / name, text))


def test_datasets(spark, tmp_path):
    rows = [{"id": 1, "text": "a, b"}, {"id": 2, "text": "c"}]
    for path in (put(tmp_path / "d.json", json.dumps(rows)), put(tmp_path / "d.jsonl", "\n".join(map(json.dumps, rows))), put(tmp_path / "d.csv", 'id,text\n1,"a, b"\n2,c\n')):
        d = files.dataset(spark, path)
        assert sorted((int(r.id), r.text) for r in d.collect()) == [(1, "a, b"), (2, "c")]
    assert files.infer_columns(d.columns) == {"text": "text", "entities": None, "document_id": None, "passage_id": None, "passage_offset": None, "record_id": "id"}
    assert files.infer_columns(["body", "tags"], entities="tags")["text"] == "body"
    assert [r.text for r in files.limit_rows(d, ["id"], 1).collect()] == ["a, b"] and files.limit_rows(d, ["id"], None).count() == 2
    with pytest.raises(ValueError):
        files.dataset(spark, "x.zip")


def test_predictions(spark, tmp_path):
    kind = "id long, text string, passage_offset int, document_id string, passage_id int, predicted_entities array<struct<label:string,start_local:int,end_local:int,start:int,end:int,text:string>>"
    d = spark.createDataFrame([(1, "T cells", 6, "7", 0, [("cell", 0, 7, 6, 13, "T cells")]), (2, "", 0, "8", 0, None)], kind)
    files.write_predictions(d, f"file://{tmp_path}/out")
    lines = spark.read.json(f"file://{tmp_path}/out/lines").orderBy("id").collect()
    assert [len(r.predicted_entities) for r in lines] == [1, 0]
    arrays = [json.loads(p.read_text()) for p in (tmp_path / "out" / "array").glob("part-*") if p.stat().st_size]
    assert sorted(e["id"] for a in arrays for e in a) == [1, 2]
    assert [tuple(r) for r in files.predicted_entities(d).collect()] == [("7", "cell", 6, 13)]
    files.write_manifest(spark, {"rows": 2}, f"file://{tmp_path}/m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"rows": 2}


def test_paths(spark, tmp_path):
    for name in ("b.xml", "a.XML", "c.txt", "craft/train.xml", "craft/test.xml", "CellLink/dev.xml", "CellLink/valid_test.xml", "bio-id/x.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        put(tmp_path / name, "<collection/>")
    (tmp_path / "empty").mkdir()
    root = f"file:{tmp_path}"
    cut = lambda xs: [x[len(root) + 1 :] for x in xs]
    assert cut(paths.xml_files(spark, root)) == ["a.XML", "b.xml"] and paths.xml_files(spark, f"{root}/b.xml") == [f"{root}/b.xml"]
    for bad, error in ((f"{root}/empty", FileNotFoundError), (f"{root}/no", FileNotFoundError), (f"{root}/c.txt", ValueError)):
        with pytest.raises(error):
            paths.xml_files(spark, bad)
    assert cut(paths.split_files(spark, [root])) == ["craft/train.xml"] and cut(paths.split_files(spark, [f"{root}/craft"])) == ["craft/train.xml"]
    assert cut(paths.split_files(spark, [f"{root}/bio-id"])) == ["bio-id/x.xml"]
    with pytest.raises(FileNotFoundError):
        paths.split_files(spark, [f"{root}/bio-id"], otherwise_all=False)
    found = {k: cut(v) for k, v in paths.discover(spark, root).items()}
    assert found == {"CellLink": ["CellLink/dev.xml"], "BioID": ["bio-id/x.xml"], "CRAFT": ["craft/test.xml", "craft/train.xml"], "AnatEM": [], "JNLPBA": []}
    assert paths.overrides(spark, [f" A  b={root}/b.xml, {root}/c.txt"]) == {"A b": [f"{root}/b.xml", f"{root}/c.txt"]}
    for bad, error in (("A", ValueError), ("=x", ValueError), (f"A={root}/no", FileNotFoundError)):
        with pytest.raises(error):
            paths.overrides(spark, [bad])
    assert paths.pairs(spark, [f"{root}/bio-id"], [f"{root}/empty"]) == [(f"{root}/bio-id/x.xml", f"{root}/empty/x.xml")]
    assert paths.pairs(spark, [f"{root}/b.xml"], [f"{root}/o.xml"]) == [(f"{root}/b.xml", f"{root}/o.xml")]
    with pytest.raises(ValueError):
        paths.pairs(spark, [f"{root}/b.xml"], [f"{root}/empty"])


def test_pairs(spark, tmp_path):
    d = files.pairs(spark, put(tmp_path / "p.txt", "c||a||b\n\nc||a||d\n"))
    assert sorted(map(tuple, d.collect())) == [("c", "a"), ("c", "b"), ("c", "d")]
    with pytest.raises(Exception):  # noqa: B017
        files.pairs(spark, put(tmp_path / "q.txt", "c||a\n")).collect()


def test_entities(spark):
    d = spark.createDataFrame([('[{"start": 1, "end": 2, "label": "x"}]',), (None,), ("[]",)], "entities string")
    assert [len(r[0]) for r in d.select(files.parse_entities()).collect()] == [1, 0, 0]
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([('[{"start": 1}]',)], "entities string").select(files.parse_entities()).collect()


def test_link_decisions(spark):
    ontology = spark.createDataFrame([("CL:1", "T cell", ["T lymphocyte"]), ("CL:2", "dendritic cell", None)], "concept_id string, preferred_label string, synonyms array<string>")
    keys = A.lookup(spark.createDataFrame([("TC", "CL:1", 0), ("DC", "CL:2", 1), ("DC", "CL:7", 2)], "short_form string, identifier string, line int"))
    defined = spark.createDataFrame([("d1", "DCs", "dendritic cells", 0)], "doc_key string, key string, long_form string, ord int")
    mentions = spark.createDataFrame([("d1", "TC"), ("d1", "DC"), ("d2", "DC"), ("d1", "T lymphocytes")], "doc_key string, mention string")
    got = {(r.doc_key, r.mention): (r.identifier, r.source) for r in L.link(mentions, ontology, keys, defined).collect()}
    assert got["d1", "TC"] == ("CL:1", "abbreviation_direct")
    assert got["d1", "DC"] == ("CL:2", "abbreviation_ambiguous_via_long_form")
    assert got["d2", "DC"][1] == "model_normal" and got["d1", "T lymphocytes"] == ("CL:1", "model_normal")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.xml", XML)
    links = spark.createDataFrame([("t cells", "CL:1")], "term string, identifier string")
    q = annotate.annotate(annotate.read(spark, f"file://{tmp_path}/in"), R.gazetteer(links.select("term")), links, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    q.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").select("start", "end", "text", "identifier").collect()
    assert [(r.start, r.end, r.text.replace("\u00a0", " "), r.identifier) for r in got] == [(6, 13, "T cells", "CL:1")]


@pytest.mark.parametrize("indent", [None, 1])
def test_records_over_ranges(spark, tmp_path, indent):
    """Files of several objects or arrays, read by several tasks, whatever the seams cut."""
    import random

    draw = random.Random(10)
    value = lambda deep: draw.choice([1, None, 'a "q" \\ }{][', "é\n😀", True]) if deep == 0 or draw.random() < 0.3 else draw.choice([[value(deep - 1) for _ in range(draw.randrange(3))], {f"k{i}": value(deep - 1) for i in range(draw.randrange(3))}])
    rows = [{"id": i, "x": value(3), "{": [[]]} for i in range(120)]
    texts = {"array": json.dumps(rows, indent=indent), "after": "".join(json.dumps(r, indent=indent) for r in rows), "lines": "\n".join(json.dumps(r, indent=indent) for r in rows) + "\n", "commas": "[\n" + ",\n".join(json.dumps(r, indent=indent) for r in rows) + "\n]\n", "bom": "﻿" + json.dumps(rows, indent=indent), "empty": "[]", "blank": "\n"}
    want = sorted(json.dumps(r, sort_keys=True) for r in rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        for name, text in texts.items():
            d = files.json_records(spark, put(tmp_path / f"{name}.json", text))
            got = sorted(json.dumps(json.loads(r.r), sort_keys=True) for r in d.collect())
            assert got == ([] if name in ("empty", "blank") else want), name
        assert spark.read.text(f"file:{tmp_path}/after.json").rdd.getNumPartitions() > 3
        both = files.json_records(spark, f"file:{tmp_path}/*.json")
        assert both.groupBy("path").count().count() == 5 and both.count() == 5 * len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    with pytest.raises(Exception):  # noqa: B017
        files.json_records(spark, put(tmp_path / "bad.txt", '{"a": \n nonsense')).collect()


def test_mentions_are_linked_once(spark, tmp_path):
    """A mention of two batches is linked in the first; a batch that runs again adds no rows."""
    (tmp_path / "in").mkdir()
    root, asked = f"file://{tmp_path}", []
    terms = spark.createDataFrame([("t cells",), ("dendritic cells",), ("dc",)], "term string")

    def linker(m):
        rows = sorted(r.mention for r in m.collect())
        asked.append(rows)
        return spark.createDataFrame([(r, f"CL:{len(r)}") for r in rows], "mention string, identifier string")

    def run():
        annotate.recognize_stream(annotate.read(spark, f"{root}/in"), R.gazetteer(terms), f"{root}/spans", f"{root}/state1").awaitTermination()
        annotate.link_new(annotate.spans_stream(spark, f"{root}/spans"), linker, f"{root}/links", f"{root}/state2").awaitTermination()
        return sorted((r.doc_id, r.start, r.mention, r.identifier) for r in annotate.linked(spark, f"{root}/spans", f"{root}/links").collect())

    put(tmp_path / "in" / "a.xml", XML.replace("Dendritic cells (DC).", "No more."))
    assert run() == [("7", 6, "t cells", "CL:7")]
    put(tmp_path / "in" / "b.xml", XML.replace("<id>7<", "<id>8<"))
    want = [("7", 6, "t cells", "CL:7"), ("8", 6, "t cells", "CL:7"), ("8", 22, "dendritic cells", "CL:15"), ("8", 39, "dc", "CL:2")]
    assert run() == want
    assert [a for a in asked if a] == [["t cells"], ["dc", "dendritic cells"]]
    for state in ("state1", "state2"):  # as after a failure before the batch was noted as done
        last = max((p for p in (tmp_path / state / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == want
    assert spark.read.parquet(f"{root}/links").count() == 3
