"""What may grow with the input: nothing of it on the driver, texts met once, steps of files."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import vector
from glossa.functions.udfs import byte_offsets
from glossa.operators import abbreviations as A
from glossa.operators import evaluate as V
from glossa.operators import spans as S
from glossa.plans.queries import queries
from glossa.sources import annotated, bioc


def test_index_is_fitted_off_the_driver(spark, monkeypatch):
    """Centers come from one task, of at most SAMPLE rows; no rows come to the driver."""
    draw = np.random.default_rng(3)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(900, 6)))], "i long, embedding array<float>")

    def never(*_):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(vector, "SAMPLE", 100)
    monkeypatch.setattr(DataFrame, "toPandas", never)
    index = vector.Index(d, "i", centers=20)
    assert index.centers.shape == (20, 6) and index.size.sum() == 900
    q = d.where("i % 50 = 0")
    key = lambda x: sorted(tuple(r) for r in x.collect())
    assert key(index.nearest(q, 5, "i")) == key(vector.nearest(q, d, 5, "i", "i"))
    index.drop()


@pytest.mark.parametrize("step", [1, 64])
def test_distances_of_all_pairs(spark, monkeypatch, step):
    """Cells against the expression: missing, zero, holed, other and non-finite vectors too."""
    monkeypatch.setattr(vector, "CELL_STEP", step)
    monkeypatch.setattr(vector, "PAIR_QUERIES", 4)
    monkeypatch.setattr(vector, "PAIR_TERMS", 7)
    draw = np.random.default_rng(5)
    odd = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [0.0, 0.0]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate([*draw.normal(size=(20, 4)).tolist(), *odd])], "i long, embedding array<float>")
    q = d.where("i % 3 = 0 or i > 19")
    want = q.where("size(embedding) > 0").select(F.col("i").alias("query_id"), F.col("embedding").alias("a")).crossJoin(d.select(F.col("i").alias("term_id"), F.col("embedding").alias("b")))
    want = want.select("query_id", "term_id", F.round(F.expr(vector.cosine_distance("a", "b")), 9).alias("distance"))
    key = lambda x: sorted(map(str, x.collect()))
    assert key(vector.distances(q, d, "i", "i")) == key(want)


def test_byte_offsets(spark):
    """Of many texts at once, those of empty and missing ones too."""
    texts = ["", None, "aé😀", "日本", "x" * 300] * 60
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in d.select("i", byte_offsets("text").alias("m")).collect():
        t = texts[r.i]
        assert r.m == (None if t is None else [len(t[:k].encode()) for k in range(len(t) + 1)])


def test_tags_and_spans_within_rows(spark):
    """Texts that meet their entities before they are cut; spans decoded without a shuffle."""
    docs = spark.createDataFrame([(1, "aa bb, cc dd"), (2, None), (3, "😀 xx"), (4, "yy")], "k int, text string")
    e = spark.createDataFrame([(1, 0, "t", 4, 8), (1, 1, "t", 7, 12), (3, 0, "u", 2, 3)], "k int, entity long, label string, start int, end int")
    want = S.tag_rows(S.token_rows(docs, "k"), e, "k")
    got = S.tag_texts(docs, e, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    tags = [["O", "B-a", "I-a", "I-b"], None, ["I-a"], ["a"]]
    rows = S.token_rows(docs, "k", lead=True).join(spark.createDataFrame(list(zip([1, 2, 3, 4], tags, strict=True)), "k int, tags array<string>"), "k")
    out = S.decode_rows(rows, "k")
    assert "Exchange" not in S.decode_rows(S.token_rows(docs, "k", lead=True).withColumn("tags", F.array()), "k")._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a", 3, 9, 2, "bb, cc"), (1, "b", 10, 12, 1, "dd"), (3, "a", 2, 4, 1, "xx"), (4, "a", 0, 2, 1, "yy")]


def test_grid_makes_no_row_for_a_cell(spark):
    """Tuples are counted without a row for each mode, model and set of types."""
    place = "array<struct<offset:int,length:int>>"
    gold = spark.createDataFrame([("1", 7, "a", [(0, 2)], "CL:1"), ("2", 7, "b", [(3, 2)], "CL:2")], f"ann string, passage_key int, type string, locations {place}, identifier string")
    pred = spark.createDataFrame([("1", 7, "a", [(1, 2)], 0, "CL:1", "1", "m", "x"), ("2", 7, "b", [(3, 2)], 0, "CL:9", "1", "m", "x"), ("2", 7, "b", [(3, 2)], 1, "CL:2", "1", "m", "x")], f"ann string, passage_key int, type string, locations {place}, rank int, pred_id string, score string, model string, text string")
    docs = spark.createDataFrame([(7, "aaa bb")], "passage_key int, text string")
    d = V.link_grid(gold, pred, docs, ["m", "n"], ("allLabels",), {"all": None, "b": ["b"]}, (1, 2), V.MODES)
    got = {(r.model, r.type_set, r.score_mode, r.top): (r.tp, r.fp, r.fn) for r in d.collect()}
    assert got["m", "all", V.MODES[0], 1] == (1, 1, 1) and got["m", "all", V.MODES[0], 2] == (2, 1, 0)
    assert got["m", "all", V.MODES[1], 2] == (1, 2, 1) and got["m", "all", V.MODES[2], 2] == (2, 1, 0)
    assert got["m", "b", V.MODES[2], 1] == (0, 1, 1) and got["n", "all", V.MODES[1], 1] == (0, 0, 2)
    keys = [line.split("], [")[0] for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert any("passage_key" in k for k in keys) and not any("passage_key" in k and "score_mode" in k for k in keys)


def test_files_in_steps(spark, monkeypatch):
    """Files are objects in steps of some; parts are moved by one listing."""
    held = []
    monkeypatch.setattr(annotated, "put_spans", lambda c, f: held.append(1) or (c.decode(), len(f)))
    assert annotated.STEP <= 64
    d = spark.createDataFrame([(f"in/d{k}.xml", f"<collection><document><id>{k}</id></document></collection>") for k in range(5)], "path string, xml string")
    folder = spark.conf.get("spark.checkpoint.dir") + "/each"
    out = annotated.save_each(d, folder, ".out.xml")
    assert [x.rsplit("/", 1)[1] for x in out] == [f"d{k}.out.xml" for k in range(5)]
    assert annotated.save_each(d.limit(2), folder, ".out.xml") and bioc.read(spark, folder, "*.xml").count() == 5
    assert bioc.read(spark, folder, "*.json").count() == 0


def test_overlap_joins_no_words_with_documents(spark):
    """The language goes with the words: only forms meet the terms."""
    d = queries()["corpus_overlap"](spark, "/root/testdata/sf0.001")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_linker_reads_its_inputs_once(spark):
    """What several steps read is kept: the links read none of the linker's inputs again."""
    d = queries()["link_mentions"](spark, "/root/testdata/sf0.001")
    assert d.count() and not [f for f in d.inputFiles() if "/testdata/" in f]


def test_repeated_rows_of_lookup_and_definitions(spark):
    """Repeated rows meet by numbers first: the longest short form, the last long form, the first place."""
    rows = [("N-K", "CL:2", 3), ("NK", "CL:1", 0), ("N-K", "CL:1", 5), ("N-K", "CL:2", 1), ("N-K", "CL:1", 1 << 40), ("NK", None, 0), ("-", "CL:1", 0), ("T", "CL:1", 7), ("T", "CL:1", 2)]
    keys = A.lookup(spark.createDataFrame(rows, "short_form string, identifier string, line long"))
    assert sorted(map(tuple, keys.collect())) == [("NK", 2, 5, "N-K", "CL:2"), ("T", 1, 2, "T", "CL:1")]
    defined = spark.createDataFrame([("d", "K", "b", 4), ("d", "K", "a", 1), ("d", "K", "b", 0), ("d", "K", "a", 9), ("e", "K", None, 2)], "doc_key string, key string, long_form string, ord int")
    last = A.last_forms(defined)
    assert sorted((r.doc_key, r.key, r.long_form, r.first) for r in last.collect()) == [("d", "K", "a", 0), ("e", "K", None, 2)]
    wanted = spark.createDataFrame([("d", "K"), ("e", "Ks")], "doc_key string, key string")
    assert sorted(map(str, A.cascade(wanted, last).collect())) == sorted(map(str, A.cascade(wanted, defined).collect()))
