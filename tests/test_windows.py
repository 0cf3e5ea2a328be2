"""Tokens, recognition over windows, batches, ties and bounds against brute force."""

import itertools
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import abbreviations as A
from glossa.operators import corpus as C
from glossa.operators import evaluate as V
from glossa.operators import flows
from glossa.operators import linking as L
from glossa.operators import recognize as R
from glossa.operators import spans as S
from glossa.sources import annotated, bioc

TEXTS = ["", None, " ", "a", "😀 naïve T cells, b_c 12é3!", "\n\nx  y\t日本語 z", "ab" * 700 + "-" + "c", "__", "end."]


@pytest.mark.parametrize("word", [S.WORD, S.EVALUATED, S.ASCII])
@pytest.mark.parametrize("part", [1, 1 << 20])
def test_token_rows(spark, monkeypatch, word, part):
    monkeypatch.setattr(S, "PART", part)
    d = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").repartition(2)
    for r in S.token_rows(d, "k", "text", word, lead=True).collect():
        text, at = TEXTS[r.k] or "", 0
        want = []
        for m in re.finditer(f"{word}+", text):
            want.append((m[0], m.start(), m.end(), text[at : m.start()]))
            at = m.end()
        assert [tuple(t) for t in r.tokens] == want


class Toy:
    """Scores that depend on the place in the window; tokens named x have none."""

    labels = ["O", "B-a", "I-a"]

    def scores(self, tokens, sizes):
        out = []
        for n in sizes.tolist():
            for k in range(n):
                t = tokens[len(out)]
                out.append([np.nan] * 3 if t == "x" else [1.0, (len(t) * 7 + k) % 4, (len(t) * 3 + 2 * k) % 5])
        return np.array(out).reshape(-1, 3)


def test_windows_against_a_loop(spark):
    """Windows, means over windows, best labels, default O, spans and their texts."""
    draw = random.Random(4)
    texts = {i: "".join(draw.choice(["x", "ab", "abc", "é", "😀", " ", "  ", "-"]) + draw.choice([" ", "\n", ", "]) for _ in range(draw.randrange(0, 60))) for i in range(30)}
    width, overlap, special = 9, 3, 2
    want = []
    for key, text in texts.items():
        tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        total, first = {}, 0
        while tokens:
            cut = tokens[first : first + width - special]
            for (_, s, e), x in zip(cut, Toy().scores([t for t, _, _ in cut], np.array([len(cut)])), strict=True):
                total.setdefault((s, e), []).append(x)
            if first + width - special >= len(tokens):
                break
            first += width - special - overlap
        active = None
        for _, s, e in tokens:
            mean = np.mean(total[s, e], axis=0)
            tag = "O" if np.isnan(mean).all() else Toy.labels[int(np.argmax(mean))]
            if tag == "O":
                active = None
            elif active and tag == f"I-{active[1]}":
                active[3] = e
            else:
                active = [key, tag[2:], s, e]
                want.append(active)
    d = spark.createDataFrame(list(texts.items()), "k int, text string").repartition(3)
    for model in (Toy(), R.Lazy(Toy, Toy.labels)):
        got = R.recognize(d, R.windowed(model, width, overlap, special), "k").collect()
        assert sorted((r.k, r.label, r.start, r.end) for r in got) == sorted(map(tuple, want))
        assert all(r.text == texts[r.k][r.start : r.end] for r in got)


def test_linear_model_learns(spark):
    """Held-out accuracy of the classifier fitted on labelled windows."""
    draw = random.Random(5)
    make = lambda: " ".join(draw.choice(["running", "nation", "cell", "the", "of", "walking", "station", "blood"]) for _ in range(30))
    d = spark.createDataFrame([(i, make()) for i in range(60)], "k int, text string")
    rows = S.token_rows(d, "k")
    e = S.token_spans(d, "k").where("token rlike '(ing|ion)$'").select("k", F.col("pos").alias("entity"), F.when(F.endswith("token", F.lit("ing")), "ing").otherwise("ion").alias("label"), "start", "end")
    labels = ["O", "B-ing", "I-ing", "B-ion", "I-ion"]
    model = R.fit_linear(R.tagged_windows(S.tag_rows(rows.where("k < 40"), e, "k"), "k", 12, 4), labels, least=2)
    got = R.recognize(d.where("k >= 40"), R.windowed(model, 12, 4), "k").select("k", "label", "start", "end")
    want = e.where("k >= 40").select("k", "label", "start", "end")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_strict_tags(spark):
    rows = S.token_rows(spark.createDataFrame([(1, "one two")], "k int, text string"), "k")
    kind = "k int, entity int, label string, start int, end int"
    assert [r.tag for r in S.encode_tags(rows, spark.createDataFrame([(1, 0, "x", 0, 3)], kind), "k", "strict").orderBy("pos").collect()] == ["B-x", "O"]
    for bad in ((3, 4), (1, 3), (0, 5), (9, 12)):
        with pytest.raises(Exception, match="an entity"):
            S.encode_tags(rows, spark.createDataFrame([(1, 0, "x", *bad)], kind), "k", "strict").collect()


def test_shared_tokens(spark):
    """Spans share a token if and only if their common part has a character of one."""
    draw = random.Random(6)
    texts = {i: "".join(draw.choice("a_1 -.é") for _ in range(25)) for i in range(40)}
    kind = "passage_key int, id int, type string, start int, end int"
    make = lambda: [(k, i, "xy"[i % 2], a, a + draw.randrange(1, 6)) for k in texts for i in range(6) for a in [draw.randrange(20)]]
    refs, preds = make(), make()
    want = set()
    for (k, i, t, s, e), (q, j, u, a, b) in itertools.product(refs, preds):
        words = [m.span() for m in re.finditer(r"\w+", texts[k])]
        if k == q and t == u and s < b and a < e and any(s < y and x < e and a < y and x < b for x, y in words):
            want.add((k, i, j))
    p = spark.createDataFrame([(k, t, 100) for k, t in texts.items()], "passage_key int, text string, offset int")
    moved = lambda rows: spark.createDataFrame([(k, i, t, s + 100, e + 100) for k, i, t, s, e in rows], kind)
    got = S.token_overlaps(moved(refs), moved(preds), p, "passage_key")
    assert {tuple(r) for r in got.collect()} == want


def test_ties_in_two_orders(spark):
    """Results do not depend on the order of rows."""
    wanted = spark.createDataFrame([("d", "LONGKEYS")], "doc_key string, key string")
    rows = [("d", "LONGKEYSX", "late", 5), ("d", "XLONGKEYS", "first", 2), ("d", "LONGKEYSX", "later", 7), ("d", "YLONGKEYS", "second", 3)]
    labels = [("CL:1", "b label", ["s"], 4), ("CL:1", "a label", None, 9), ("CL:2", "z", None, 1)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_key string, key string, long_form string, ord int").repartition(3)
        assert A.cascade(wanted, d).head().matched_key == "XLONGKEYS"
    for order in (labels, labels[::-1]):
        o = spark.createDataFrame(order, "concept_id string, preferred_label string, synonyms array<string>, record long").repartition(3)
        got = {r.identifier: (r.preferred_label, r.names) for r in L.concept_metadata(L.ontology_terms(o)).collect()}
        assert got == {"CL:1": ("b label", ["a label", "b label", "s"]), "CL:2": ("z", ["z"])}
        got = L.concept_metadata(L.ontology_terms(o.drop("record"))).where("identifier = 'CL:1'").head()
        assert got.preferred_label == "a label"


def test_fuzzy_bound(spark):
    """Bounds are never below the ratio, and pass fewer pairs with the same result."""
    draw = random.Random(7)
    words = ["".join(draw.choice("ABCD") for _ in range(draw.randrange(0, 12))) for _ in range(60)]
    pairs = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    got = pairs.select("a", "b", T.col(T.length_bound("a", "b")).alias("n"), T.col(T.ratio_bound("a", "b")).alias("c")).collect()
    for r in got:
        ratio = SequenceMatcher(None, r.a, r.b).ratio()
        assert ratio <= r.c + 1e-12 <= r.n + 1e-9 or not (r.a or r.b)
    keys = sorted({w for w in words if len(w) > 4})
    wanted = spark.createDataFrame([("d", k[1:] + k[0]) for k in keys] + [("d", k + "A") for k in keys], "doc_key string, wanted string").distinct()
    have = spark.createDataFrame([("d", k) for k in keys], "doc_key string, key string")
    open_ = {(r.wanted, r.key) for r in A.fuzzy_pairs(wanted, have).collect()}
    names = [r.wanted for r in wanted.collect()]
    limit = lambda k: 1.0 if len(k) <= 4 else 0.95 if len(k) <= 7 else 0.9
    true = {(w, k) for w, k in itertools.product(names, keys) if limit(w) < 1 and SequenceMatcher(None, w, k).ratio() >= limit(w)}
    assert true <= open_ and len(open_) < len(names) * len(keys) / 4


def test_batch_plan(spark):
    """Sizes, no repetition, only labels with enough rows, runs agree, epochs differ, mixing."""
    data = [(label, 100 * label + i) for label, n in enumerate([2, 3, 3, 5, 40, 7, 1, 300]) for i in range(n)]
    d = spark.createDataFrame(data, "label long, k long")
    plan = lambda epoch, rows=d: sorted(map(tuple, C.batch_plan(rows, "label", "k", 4, 3, 50, epoch).collect()))
    one = plan(0)
    assert one == plan(0, d.orderBy(F.desc("k")).repartition(5)) and one != plan(1)
    seen = Counter()
    for b, own in itertools.groupby(one, lambda r: r[0]):
        own = list(own)
        assert [r[1] for r in own] == list(range(12)) and len({r[3] for r in own}) == 12
        assert sorted(Counter(r[2] for r in own).values()) == [3] * 4
        seen.update({r[2] for r in own})
        assert all(r[3] // 100 == r[2] or r[2] == 7 for r in own)
    assert set(seen) == {1, 2, 3, 4, 5, 7} and len({r[3] for r in one if r[2] == 7}) > 60
    assert any([r[2] for r in one if r[0] == b] != sorted(r[2] for r in one if r[0] == b) for b in range(50))
    for bad in ((7, 3), (1, 3), (4, 1)):
        with pytest.raises(ValueError):
            C.batch_plan(d, "label", "k", *bad, 5)
    drawn = C.balanced_sample(d, "label", "k", 5, 3).groupBy("label").count().collect()
    assert len(drawn) == 5 and all(r["count"] == 3 and r.label not in (0, 6) for r in drawn)
    index = C.label_index(d, "label", "k", 3).collect()
    assert {(r.label_id, r.label) for r in index} == set(enumerate([1, 2, 3, 4, 5, 7]))
    assert sorted((r.label, r.pos, r.key) for r in index) == [(label, i, k) for label in (1, 2, 3, 4, 5, 7) for i, k in enumerate(k for x, k in data if x == label)]


def test_relaxed_links(spark):
    kind = "ann string, passage_key string, type string, locations array<struct<offset:int,length:int>>"
    passages = spark.createDataFrame([("p", 10, "aa bb cc dd")], "passage_key string, offset int, text string")
    gold = spark.createDataFrame([("a", "p", "x", [(10, 5)], "CL:1"), ("b", "p", "x", [(16, 2)], "CL:1;CL:2"), ("c", "q", "y", [(0, 1)], "CL:3")], kind + ", identifier string")
    rows = [("k", "p", "x", [(13, 5)], "bb cc", "m", 0, "CL:1"), ("k", "p", "x", [(13, 5)], "bb cc", "m", 1, "CL:2"), ("l", "p", "x", [(10, 2)], "aa", "m", 0, "CL:2"), ("l", "p", "x", [(10, 2)], "aa", "m", 1, "CL:1"), ("n", "p", "y", [(10, 2)], "aa", "o", 0, "CL:1")]
    pred = spark.createDataFrame(rows, kind + ", text string, model string, rank int, pred_id string").withColumn("score", F.lit("1"))
    d = V.link_grid(gold, pred, passages, ["m", "o"], ("allLabels", "singleID"), {"all": None, "x": ["x"]}, (1, 2), V.MODES, None, None)
    got = {(r.model, r.gate, r.type_set, r.score_mode[:3], r.top): (r.tp, r.fp, r.fn) for r in d.collect()}
    assert len(got) == 2 * 2 * 2 * 3 * 2
    assert got["m", "allLabels", "all", "rel", 1] == (1, 1, 3) and got["m", "allLabels", "x", "rel", 2] == (3, 1, 0)
    assert got["m", "singleID", "all", "rel", 2] == (1, 3, 1) and got["o", "allLabels", "all", "rel", 1] == (0, 1, 4)
    assert got["m", "allLabels", "all", "end", 2] == (0, 4, 4)
    r = V.evaluate_links(gold, pred.where("model = 'm'").drop("model"), ("allLabels",), ["x"], (2,), V.MODES[2], None, passages, ["AA"]).head()
    assert (r.tp, r.fp, r.fn) == (2, 2, 1)
    with pytest.raises(ValueError, match="passages"):
        V.evaluate_links(gold, pred, mode=V.MODES[2])


XML = """<collection><document><id>7</id><passage><offset>0</offset><text>CD4⁺ and CD4+ cells</text>
<annotation id="T1"><infon key="Entity_Type"> b </infon><infon key="TYPE">c</infon><location offset="0" length="4"/><text>CD4⁺</text></annotation>
<annotation id="T2"><infon key="type"></infon><infon key="semantic_type">d</infon><location offset="9" length="4"/><text>CD4+</text></annotation></passage></document></collection>"""


def test_types_and_forms_of_files(spark, tmp_path):
    """The first type in the file, whatever its key's case; compatible forms are one."""
    (tmp_path / "a.xml").write_text(XML, encoding="utf-8")
    docs = bioc.read(spark, f"file:{tmp_path}/a.xml")
    assert [r.type for r in bioc.annotations(bioc.passages(docs)).orderBy("ann_id").collect()] == ["b", "d"]
    prefixed = re.sub(r"<(/?)(passage|annotation|infon|text|location|offset)", r"<\1b:\2", XML).replace("<collection>", '<collection xmlns:b="x">')
    again = annotated.documents(spark.createDataFrame([("p", prefixed)], "path string, xml string"), "xml")
    assert [r.type for r in bioc.annotations(bioc.passages(again)).orderBy("ann_id").collect()] == ["b", "d"]
    ontology = spark.createDataFrame([("CL:1", "CD4+", None)], "concept_id string, preferred_label string, synonyms array<string>")
    r = flows.vocabulary_overlap(spark, {"x": [f"file:{tmp_path}/a.xml"]}, ontology).head()
    assert (r.n_forms, r.n_matched) == (1, 1)


def test_second_try(spark):
    """A long form without candidates leaves the mention to the model; ranks are kept."""

    @F.pandas_udf("array<float>")
    def encode(x):
        return x.map(lambda s: [0.0, 0.0] if s.startswith("zero") else [1.0, float(len(s))])

    ontology = spark.createDataFrame([("CL:1", "DC", None), ("CL:2", "D", None), ("CL:3", "DCDC", ["x"])], "concept_id string, preferred_label string, synonyms array<string>")
    keys = A.lookup(spark.createDataFrame([("DC", "CL:1", 0), ("DC", "CL:2", 1)], "short_form string, identifier string, line int"))
    defined = spark.createDataFrame([("d", "DC", "zero", 0), ("e", "DC", "long", 0)], "doc_key string, key string, long_form string, ord int")
    m = spark.createDataFrame([("d", "DC"), ("e", "DC")], "doc_key string, mention string")
    got = {r.doc_key: r for r in L.link(m, ontology, keys, defined, encode, ranks=3).collect()}
    assert got["d"].source == "model_normal" and got["d"].identifier == "CL:1" and got["d"].expanded_long_form is None
    assert got["e"].source == "abbreviation_ambiguous_via_long_form" and len(got["e"].hits) == 3
    xml, matched, _ = annotated.put_links(XML.replace("CD4+</text></ann", "DC</text></ann").encode(), [{**got["d"].asDict(True), "doc_key": "7", "mention": "DC"}], "m", True, 3)
    assert matched == 1 and re.findall(r'key="m_id_(\d)">(CL:\d)<', xml) == [(str(k), h.identifier) for k, h in enumerate(got["d"].hits)]
    assert all(re.fullmatch(r"-?\d+\.\d{3}", x) for x in re.findall(r'score_\d">([^<]*)<', xml))
