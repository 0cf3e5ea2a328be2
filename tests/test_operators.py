import random

import numpy as np
import pandas as pd

from glossa.functions import vector
from glossa.functions.vector import nearest
from glossa.operators import abbreviations as A
from glossa.operators import corpus as C
from glossa.operators import evaluate as V
from glossa.operators import linking as L
from glossa.operators import recognize as R
from glossa.operators import spans as S


def rows(d):
    return sorted(map(tuple, d.collect()))


def test_decode_tags(spark):
    draw = random.Random(1)
    data, expected = [], []
    for key in range(20):
        tags, active = [], None
        for pos in range(30):
            tag = draw.choice(["O", "B-x", "I-x", "I-y", "B-y"])
            width = draw.choice([0, 1, 1, 1])
            data.append((key, pos, tag, 10 * pos, 10 * pos + width))
            if not width:
                continue
            if tag == "O":
                active = None
            elif active and tag == f"I-{active[0]}":
                active[2] = 10 * pos + width
            else:
                active = [tag[2:], 10 * pos, 10 * pos + width]
                tags.append(active)
        expected += [(key, *t) for t in tags]
    d = spark.createDataFrame(data, "k int, pos int, tag string, s int, e int")
    assert rows(S.decode_tags(d, "k", ["pos"], "tag", "s", "e").drop("n_tokens")) == sorted(expected)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "one two three four five")], "k int, text string")
    tokens = S.token_spans(docs, "k")
    assert rows(tokens.select("start", "end")) == [(0, 3), (4, 7), (8, 13), (14, 18), (19, 23)]
    ents = spark.createDataFrame([(1, 0, "x", 0, 7), (1, 1, "y", 4, 13), (1, 2, "x", 15, 23)], "k int, entity int, label string, start int, end int")
    expand = [r.tag for r in S.encode_tags(tokens, ents, "k").orderBy("pos").collect()]
    assert expand == ["B-x", "B-y", "I-y", "B-x", "I-x"]
    skip = [r.tag for r in S.encode_tags(tokens, ents, "k", "skip").orderBy("pos").collect()]
    assert skip == ["B-x", "B-y", "I-y", "O", "O"]


def test_places_are_code_points(spark):
    text = "😀 naïve T cells"
    d = S.token_spans(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    for r in d.collect():
        assert text[r.start : r.end] == r.token


def test_chunks(spark):
    for n in (0, 1, 100, 510, 511, 892, 893, 2000):
        d = spark.createDataFrame([(1, n)], "k int, n int")
        got = [(r.first, r.last) for r in S.chunks(d, "k", "n").orderBy("chunk").collect()]
        want, at = [], 0
        while True:
            want.append((at, min(at + 510, n)))
            if at + 510 >= n:
                break
            at += 382
        assert got == want, n


def test_matching_is_maximum():
    draw = random.Random(2)
    for _ in range(60):
        edges = {(draw.randrange(5), draw.randrange(5)) for _ in range(draw.randrange(1, 10))}

        def best(left, used):
            if not left:
                return 0
            r, rest = left[0], left[1:]
            return max([best(rest, used), *(1 + best(rest, used | {p}) for q, p in edges if q == r and p not in used)])

        got = V.matching(pd.DataFrame(sorted(edges), columns=["ref", "pred"]))
        assert got == best(sorted({r for r, _ in edges}), frozenset())


def test_relaxed_spans(spark):
    docs = spark.createDataFrame([("p", "aa bb cc dd")], "passage_key string, text string")
    kind = "passage_key string, id int, type string, start int, end int, text string"
    refs = spark.createDataFrame([("p", 0, "x", 0, 5, "aa bb"), ("p", 1, "x", 6, 8, "cc"), ("q", 2, "x", 0, 1, "z")], kind)
    preds = spark.createDataFrame([("p", 0, "x", 3, 8, "bb cc"), ("p", 1, "x", 0, 2, "aa"), ("p", 2, "y", 9, 11, "dd")], kind)
    r = V.relaxed_spans(refs, preds, docs).head()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1)
    r = V.relaxed_spans(refs, preds, docs, ["AA"]).head()
    assert (r.tp, r.fp, r.fn) == (1, 2, 2)


def test_definitions():
    assert A.definitions("We used natural killer (NK) cells.") == [("NK", "natural killer")]
    assert A.definitions("Dendritic cells (DCs) and T helper (Th) cells") == [("DCs", "Dendritic cells"), ("Th", "T helper")]
    assert A.definitions("no pair (here is prose)") == [] and A.definitions("") == []


def test_cascade(spark):
    wanted = spark.createDataFrame([("d", "DC"), ("d", "NKT"), ("d", "LONGKEYS"), ("d", "XY")], "doc_key string, key string")
    defined = spark.createDataFrame([("d", "DCs", "dendritic", 0), ("d", "NKT", "old", 1), ("d", "NKT", "new", 2), ("d", "LONGKEYSX", "long", 3)], "doc_key string, key string, long_form string, ord int")
    got = {r.key: (r.method, r.long_form) for r in A.cascade(wanted, defined).collect()}
    assert got == {"DC": ("exact_variant", "dendritic"), "NKT": ("exact_key", "new"), "LONGKEYS": ("fuzzy", "long")}


def test_nearest(spark, monkeypatch):
    draw = random.Random(3)
    vectors = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(99, [0.0] * 6)]
    d = spark.createDataFrame(vectors, "i long, embedding array<float>")
    for block in (4, 1000):
        monkeypatch.setattr(vector, "QUERIES", block)
        got = nearest(d.where("i < 9"), d, 3, "i", "i")
        assert got.count() == 27
        assert {(r.query_id, r.term_id) for r in got.where("rank = 1").collect()} == {(i, i) for i in range(9)}


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "The T cell and Natural killer T cells."), (2, ""), (3, None)], "passage_id int, text string")
    terms = spark.createDataFrame([("natural killer t cells",), ("T cell",), ("killer",)], "term string")
    got = R.recognize(docs, R.gazetteer(terms)).orderBy("start").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("T cell", 4, 10), ("Natural killer T cells", 15, 37)]


def test_running_ids(spark):
    d = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    got = {r.k: r.id for r in S.running_ids(d, ["k"]).collect()}
    assert got == {k: k for k in range(101)} and S.RANGES
    S.drop_ranges(spark)
    assert not S.RANGES


def test_empty_corpus(spark):
    d = spark.createDataFrame([], "concept string, name string")
    assert C.drop_ambiguous(d).count() == 0
    assert C.ambiguity_statistics(d).head().names_before == 0


def test_numbers_within_groups(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(200)] + [(i, None) for i in range(5)]
    d = spark.createDataFrame(rows, "k long, g string").repartition(5)
    got = sorted((r.g or "", r.id, r.k) for r in S.ids_within(d, "g", ["k"]).collect())
    for g in ("a", "b", ""):
        own = [(i, k) for x, i, k in got if x == g]
        assert [i for i, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    assert S.running_ids(d.limit(0), ["k"]).count() == 0


def test_nearest_in_cells(spark, monkeypatch):
    """Several blocks on both sides, zero vectors and ties, against brute force."""
    monkeypatch.setattr(vector, "QUERIES", 7)
    monkeypatch.setattr(vector, "TERMS", 11)
    draw = np.random.default_rng(1)
    x = draw.integers(-2, 3, (60, 4)).astype(np.float32)
    x[5] = 0
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<float>")
    got = {}
    for r in vector.nearest(e.where("i < 20"), e, 4, "i", "i", "v").orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.term_id))
    unit = {i: v / np.linalg.norm(v) for i, v in enumerate(x.astype(float)) if v.any()}
    want = {q: sorted((round(1 - float(unit[q] @ unit[t]), 9) + 0.0, t) for t in unit)[:4] for q in unit if q < 20}
    assert got.keys() == want.keys()
    assert all(np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], atol=2e-9) for q in want)
    assert all([t for _, t in got[q]] == [t for _, t in want[q]] for q in want)


def test_nearest_abbreviation_keys(spark):
    """Long keys are found by similarity, short ones exactly only."""
    keys = A.lookup(spark.createDataFrame([("REGULATORYCELLSUBSETABCXYZ", "CL:1", 0), ("NK", "CL:2", 1)], "short_form string, identifier string, line long"))
    m = spark.createDataFrame([("d", "REGULATORYCELLSUBSETABCXYZs"), ("d", "NKs"), ("d", "NK"), ("d", "QWERTZUIOP")], "doc_key string, mention string")
    none = spark.createDataFrame([], "doc_key string, key string, long_form string, ord int")
    got = {r.mention: (r.kind, r.identifier, r.key_method) for r in A.resolve(m, keys, none, encoder=L.hashed_encoder()).collect()}
    assert got == {"REGULATORYCELLSUBSETABCXYZs": ("direct", "CL:1", "encoder_abbreviation_match"), "NKs": ("none", None, None), "NK": ("direct", "CL:2", "exact_short_abbreviation"), "QWERTZUIOP": ("none", None, None)}


def test_baseline_linker(spark):
    terms = L.ontology_terms(spark.createDataFrame([("cl_1", "T cell", ["T lymphocyte"]), ("CL:2", "dendritic cell", None)], "concept_id string, preferred_label string, synonyms array<string>"))
    defined = spark.createDataFrame([("d", "DC", "dendritic cell", 0)], "doc_key string, key string, long_form string, ord int")
    m = spark.createDataFrame([("d", "DC"), ("d", "T cell"), ("d", " ")], "doc_key string, mention string")
    got = {(r.mention, r["rank"]): (r.identifier, r.name) for r in L.baseline_link(m, terms, defined, threshold=0.5).collect()}
    assert got["DC", 0] == ("CL:2", "dendritic cell") and got["T cell", 0] == ("CL:1", "T cell")
    ids = spark.createDataFrame([("cl_1",), ("CL:9",)], "identifier string")
    entries = spark.createDataFrame([("cl:1", "T cell")], "id string, name string")
    assert {r.identifier: r.name for r in L.entry_names(ids, entries).collect()} == {"CL:1": "T cell", "CL:9": "CL:9"}


def test_index(spark, monkeypatch):
    """The index gives the hits of all cells, and reads few rows where directions cluster."""
    draw = np.random.default_rng(8)
    base = draw.normal(size=(30, 12))
    x = np.vstack([base[draw.integers(0, 30, 1500)] + draw.normal(size=(1500, 12)) * 0.05, draw.normal(size=(40, 12)), np.repeat(base[:1], 50, axis=0), np.zeros((2, 12))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0])], "i long, embedding array<float>")
    q = d.where("i % 9 = 0")
    for terms in (16_384, 40):
        monkeypatch.setattr(vector, "TERMS", terms)
        index = vector.Index(d, "i", centers=40)
        for k in (1, 7, 90):
            assert rows(index.nearest(q, k, "i")) == rows(nearest(q, d, k, "i", "i"))
    one, _, two = index.probes(q, 7, "i")
    read = sum(int(index.size[r.cluster]) for part in (one, two) for r in part.collect())
    assert index.size.sum() == len(x) - 2 and read < 0.15 * one.select("i").distinct().count() * len(x)
    index.drop()
    empty = vector.Index(d.limit(0), "i")
    assert empty.nearest(q, 3, "i").count() == 0
    terms = L.ontology_terms(spark.createDataFrame([(f"CL:{i}", f"name {i} {i % 7}", None) for i in range(60)], "concept_id string, preferred_label string, synonyms array<string>"))
    asked = spark.createDataFrame([(f"name {i}",) for i in range(9)], "query string")
    got = [rows(L.retrieve(asked, terms, L.hashed_encoder(), 3, 20, index)) for index in (None, L.term_index(terms, L.hashed_encoder()))]
    assert got[0] == got[1] and len(got[0]) == 27
