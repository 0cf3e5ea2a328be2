"""The link evaluation over the grid, and all pairs of vectors."""

import os
import random
import re

import pyarrow as pa
import pytest

from glossa.functions import vector
from glossa.operators import evaluate as V
from glossa.operators import spans as S
from glossa.plans.queries import queries

SMALL = "/root/testdata/sf0.001"
PLACE = "array<struct<offset:int,length:int>>"


def test_every_named_model_is_scored(spark):
    """Predictions that name models are scored by model where none is asked for."""
    gold = spark.createDataFrame([("1", 7, "a", [(0, 2)], "CL:1")], f"ann string, passage_key int, type string, locations {PLACE}, identifier string")
    rows = [("1", 7, "a", [(0, 2)], 0, "CL:1", "1", "m"), ("1", 7, "a", [(0, 2)], 0, "CL:2", "1", "n"), ("1", 7, "a", [(0, 2)], 0, "CL:3", "1", None)]
    pred = spark.createDataFrame(rows, f"ann string, passage_key int, type string, locations {PLACE}, rank int, pred_id string, score string, model string")
    d = V.evaluate_links(gold, pred, ("allLabels",), tops=(1,), mode=V.MODES[1])
    assert sorted((r.model, r.tp, r.fp, r.fn) for r in d.collect()) == [("m", 1, 0, 0), ("n", 0, 1, 1)]
    one = V.evaluate_links(gold, pred.where("model = 'n'").drop("model"), ("allLabels",), tops=(1,))
    assert one.columns[0] == "gate" and [(r.tp, r.fp, r.fn) for r in one.collect()] == [(0, 1, 1)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_whole_grid(spark):
    """Both sets of types, and ten surviving ranks of each annotation where there are as many."""
    got = {(r.type_set, r.score_mode, r.gate, r.top): r.tp + r.fp for r in queries()["evaluate_link_grid"](spark, SMALL).collect()}
    assert len(got) == 2 * 2 * 3 * 3
    parts = spark.read.parquet(f"{SMALL}/part.parquet").select("p_partkey", "p_brand", "p_type").collect()
    for name, kinds in (("all", None), ("sizes", ("LARGE", "MEDIUM", "SMALL"))):
        found = set()
        for k, brand, kind in parts:
            if kinds is None or kind in kinds:
                alive = [k + r - 3 for r in range(12) if (k + r) % 9]
                found |= {(brand, kind, k + (k % 4 == 0), x) for x in alive[:10]}
        assert got[name, "end_to_end", "allLabels", 10] == len(found)


def test_pairs_shuffle_no_terms(spark, monkeypatch):
    """Every pair of blocks meets, and only the queries are dealt anew."""
    monkeypatch.setattr(vector, "PAIR_QUERIES", 3)
    monkeypatch.setattr(vector, "PAIR_TERMS", 4)
    monkeypatch.setattr(vector, "PAIR_LEAST", 1)
    rows = [(k, [float(k % 5 - 2), 1.0, float(k % 3)]) for k in range(40)] + [(40, None), (41, []), (42, [0.0, 0.0, 0.0]), (43, [1.0, 2.0]), (44, [1.0, None, 2.0])]
    terms = spark.createDataFrame(rows, "k long, embedding array<float>").repartition(3)
    d = vector.distances(terms.where("k % 4 = 0"), terms, "k", "k")
    cosine = vector.cosine_distance("a.embedding", "b.embedding")
    both = terms.alias("a").where("k % 4 = 0 and size(embedding) > 0").crossJoin(terms.alias("b"))
    want = both.selectExpr("a.k", "b.k", f"round(case when size(a.embedding) = size(b.embedding) then {cosine} end, 9) + 0D d")
    assert sorted(map(str, map(tuple, d.collect()))) == sorted(map(str, map(tuple, want.collect())))
    plan = vector.distances(spark.range(9).selectExpr("id k", "array(1F) embedding"), spark.range(99).selectExpr("id k", "array(1F) embedding"), "k", "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" in plan


def _made(spark):
    """Annotations in any order with shared places, ranks with gaps, odd ids, types and places."""
    draw = random.Random(5)
    texts = {k: "".join(draw.choice(["aa ", "b", "é ", "😀", " ", "_", ". ", "cc"]) for _ in range(12)) for k in range(6)}
    place = lambda: [(draw.randrange(3, 25), draw.randrange(0, 7)) for _ in range(draw.choice([1, 1, 1, 2, 0]))]
    name = lambda: draw.choice(["CL:1", "CL:2", " CL:1 ", "CL:1;CL:2", "-", "(skos:related)CL:2", "(skos:exact)CL:1"])
    gold = [(str(a), draw.choice([*range(7), None]), draw.choice(["x", "y", None]), place(), name()) for a in range(90)]
    pred = [(str(draw.randrange(90)), draw.choice([*range(7), None]), draw.choice(["x", "y", None]), place(), draw.choice(["one", "Two", None]), draw.choice(["m", "n", "o", None]), r, draw.choice(["CL:1", "CL:2", "none"]), "0.5") for r in range(400)]
    pred += [(g[0], g[1], g[2], g[3], "t", m, 900 + r, f"CL:{r}", "1") for g in gold[::2] for m in "mn" for r in (1, 2)]
    draw.shuffle(pred)
    kind = f"ann string, passage_key int, type string, locations {PLACE}"
    docs = [(k, 3, t) for k, t in texts.items()] + [(None, 0, "aa"), (6, 0, "")]
    g, p = spark.createDataFrame(gold, kind + ", identifier string"), spark.createDataFrame(pred, kind + ", text string, model string, rank int, pred_id string, score string")
    return g.repartition(3), p.repartition(3), spark.createDataFrame(docs, "passage_key int, offset int, text string"), texts


def test_tally_of_all_modes(spark):
    """All modes of a passage in one row: as the exact modes alone, and as spans compared one by one."""
    gold, pred, docs, texts = _made(spark)
    sets, tops = {"all": None, "x": ["x"]}, (1, 2, 7)
    key = lambda d: {(r.model, r.gate, r.type_set, r.score_mode, r.top): (r.tp, r.fp, r.fn) for r in d.collect()}
    got = key(V.link_grid(gold, pred, docs, ["m", "n"], V.GATES, sets, tops, V.MODES, 0.4, ["TWO"]))
    exact = key(V.link_grid(gold, pred, None, ["m", "n"], V.GATES, sets, tops, V.MODES[:2], 0.4))
    assert len(got) == 2 * 3 * 2 * 3 * 3 and {k: n for k, n in got.items() if k[3] != V.MODES[2]} == exact
    golds = {(r.passage_key, r.type, r.gold_id, tuple(sorted(r.locations))) for r in V.gated_ids(gold, ["allLabels"]).collect()}
    by: dict = {}
    for r in V.ranked_ids(pred, 0.4).where("model = 'm'").collect():
        by.setdefault((r.passage_key, r.ann), []).append((r.rank, r.type, tuple(sorted(r.locations)), r.pred_id, r.text != "Two"))
    tuples = {(k[0], x[1], x[3], x[2]) for k, rows in by.items() for x in sorted(rows)[:2] if x[4]}
    edges = []
    for g in golds:
        for p in tuples:
            common = [(max(a, b) - 3, min(a + n, b + k) - 3) for a, n in g[3] for b, k in p[3]]
            if g[:3] == p[:3] and g[0] in texts and any(b > 0 and re.search(r"\w", texts[g[0]][max(a, 0) : b]) for a, b in common if b > a):
                edges.append((g, p))
    near = V.graph([(sorted(golds, key=repr).index(g), sorted(tuples, key=repr).index(p)) for g, p in edges])
    assert len(edges) > len(near) > 5 and got["m", "allLabels", "all", V.MODES[2], 2][0] == V.matched(near)


def test_passages_are_dealt_once(spark):
    """One shuffle brings golds, predictions and texts together, a row for a run of a passage."""
    gold, pred, docs, _ = _made(spark)
    plan = V.link_grid(gold, pred, docs, ["m"], V.GATES, None, (1,), V.MODES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(passage_key") == 1 and "hashpartitioning(type" not in plan and "ann#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    runs = pa.record_batch({"k": [1, 1, 1, 2, 2, 1], "ann": list("aabbbb"), "type": ["x"] * 6, "loc": ["[]"] * 5 + [None], "shut": [False] * 6, "rank": range(6), "model": [0] * 6, "link": list("uvwxyz")})
    (one,) = V._pred_runs([runs])
    assert one.column(0).to_pylist() == [1, 2, 1] and [[x["link"] for x in r] for r in one.column(1).to_pylist()] == [[["u", "v"], ["w"]], [["x", "y"]], [["z"]]]


def test_words_of_an_ending(spark):
    """Words that end otherwise become no rows; places are those in the whole text."""
    docs = spark.createDataFrame([(1, "é sing, ing mentions mention 😀 king"), (2, None), (3, "ions")], "k int, t string")
    got = S.token_spans(docs, "k", "t", S.ASCII, ("ing", "tion")).collect()
    want = S.token_spans(docs, "k", "t", S.ASCII).where("token rlike '(ing|tion)$'").collect()
    assert sorted(got) == sorted(want) and len(got) == 4


def test_exact_modes_meet_once(spark):
    """Both exact modes come from one shuffle of annotations and one of tuples."""
    gold, pred, _, _ = _made(spark)
    plan = V.link_grid(gold, pred, None, ["m"], V.GATES, None, (1,))._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "hashpartitioning(passage_key" in x]) == 2
