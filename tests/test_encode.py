"""The learned encoder against the plain one."""

import random

import numpy as np

from glossa.functions import encode
from glossa.functions.encode import fit_encoder, trigrams
from glossa.operators import linking as L


def test_trigrams():
    row, bucket = trigrams(["ab", "", None, "abab", "AB"])
    sets = [set(bucket[row == k].tolist()) for k in range(5)]
    assert [len(s) for s in sets] == [3, 1, 1, 5, 3] and sets[0] == sets[4] and sets[1] == sets[2]


def test_recall_on_held_out_synonyms(spark):
    """Recall at 1 of held-out synonyms: terms share common words, concepts rare ones."""
    draw = random.Random(9)
    stem = lambda: "".join(draw.choice("bcdfglmnprstv") + draw.choice("aeiou") for _ in range(3))
    common = ["human cell", "cell of the", "positive lymphocyte", "peripheral blood", "epithelial cell", "derived", "progenitor cell"]
    concepts, held = [], []
    for i in range(150):
        rare = [stem(), stem()]
        name = lambda rare=rare: " ".join(draw.sample([*rare, *draw.sample(common, 3)], 5))
        concepts.append((f"CL:{i}", name(), [name()]))
        held += [(name(), f"CL:{i}"), (f"{rare[0]}s {draw.choice(common)} {draw.choice(common)}", f"CL:{i}")]
    terms = L.ontology_terms(spark.createDataFrame(concepts, "concept_id string, preferred_label string, synonyms array<string>"))
    asked = spark.createDataFrame(list(dict(held).items()), "query string, want string")
    learned = fit_encoder(terms, "name")

    def recall(encoder):
        hits = L.retrieve(asked.select("query"), terms, encoder, 1, 10)
        return hits.join(asked, "query").where("identifier = want").count() / asked.count()

    plain, own = recall(L.hashed_encoder()), recall(learned.column(spark))
    print(f"recall at 1: hashed {plain:.3f}, learned {own:.3f}")
    assert own > plain + 0.3 and own > 0.8


def test_fit_is_stable(spark):
    """Partitions and order do not matter; nulls and empty tables pass."""
    rows = [(f"name {i % 7} of {i}",) for i in range(50)] + [(None,), ("",)]
    d = spark.createDataFrame(rows, "name string")
    one, two = fit_encoder(d, dimensions=32), fit_encoder(d.repartition(5).orderBy("name"), dimensions=32)
    assert np.allclose(one.projection, two.projection, atol=1e-8) and (one.idf == two.idf).all()
    assert np.allclose(np.linalg.norm(one.vectors(["x", "name 1"]), axis=1), 1)
    assert fit_encoder(d.limit(0), dimensions=8).vectors(["a"]).shape == (1, 8) and encode.BUCKETS == len(one.idf)
