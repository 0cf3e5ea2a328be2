import os

import pytest

import __spark_entry__
import corpus_pipeline
from glossa.llm import mixing

SMALL = "/root/testdata/sf0.001"


def test_names():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_dedup", "private", "mixed", "packed"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_odd_rows_pass(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
        assert out.count() >= (docs.count() > 0)


def test_run_follows_the_schedule(spark, tmp_path, monkeypatch):
    """Each text fills one sequence and begins another: both kinds are numbered along the mix."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    monkeypatch.setattr(corpus_pipeline, "RANGE_ROWS", 40)
    source = {i: "a" if i < 300 else "b" if i < 400 else "c" for i in range(450)}
    d = spark.createDataFrame([(i, f"t{i} " + "word " * (2100 + i), "en", s, 0) for i, s in source.items()], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    schedule = [r.source for r in mixing.mix(d, mixing.tempered_weights(d)).orderBy("position").collect()]
    number = {r.sequence_id: r.position for r in rows}
    assert sorted(number.values()) == list(range(len(number)))
    full = [r.doc_id for r in sorted(rows, key=lambda r: r.position) if r.length == 2048]
    assert len(full) == 450 and [source[i] for i in full] == schedule
    place = {i: k for k, i in enumerate(full)}
    members = {}
    for r in rows:
        members.setdefault(r.position, []).append(place[r.doc_id])
    firsts = [min(members[k]) for k in sorted(members)]
    assert firsts == sorted(firsts)
    assert max(max(v) - min(v) for v in members.values()) < 225
