import difflib

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.udfs import flatten_synonyms, nfkc, sequence_ratio


def apply(spark, sql, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(F.expr(sql("x"))).collect()]


def test_singular(spark):
    words = "cells viruses glasses ponies movies zombies trees axes bus ss eies aies s Cells".split()
    assert apply(spark, T.singular, words) == "cell virus glass pony movy zomby tree axe bus ss eie aie  Cell".split(" ")


def test_plural_normalize_is_not_idempotent(spark):
    assert apply(spark, T.plural_normalize, ["cell's wall", "", "T cells"]) == ["cell '  wall", "", "T cell"]


def test_keys(spark):
    assert apply(spark, T.abbreviation_key, [" N-K–T  cell ", ""]) == ["NKTcell", ""]
    assert apply(spark, T.variant_keys, ["DCs", "DC", "s", ""]) == [["DCs", "DC"], ["DC", "DCs"], ["s", "ss"], ["s"]]
    assert apply(spark, T.threshold, ["ABCD", "ABCDE", "ABCDEFG", "ABCDEFGH"]) == [1.0, 0.95, 0.95, 0.9]
    assert apply(spark, T.abbreviation_like, ["DC", "a", "dendritic", "a long lower phrase", "x+", "", None]) == [True, False, True, False, True, False, False]


def test_relaxed(spark):
    got = apply(spark, T.relaxed, ["(NK–cells).", "species", "stem cells niches", "series", "Bodies", "“T_cells”", ""])
    assert got == ["nk cell", "specie", "stem cell nich", "serie", "body", '"t cell"', ""]


def test_identifiers(spark):
    values = ["(skos:exact)CL:1", "(skos:related)CL:1", "CL:1;CL:2", "-", "None", "", " CL:3 "]
    assert apply(spark, T.split_identifiers, values) == [["CL:1"], ["CL:1"], ["CL:1", "CL:2"], [], [], [], ["CL:3"]]
    assert apply(spark, lambda x: T.single_id(x, True), values) == [True, False, False, False, False, False, True]
    assert apply(spark, lambda x: T.single_id(x, False), values) == [True, True, False, False, False, False, True]
    assert apply(spark, T.ontology_ids, ["xCL:1 CL_22, cl: 3"]) == [["CL:22", "CL:3"]]
    assert apply(spark, T.id_case, ["cl_5", "CL:5"]) == ["CL:5", "CL:5"]


def test_byte_offsets(spark):
    assert apply(spark, lambda x: T.byte_offset(x, "3"), ["aé😀b", "abc"]) == [7, 3]


@pytest.mark.parametrize("a,b", [("t cell", "b cell"), ("", "x"), ("dendritic cell", "dendritic cells")])
def test_sequence_ratio(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(sequence_ratio("a", "b")).head()[0]
    assert got == difflib.SequenceMatcher(None, a, b).ratio()


def test_udfs(spark):
    d = spark.createDataFrame([('["a", {"k": ["b", null]}, 3]', "ﬁ"), ("plain", None)], "s string, t string")
    rows = d.select(flatten_synonyms("s").alias("s"), nfkc("t").alias("t")).collect()
    assert [r.s for r in rows] == [["a", "b", "3"], ["plain"]]
    assert [r.t for r in rows] == ["fi", None]
