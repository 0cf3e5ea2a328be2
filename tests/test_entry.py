import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found)


@pytest.mark.parametrize("name", ["text_keys", "abbrev_resolve", "link_topk_concepts", "bio_decode", "span_token_overlap_join", "link_prf_grid", "ambiguous_name_filter", "annotate_e2e"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda d: sorted(repr([None if x is None or x != x else x if isinstance(x, str) else float(x) for x in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert clean(got) == clean(want)
