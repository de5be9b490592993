"""Every registered panel query against its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: "" if v is None or v is pd.NaT or v != v else f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    out = []
    for r in df.astype(object).itertuples(index=False):
        out.append(tuple(text(v.item() if hasattr(v, "item") else v)[:60].removesuffix(" 00:00:00") for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    spark.catalog.clearCache()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    bad = [(x, y) for x, y in zip(rows(a), rows(b)) if x != y]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).limit(5).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    assert catalog.entry(spark, "/root/testdata/sf0.001").count() > 0
