"""Every query with SQL gives that SQL's rows on the smallest tables."""

import os

import pandas as pd
import pytest

from terrace import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple("" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows)


def duckdb_views():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    expected = duckdb_views().execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)


def test_entry_modules_agree():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in registry.queries()
