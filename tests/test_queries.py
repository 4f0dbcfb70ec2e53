"""Registered queries against their SQL on the smallest tables, where these are there."""

import os

import pandas as pd
import pytest

from webgauge.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and pd.isna(x):
        return ""
    x = x.item() if hasattr(x, "item") else x
    return repr(int(x)) if isinstance(x, float) and x.is_integer() else repr(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE[name]).df())


def test_plans_prune_and_push_down(spark):
    """A query of two columns reads two columns; a filter on a column reaches the scan."""
    from webgauge.queries.text import text_stop_words

    plan = text_stop_words(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60
