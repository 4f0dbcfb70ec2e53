"""Robots decisions on the path of every part."""

import os

import pytest

from webgauge.queries import QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", ["robots_crawler_access", "robots_crawler_grid", "robots_search_blocked"])
def test_every_part_has_decisions(spark, name):
    parts = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").distinct().count()
    assert QUERIES[name](spark, DATA).select("origin", "path").distinct().count() == parts > 400
