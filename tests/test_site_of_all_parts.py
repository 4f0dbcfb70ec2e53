"""Link analysis over every part."""

import os

import pytest

from webgauge.queries import QUERIES

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_orphans_are_all_parts_without_a_link(spark):
    from webgauge.queries.site import links_of_lineitem, pages_of_parts

    linked = {(r.site_key, r.dst) for r in links_of_lineitem(spark, DATA).collect()}
    want = {(r.site_key, r.url) for r in pages_of_parts(spark, DATA).select("site_key", "url").collect()} - linked
    got = [tuple(r) for r in QUERIES["site_orphans"](spark, DATA).select("site_key", "url").collect()]
    assert sorted(got) == sorted(want)
    assert max(int(u[2:]) for _, u in got) >= 500


def test_targets_span_all_parts(spark):
    for name, column in (("site_inbound_links", "dst"), ("crawl_depths", "url")):
        assert QUERIES[name](spark, DATA).select(column).distinct().count() > 1000
