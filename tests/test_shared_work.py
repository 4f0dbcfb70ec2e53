"""What pages share is worked out once, with the same results."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from webgauge.operators import extract
from webgauge.plans import report


def test_findings_of_wanted_fields(spark):
    html = "<!doctype html><html lang=en><head><title>Solar panels panels</title></head><body><h1>Solar</h1><p>Words about panels.</p></body></html>"
    pages = report.audited(spark.createDataFrame([(1, "https://a.com/x", html), (2, "https://a.com/y", "")], "page_id long, url string, html string").withColumn("as_of", F.lit("2024-06-01").cast("timestamp")))
    for mode in ("seo", "geo"):
        some = report.findings(pages, mode, ("check", "find_pos", "status"))
        assert some.columns == ["page_id", "check", "find_pos", "status"]
        assert sorted(some.collect()) == sorted(report.findings(pages, mode).select(*some.columns).collect())


def test_paragraphs_seen_before_are_not_judged_again():
    text = "It is is so,, here."
    extract._remembered_issues.cache_clear()
    once = extract.text_issues([text])
    assert [i["note"] for i in once] == ['"is is"', ",,"]
    assert extract.text_issues([text, text]) == once and extract._remembered_issues.cache_info().hits == 2
    long = "word " * 1000
    assert extract.text_issues([long]) == extract.text_issues([long, long]) and extract._remembered_issues.cache_info().currsize == 1


def test_addresses_from_the_root_are_the_same_on_all_pages():
    for base in ("https://A.com:8080/x/y?z=1#f", "http://u:p@a.com", "https://[::1]/p/", "https://[bad/p", "ftp://a.com/x", "", "https:///x"):
        for href in ("/p", "//b.com/q", "/", "/a/../b?c#d", "https://b.com", "http://b.com/x y", "https:/odd", "x", "?q", "https://[bad", " /s ", "/ü"):
            try:
                joined = urljoin(base, href.strip())
            except ValueError:
                joined = None
            got = extract._absolute(href, base)
            assert got == extract._resolved.__wrapped__(href.strip(), base), (base, href)
            assert (got is None) or joined is not None
