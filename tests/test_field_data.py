"""Answers of the field-data service, from bytes to the audit's rules."""

import json

from pyspark.sql import functions as F

from webgauge.operators import vitals
from webgauge.plans import audit


def answer(**p75):
    names = {v: k for k, v in vitals.SERVICE_NAMES.items()}
    return json.dumps({"record": {"metrics": {names[k]: {"histogram": [{"density": 0.7}, {}, {"density": 0.1}], "percentiles": {"p75": v}} for k, v in p75.items()}}})


def test_answers(spark):
    rows = [("a", 200, answer(lcp=2500, cls="0.12")), ("b", 200, answer(lcp="NaN", inp="Infinity")), ("c", 200, "null"), ("d", None, None), ("e", 404, "<html>"), ("f", 200, answer(lcp=None, ttfb=1)), ("f", 200, answer(lcp=None, ttfb=1)), (None, 503, "{}")]
    got = vitals.field_data(spark.createDataFrame(rows, "target string, status int, body string").withColumn("scope", F.lit("url"))).collect()
    by = {r.target: (r.reason, r.data) for r in got}
    assert len(got) == len(rows)
    assert by["a"] == (None, {"lcp": 2500.0, "cls": 0.12}) and by["b"] == ("no-data", None) and by["d"] == ("network", None) and by["e"] == ("bad-response", None) and by["f"] == (None, {"ttfb": 1.0}) and by[None] == ("error", None)
    assert by["c"][0] == "no-data"
    rated = vitals.rated(vitals.records(vitals.field_data(spark.createDataFrame(rows[:1], "target string, status int, body string").withColumn("scope", F.lit("url"))))).collect()
    assert {(r.metric, r.rating, r.good, r.needs_improvement, r.poor) for r in rated} == {("lcp", "good", 70, 0, 10), ("cls", "needs-improvement", 70, 0, 10)}


def test_answers_reach_the_audit(spark):
    pages = spark.createDataFrame([(i, f"https://a.com/{i}", "<p>x") for i in range(3)], "page_id int, url string, html string").withColumn("as_of", F.lit("2024-06-01").cast("timestamp"))
    files = spark.createDataFrame([("https://a.com", 404, None)], "origin string, status int, text string")
    maps = spark.createDataFrame([("https://a.com/sitemap.xml", 404, None)], "url string, status int, xml string")
    field = spark.createDataFrame([("https://a.com/0", "url", 200, answer(lcp=1000)), ("https://a.com/1", "url", 404, "{}"), ("https://a.com/2", "url", 403, "{}"), ("https://a.com", "origin", 200, answer(lcp=5000))], "target string, scope string, status int, body string")
    got = {r.page_id: (r.vitals and r.vitals["lcp"], r.vitals_reason) for r in audit.with_context(audit.Fetched(pages, files, maps, files, None, None, field)).collect()}
    assert got == {0: (1000.0, None), 1: (5000.0, None), 2: (None, "forbidden")}
