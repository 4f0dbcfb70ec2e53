"""Reports of pages are joined by sorting: their parts, small in files, aren't sent through the driver."""

from webgauge.plans import report


def test_no_part_of_a_report_is_broadcast(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<title>One</title><p>some words of a page</p>")], "page_id long, url string, html string")
    out = report.page_reports(pages)
    audited = report.audited(pages)
    for made in (out, report.page_summaries(audited, report.findings(audited))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    (row,) = out.collect()
    assert row.page.title == "One" and row.categories and row.todos
