"""Sitemaps of all pages."""

from webgauge.queries import QUERIES


def test_every_page_is_in_a_sitemap(spark, tmp_path):
    """More pages than 400 and than 300 rows; an origin of over 500 gives 500."""
    pages = [(i, f"https://h{i % 7}.example/p{i}?a=1&b=2") for i in range(1500)] + [(2000 + i, f"https://big.example/{i}") for i in range(600)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["sitemap_scan"](spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.origin, []).append((r.pos, r.url))
    assert len(got) == 2000 and len(by) == 8 and len(by["https://big.example"]) == 500
    small = {u for o, x in by.items() if "big" not in o for _, u in x}
    assert small == {u for i, u in pages if i < 1500}
    assert all(sorted(p for p, _ in x) == list(range(len(x))) for x in by.values())
