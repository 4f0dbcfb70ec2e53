"""What Python holds of a batch at once; items that repeat."""

import pyarrow as pa
from pyspark.sql import functions as F

from webgauge.functions import text as tx
from webgauge.operators import extract, keywords


def test_models_and_issues_leave_python_in_pieces():
    html = pa.array([f"<title>t{i}</title>" for i in range(300)] + ["<p>" + "long " * 300_000, None])
    found = list(extract.models(iter([(html, pa.array([None] * 302, pa.string()))])))
    assert max(map(len, found)) == extract.PIECE_PAGES and [d["title"] for piece in found for d in piece.to_pylist()] == [f"t{i}" for i in range(300)] + ["", ""]
    assert [len(piece) for piece in found][-2:] == [300 % extract.PIECE_PAGES + 1, 1]  # a long page ends a piece
    issues = list(extract.issue_lists(iter([pa.array([f"word word {i}" for i in range(100)])])))
    assert [len(piece) for piece in issues] == [64, 36] and all(len(x) == 1 for piece in issues for x in piece.to_pylist())


def test_keywords_leave_python_in_pieces():
    n = 150
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "tokens": [["alpha", "beta"] * 3] * n, "title": ["alpha"] * n, "description": [""] * n, "headings": [[""]] * n, "url": [""] * n})
    found = list(keywords.pieces(iter([batch]), None))
    assert len(found) == 3 and [x for piece in found for x in dict.fromkeys(piece.column(0).to_pylist())] == list(range(n))


def test_repeated_items(spark):
    items = spark.createDataFrame([(["b", "a", "c", "a", "b", "b"],), ([],), (["a"],), (["", ""],)], "v array<string>")
    assert [r[0] for r in items.select(tx.repeated(F.col("v"))).collect()] == [["b", "a"], [], [], [""]]


def test_ranges_next_to_each_other_share_a_task_and_what_it_read(tmp_path, monkeypatch):
    from webgauge.sources import messages as m

    data = b"".join(m.format_record(f"https://a.example/{i}", None, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 200) for i in range(400))
    (tmp_path / "a.warc").write_bytes(data)
    reader = m.MessageReader.__new__(m.MessageReader)
    reader.folder, reader.split_bytes = str(tmp_path), 1 << 12
    bounds = [x for part in reader.partitions() for x in part.bounds]
    assert [lo for lo, _ in bounds] == list(range(0, len(data), 1 << 12)) and bounds[-1][1] == len(data)
    assert len(reader.partitions()) < len(bounds)
    heads = []
    monkeypatch.setattr(m.Records, "head", lambda self, at, head=m.Records.head: heads.append(at) or head(self, at))
    with open(tmp_path / "a.warc", "rb") as file:
        records = m.Records(file, len(data))
        found = [fields["warc-target-uri"] for lo, hi in bounds for fields, _ in records.in_range(lo, hi)]
    assert found == [f"https://a.example/{i}" for i in range(400)]
    assert len(heads) <= 2 * 400  # one for its place, one for what it holds


def test_an_issue_is_excused_and_told_once_for_its_surroundings(monkeypatch):
    told = []
    monkeypatch.setattr(extract, "_told", lambda made, match, told_before=extract._told: told.append(made) or told_before(made, match))
    found = extract.text_issues(["alpha " * 1000])
    assert len(found) == len({x["excerpt"] for x in found}) and len(told) <= 2 * len(found) < 50


def test_what_is_looked_for_first_leaves_no_issue_out():
    texts = ["the The cat", "İstanbul istanbul", "straße STRASSE", "foo\x85foo", "word.Next one", "é.Éabc abc.Déf", "a ,b", "a ; ", "so,, well", "what???", "x" * 31, "{{name}}", "%NAME%", "${a}", "überüber ber"]
    for text in texts:
        for issue, shows, _ in extract._issues:
            assert issue.likely(text) or not shows.search(text), (issue.kind, text)


def test_findings_are_compiled_and_worked_out_once(spark):
    from webgauge.plans import report

    pages = spark.createDataFrame([(1, "https://a.example/", "<p>a")], "page_id long, url string, html string")
    plan = report.findings(report.audited(pages), "geo")._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(struct(" not in plan and plan.count("Opening answer") == 4  # once for each of its findings


def test_heavy_rows_are_dealt_to_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    from webgauge.queries import registry

    spark.range(500).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(registry, "DEALT_ROWS", 10)
    dealt = registry.dealt(registry.table(spark, str(tmp_path), "t"))
    assert dealt.rdd.getNumPartitions() == 50 and dealt.count() == 500


def test_findings_written_with_their_pages_are_those_of_the_rules(spark):
    from webgauge.plans import report

    pages = report.audited(spark.createDataFrame([(k, "https://a.example/", f"<title>t</title><h1>x{k}</h1><p>a b c") for k in range(3)], "page_id long, url string, html string"))
    written = report.with_findings(pages, "seo")
    plan = report.findings(written.select("page_id", "findings").localCheckpoint(), "seo")
    assert sorted(plan.collect()) == sorted(report.findings(pages, "seo").collect())
    assert "Two profiles" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_captured_answers_are_dealt_to_tasks(spark, tmp_path):
    from webgauge.queries.net import url_guard

    spark.sql("SELECT id AS event_id, id % 7 AS user_id FROM range(20)").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = url_guard(spark, str(tmp_path))
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 20
