"""HTML extraction, quality ranking, the pipeline and the registered queries."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webgauge.llm.html_text import extract_text, main_text
from webgauge.llm.quality import Ranker, features, fit_pairs, held_out, keep_good, rank_quality


ARTICLE = "One &amp; two three four five six seven eight nine ten eleven twelve."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (f"<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{ARTICLE}<p>More <b>bold</b>\n text</article><footer>f</footer>", "Title\n\nOne & two three four five six seven eight nine ten eleven twelve.\n\nMore bold text"),
        (f"<div id=menu><a href=a>A</a><a href=b>B</a></div><div class=content><p>{ARTICLE}</p><p>{ARTICLE}</p><form>Sign up</form></div><div class='sidebar'>Side</div><section class=comments><p>nice post, really nice post</p></section>", "\n\n".join([ARTICLE.replace("&amp;", "&")] * 2)),
        (f"<main><p>{ARTICLE}<br>line</p><aside>x</aside><script>var a='<p>no</p>'</script><style>p{{}}</style><!-- c --></main>", ARTICLE.replace("&amp;", "&") + " line"),
        (f"<div id=page class='has-sidebar wrap'><div class=menu><article><p>{ARTICLE}</p></article></div><div class=comments><article class=comment><p>a reader's words</p></article></div></div>", ARTICLE.replace("&amp;", "&")),
        (f"<div class=cookie-notice>We use cookies</div><div class=text><p>{ARTICLE}</p><p>{ARTICLE}</p></div><article class='comment reply'><p>{ARTICLE}</p></article>", "\n\n".join([ARTICLE.replace("&amp;", "&")] * 2)),
        ("<p>a &lt; b &eacute; &#8364;", "a < b é €"),
        ("<table><tr><td>a<td>b</table>", "a\n\nb"),
        ("<div hidden>no</div><p>yes yes yes", "yes yes yes"),
        ("text <a href='unclosed", "text"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_extract_text_rows(spark):
    rows = [(1, "u", f"<article><p>{ARTICLE}</article>"), (2, None, None), (None, "v", "<p>é"), (1, "u", f"<article><p>{ARTICLE}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_text(pages).collect())
    t = ARTICLE.replace("&amp;", "&")
    assert got == sorted([(1, "u", t, len(t)), (2, "", "", 0), (0, "v", "é", 1), (1, "u", t, len(t))])
    assert extract_text(pages.limit(0)).count() == 0


def test_a_page_of_many_nested_elements():
    deep = "<div>" * 3000 + "deep text here" + "</div>" * 3000
    assert main_text(deep) == "deep text here"


def corpus(prose, n=240):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        t = prose(80 + i % 50, i)
        if not good:
            t = [t.upper().replace(" ", "!! "), " | ".join(t.split()), "spam " * 60, t.replace(" ", "$$$ ")][(i // 3) % 4]
        rows.append((i, t))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark, make_docs, prose):
    rows, labels = corpus(prose)
    docs = make_docs([*rows, (None, "no id here"), (900, None), (901, "")])
    frame = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = rank_quality(docs, frame).collect()
    assert len(got) == len(rows) + 3
    truth = {i: q for i, q, _ in labels}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    kept = keep_good(docs, frame)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_labels_of_held_out_rows_are_not_used(spark, make_docs, prose):
    rows, labels = corpus(prose, 90)
    docs = make_docs(rows)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = frame.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in rank_quality(docs, f).collect()} for f in (frame, turned))
    assert a == b


def test_quality_without_both_classes(spark, make_docs):
    docs = make_docs([(1, "x y"), (2, "z")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in rank_quality(docs, none).collect()} == {1.0}
    bad = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int")
    assert {r.score for r in rank_quality(make_docs([(i, "x") for i in range(20)]), bad).collect()} == {0.0}
    assert rank_quality(make_docs([]), none).count() == 0


def test_features_and_scores_agree():
    texts = ["", "one Two!", "ÉÉ é\nx", "a" * 50, "İstanbul x"]
    x = features(texts)
    rng = np.random.default_rng(0)
    r = Ranker(np.zeros(26), np.ones(26), rng.normal(size=26), rng.normal(size=2048), 0.0, 1.0)
    want = np.clip(x[:, :26], -6, 6) @ r.shape_weights + x[:, 26:] @ r.bucket_weights
    assert np.allclose(r.raw(texts), want, atol=1e-4)


def test_pairs_rank_what_is_preferred():
    rng = np.random.default_rng(3)
    x = np.zeros((400, 26 + 2048), np.float32)
    x[:, 3] = rng.normal(size=400)
    y = (x[:, 3] > 0).astype(float)
    m = fit_pairs(x, y)
    assert m.shape_weights[3] > 0 and abs(m.shape_weights[3]) > 5 * abs(np.delete(m.shape_weights, 3)).max()


def write_corpus(spark, make_docs, prose, path, extra=()):
    rows, labels = corpus(prose)
    passage = "\n".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(9))
    rows += [(300 + k, prose(100, 700 + k) + "\n" + passage) for k in range(3)] + [(310 + k, prose(150, 800)) for k in range(4)] + list(extra)
    make_docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return dict(rows)


def test_pipeline_stages(spark, make_docs, prose, tmp_path):
    import corpus_pipeline as p

    rows = write_corpus(spark, make_docs, prose, str(tmp_path), [(400, None), (401, "")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, inputs = [n for n, _ in p.STAGES], [docs]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    for n, f in p.STAGES:
        inputs.append(f(spark, inputs[-1], str(tmp_path)))
        if n != names[-1]:
            assert inputs[-1].columns == docs.columns
    good = {r.doc_id for r in inputs[1].collect()}
    assert {300, 301, 302, 310} <= good and len(good) < len(rows)
    lines = {r.doc_id: r for r in inputs[2].collect()}
    assert set(lines) == good and "w3x3" in lines[300].text and "w3x3" not in lines[301].text and lines[301].n_chars == len(lines[301].text)
    kept = {r.doc_id for r in inputs[3].collect()}
    assert 310 in kept and not {311, 312, 313} & kept or all(not lines[i].text for i in (311, 312, 313))
    packed = p.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id.dropna().astype(int)) == kept
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_pipeline_of_nothing(spark, make_docs, tmp_path):
    import corpus_pipeline as p

    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for n in names if n.startswith("op")] and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(e.oracle_sql()) <= set(names)
