"""License scans against a plain search, and spans of changed notices."""

import re

import pytest

from webgauge.llm.license_scan import TEMPLATES, Template, scan_licenses, template_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_are_those_of_a_plain_search(spark, make_docs, odd_rows):
    hot = "Under the MIT License; cc by nc, "
    rows = odd_rows + [
        (50, hot), (51, "under the the mit license"), (52, "UNDER\x00THE\x7fMIT—LICENSE"), (53, "under the mit license cc by nc cc by nc cc by nc"), (54, hot * 5000), (55, "cc by ncÉ"),
        (56, "Cc-By_Nc"), (57, "apache license version 2apache license version 2"), (58, "İcc by nc ſ K"), (59, " \tcc by nc"), (60, "cc by"), (60, hot), (60, hot),
    ]
    got = scan_licenses(make_docs(rows)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, r.base_labels) for r in got) == sorted(
        (i or -1, n, b, first or -1, last or -1, labels) for i, t in rows for n, b, first, last, labels in [plain(t)]
    )
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.n_base == 0 or r.score == 1.0


def test_changed_notices_are_found_and_others_are_not(spark, make_docs):
    notice = template_words(next(t.text for t in TEMPLATES if t.label == "bsd"))
    put_in = notice[:9] + ["any"] + notice[9:]
    changed = [("never" if i in (7, 14) else w) for i, w in enumerate(notice)]
    apart = [w for x in notice for w in (x, "x")]
    texts = [" ".join(["lead"] * 40 + part + ["rest"] * 9) for part in (notice, put_in, changed, apart, notice[::-1], notice[:8], notice[4:] + notice[:4])]
    got = {r.doc_id: r for r in scan_licenses(make_docs(list(enumerate(texts)))).collect()}
    assert [got[i].labels for i in range(7)] == ["bsd", "bsd", "bsd", "", "", "", "bsd"]
    assert [tuple(s) for s in got[0].spans] == [("bsd", 40, len(notice), 1.0)] and got[1].spans[0].length == len(notice) + 1 and got[2].score < 1
    assert got[0].n_base == 0 and got[0].first_word is None and got[3].score == 0


def test_own_templates_and_grams(spark, make_docs):
    own = [Template("a", "one two", True), Template("b", "three four five six")]
    got = {r.doc_id: (r.n_base, r.labels) for r in scan_licenses(make_docs([(1, "one two one two"), (2, "three four five six")]), own, k=2).collect()}
    assert got == {1: (2, "a"), 2: (0, "b")}
    with pytest.raises(ValueError, match="3 words"):
        scan_licenses(make_docs([]), own)


def test_nothing_to_scan(spark, make_docs):
    assert scan_licenses(make_docs([])).count() == 0
    got = scan_licenses(make_docs([(None, None)])).collect()[0]
    assert (got.doc_id, got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels, got.labels, got.score, got.spans) == (None, 0, 0, None, None, "", "", 0.0, [])


def test_no_python_in_the_main_path(spark, make_docs):
    plan = scan_licenses(make_docs([(1, "cc by nc")]).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
