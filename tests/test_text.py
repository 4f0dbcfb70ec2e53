"""Text and number functions: what naive expressions get wrong."""

from pyspark.sql import functions as F

from webgauge.functions import numbers
from webgauge.functions import text as tx
from webgauge.operators.extract import text_issues
from webgauge.operators.keywords import keyword_candidates, keywords


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def test_tokens_keep_inner_apostrophes_and_hyphens(spark):
    assert one(spark, tx.tokens(F.col("t")), "Don't re-use 'quoted' words’ -- x1 É!") == ["don't", "re-use", "quoted", "words", "x1", "é"]
    assert one(spark, tx.tokens(F.col("t")), "") == []


def test_clean_takes_unicode_white_space(spark):
    assert one(spark, tx.clean(F.col("t")), " a ﻿\n b ") == "a b"


def test_sentences_split_before_anything_but_lower_case(spark):
    assert one(spark, tx.sentences(F.col("t")), "One. Two! three? 4 is. … -- Ünd so… Ja.") == ["One.", "Two! three?", "4 is.", "-- Ünd so…", "Ja."]


def test_stop_words_need_straight_apostrophes(spark):
    assert one(spark, tx.stop_word_percent(tx.tokens(F.col("t"))), "don't don’t cat the") == 50.0


def test_language_needs_twenty_tokens(spark):
    assert one(spark, tx.language(F.col("t")), "the cat and the dog")["code"] is None
    english = one(spark, tx.language(F.col("t")), "the cat and the dog is in the house of a friend that you are to see for this one")
    assert english["code"] == "en" and 0 < english["confidence"] <= 1
    assert one(spark, tx.language(F.col("t")), "xx " * 30)["code"] is None


def test_pixel_widths(spark):
    assert one(spark, tx.pixel_width(F.col("t"), 20), "Wi…é🙂") == int((944 + 222 + 1000 + 556 + 556) / 1000 * 20 + 0.5)


def test_content_hash_needs_fifty_words(spark):
    assert one(spark, tx.content_hash(F.lit(49), F.array("t")), "x") is None
    assert one(spark, tx.content_hash(F.lit(50), F.array("t")), "A  b") == one(spark, tx.content_hash(F.lit(50), F.array("t")), "a b")


def test_plurals(spark):
    assert [one(spark, tx.plural(F.col("t"), F.lit(2)), w) for w in ("page", "query", "day", "match", "box")] == ["pages", "queries", "days", "matches", "boxes"]


def test_rounding_half_up_on_doubles(spark):
    r = lambda x, d: spark.range(1).select(numbers.round_half_up(F.lit(x), d).alias("v")).first()["v"]
    assert (r(2.5, 0), r(-2.5, 0), r(1.005, 2), r(0.25, 1)) == (3, -2, 1.0, 0.3)


def test_clock_drift(spark):
    row = spark.range(1).select(*[numbers.clock_drift_ok(F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit(h)).alias(str(i)) for i, h in enumerate(["Tue, 02 Jan 2024 03:05:00 GMT", "Tue, 02 Jan 2024 03:07:00 GMT", "soon"])]).first()
    assert list(row) == [True, False, None]


def test_text_issues():
    kinds = lambda t: [i["type"] for i in text_issues([t])]
    assert kinds("it is is so. That had had been.") == ["Repeated word"]
    assert kinds("It ended.Then it began; see Inc.Then") == ["Missing space"]
    assert kinds("odd , comma") == ["Spacing before punctuation"]
    assert kinds("what???? no,, yes") == ["Duplicate punctuation"]  # one excerpt
    assert kinds("a" * 31) == ["Suspiciously long word"]
    assert kinds("Hi {{name}} %USER% ${x}") == ["Unrendered placeholder"]
    assert kinds("cóla la casa") == ["Repeated word"]  # word boundaries are those of ASCII letters
    assert text_issues(["x" * 50 + " the the " + "y" * 50])[0]["excerpt"].startswith("…")


CASE = "id long, text string, title string, description string, headings array<string>, url string"


def test_keywords_drop_what_a_longer_one_covers(spark):
    text = "solar panel cost " * 4 + "solar roof " * 1 + "wind wind "
    rows = spark.createDataFrame([(1, text, "Solar panel cost", "", ["Solar panel cost"], "https://x.org/solar-panel%20cost")], CASE)
    got = [r.keyword for r in keywords(rows).orderBy("rank").collect()]
    assert got[0] == "solar panel cost" and "panel" not in got and "wind" in got
    c = {r.keyword: r for r in keyword_candidates(rows).collect()}
    assert c["solar panel cost"].in_title and c["solar panel cost"].in_url and c["solar panel cost"].in_headings == 1
    assert "solar roof" not in c


def test_keywords_stop_at_the_limit_and_survive_bad_urls(spark):
    text = " ".join(f"{a}word{a}" for a in "abcdefghijklmnopqrstuvwxyzABCDEFGH" for _ in range(2))
    rows = spark.createDataFrame([(1, text, None, None, None, "https://x.org/%zz"), (2, "", "", "", [], "")], CASE)
    got = keywords(rows).collect()
    assert len(got) == 25 and {r.id for r in got} == {1} and not any(r.in_url for r in got)


def test_letters_beyond_the_basic_plane_are_words():
    from webgauge.operators.keywords import phrases

    assert set(phrases(["𝒳", "x", "𝒳", "x", "tea", "tea"])) == {"𝒳", "tea"}
