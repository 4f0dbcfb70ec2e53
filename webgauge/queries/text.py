"""Text analytics over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.constants import ARIAL_WIDTHS, FALLBACK_WIDTH, LANGUAGE_MARKERS, NOISE_WORDS, STOP_WORDS
from webgauge.functions import numbers
from webgauge.functions import text as tx
from webgauge.operators.extract import text_issue_column
from webgauge.operators.keywords import keyword_candidates, keywords
from webgauge.plans import views
from webgauge.queries.registry import dealt, long, query, six, sql_list, sql_six, sql_tokens, sql_values, table

STOPS = sql_list(STOP_WORDS)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS word_count, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_words, array_to_string(t[1:5], ' ') AS first_words FROM (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS t FROM documents)")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(_text()).alias("t"))
    return t.select("doc_id", long(F.size("t")).alias("word_count"), long(F.size(F.array_distinct("t"))).alias("distinct_words"), F.array_join(F.slice("t", 1, 5), " ").alias("first_words"))


@query(
    f"""SELECT doc_id, {sql_six(f"CASE WHEN len(t) = 0 THEN 0 ELSE CAST(len(list_filter(t, lambda w: w IN {STOPS})) AS DOUBLE) / len(t) * CAST(100 AS DOUBLE) END")} AS stop_percent
    FROM (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS t FROM documents)"""
)
def text_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", six(tx.stop_word_percent(tx.tokens(_text()))).alias("stop_percent"))


SPLIT = r"regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?…]) ([^a-z])', '\1' || chr(1) || '\2', 'g'), '([.!?…]) ([^a-z])', '\1' || chr(1) || '\2', 'g')"


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(max_len AS BIGINT) AS longest FROM (SELECT doc_id, s, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS max_len FROM (SELECT doc_id, list_filter(string_split({SPLIT}, chr(1)), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS s FROM documents))")
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(_text()).alias("s"))
    return s.select("doc_id", long(F.size("s")).alias("sentences"), long(F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0))).alias("longest"))


@query(
    f"""WITH t AS (SELECT doc_id, list_slice({sql_tokens("coalesce(text, '')")}, 1, 4000) AS t FROM documents),
    m AS (SELECT * FROM {sql_values([(i, c, w) for i, (c, ws) in enumerate(LANGUAGE_MARKERS.items()) for w in ws])} AS m(place, code, word)),
    s AS (SELECT doc_id, place, code, CAST(len(list_filter(t, lambda x: list_contains(words, x))) AS DOUBLE) / len(t) AS score FROM t, (SELECT place, code, list(word) AS words FROM m GROUP BY place, code) WHERE len(t) >= 20),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS n, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS second FROM s)
    SELECT documents.doc_id, CASE WHEN r.score > 0 THEN r.code END AS code, {sql_six("CASE WHEN r.score > 0 THEN least(CAST(1 AS DOUBLE), (r.score - r.second) * CAST(25 AS DOUBLE) + r.score * CAST(5 AS DOUBLE)) ELSE 0 END")} AS confidence
    FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id AND r.n = 1"""
)
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.language(_text()).alias("l"))
    return found.select("doc_id", F.col("l.code").alias("code"), six(F.col("l.confidence")).alias("confidence"))


WIDTHS = sql_values(list(ARIAL_WIDTHS.items()))


@query(
    f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''),
    w AS (SELECT * FROM {WIDTHS} AS w(ch, units)),
    s AS (SELECT doc_id, sum(coalesce(units, {FALLBACK_WIDTH})) AS units FROM c LEFT JOIN w USING (ch) GROUP BY doc_id)
    SELECT doc_id, CAST(floor(coalesce(units, 0) / CAST(1000 AS DOUBLE) * 20 + 0.5) AS BIGINT) AS title_px, CAST(floor(coalesce(units, 0) / CAST(1000 AS DOUBLE) * 14 + 0.5) AS BIGINT) AS description_px FROM documents LEFT JOIN s USING (doc_id)"""
)
def text_pixel_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", long(tx.pixel_width(_text(), 20)).alias("title_px"), long(tx.pixel_width(_text(), 14)).alias("description_px"))


KEYS = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: regexp_replace(lower(p), '[^\p{L}\p{N} ]', '', 'g')), lambda k: k <> '')"


@query(f"SELECT doc_id, CAST((SELECT count(*) FROM (SELECT k FROM (SELECT unnest(keys) AS k) GROUP BY k HAVING count(*) > 1)) AS BIGINT) AS duplicate_paragraphs FROM (SELECT doc_id, {KEYS} AS keys FROM documents)")
def text_duplicate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.filter(F.transform(F.split(_text(), "\n"), tx.paragraph_key), lambda k: k != "")
    exploded = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(keys).alias("k"))
    counted = exploded.groupBy("doc_id", "k").agg(F.count("k").alias("n"))
    return counted.groupBy("doc_id").agg(long(F.count_if(F.col("n") > 1)).alias("duplicate_paragraphs"))


@query(
    f"""SELECT doc_id, CASE WHEN n >= 50 THEN left(sha1(n || '|' || left(regexp_replace(lower(array_to_string(string_split(coalesce(text, ''), chr(10)), ' ')), '\\s+', ' ', 'g'), 4000)), 16) END AS content_hash
    FROM (SELECT doc_id, text, len({sql_tokens("coalesce(text, '')")}) AS n FROM documents)"""
)
def text_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(tx.word_count(_text()), F.split(_text(), "\n")).alias("content_hash"))


@query()
def text_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs match positions and back references, which neither engine's SQL has; tests hold it against cases."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(text_issue_column(_text())).alias("i"))
    return rows.select("doc_id", "i.*")


def _keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    line = F.split_part(_text(), F.lit("\n"), F.lit(1))
    return d.select(F.col("doc_id").alias("id"), _text().alias("text"), line.alias("title"), F.col("lang").alias("description"), F.array(line, F.col("source")).alias("headings"), F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/the-page")).alias("url"))


GRAMS = f"""t AS (SELECT doc_id AS id, coalesce(text, '') AS text, lower(split_part(coalesce(text, ''), chr(10), 1)) AS title, lower(lang) AS description, lower(source) AS source,
        regexp_replace('https://example.org/' || lower(source) || '/the-page', '[-_/]+', ' ', 'g') AS url, {sql_tokens("coalesce(text, '')")} AS t FROM documents),
    g AS (SELECT id, n AS words, i AS pos, t[i : i + n - 1] AS gram FROM (SELECT id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, (VALUES (1), (2), (3)) AS k(n) WHERE len(t) >= n)),
    ok AS (SELECT id, words, pos, array_to_string(gram, ' ') AS keyword FROM g WHERE gram[1] NOT IN {STOPS} AND gram[-1] NOT IN {STOPS} AND len(list_filter(gram, lambda w: w NOT IN {sql_list(NOISE_WORDS)})) > 0
        AND len(list_filter(gram, lambda w: length(w) < 2)) = 0 AND len(list_filter(gram, lambda w: NOT regexp_full_match(w, '[0-9]+'))) > 0 AND (words = 1 OR len(list_filter(gram, lambda w: w IN {STOPS})) <= words - 2)),
    c AS (SELECT id, words, keyword, count(*) AS count, min(pos) AS first FROM ok GROUP BY id, words, keyword HAVING count(*) >= 2),
    f AS (SELECT c.*, len(t.t) AS total, contains(title, keyword) AS in_title, contains(description, keyword) AS in_description, CAST(contains(title, keyword) AS INT) + CAST(contains(source, keyword) AS INT) AS in_headings, contains(url, keyword) AS in_url FROM c JOIN t USING (id)),
    s AS (SELECT *, count * CAST(CASE words WHEN 1 THEN 1.0 WHEN 2 THEN 1.7 ELSE 2.1 END AS DOUBLE) + (CAST(in_title AS INT) * CAST(3 AS DOUBLE) + CAST(in_description AS INT) * CAST(1.5 AS DOUBLE) + least(in_headings, 4) * CAST(1.2 AS DOUBLE) + CAST(in_url AS INT) * CAST(1 AS DOUBLE)) * CAST(2 AS DOUBLE) AS score,
        CAST(count * words AS DOUBLE) / greatest(total, 1) * CAST(100 AS DOUBLE) AS density FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, count DESC, words, first) AS place FROM s)"""


@query(f"WITH {GRAMS} SELECT id, keyword, CAST(words AS BIGINT) AS words, count, in_title, in_description, CAST(in_headings AS BIGINT) AS in_headings, in_url, {sql_six('score')} AS score, {sql_six('density')} AS density, place FROM r")
def keyword_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = keyword_candidates(_keyword_rows(spark, sf_dir))
    return c.select("id", "keyword", long("words").alias("words"), "count", "in_title", "in_description", long("in_headings").alias("in_headings"), "in_url", six(F.col("score")).alias("score"), six(F.col("density")).alias("density"), long("place").alias("place"))


@query(
    f"""WITH RECURSIVE {GRAMS},
    k(id, place, kept) AS (
        SELECT id, CAST(0 AS BIGINT), CAST([] AS STRUCT(keyword VARCHAR, words INT, count BIGINT, place BIGINT)[]) FROM (SELECT DISTINCT id FROM r)
        UNION ALL
        SELECT k.id, r.place, CASE WHEN len(kept) >= 25 OR len(list_filter(kept, lambda x: x.words > r.words AND contains(x.keyword, r.keyword) AND r.count <= x.count * CAST(1.3 AS DOUBLE))) > 0 THEN kept
            ELSE list_append(kept, {{'keyword': r.keyword, 'words': r.words, 'count': r.count, 'place': r.place}}) END
        FROM k JOIN r ON r.id = k.id AND r.place = k.place + 1
    ),
    last AS (SELECT id, arg_max(kept, place) AS kept FROM k GROUP BY id),
    u AS (SELECT id, unnest(kept) AS x FROM last),
    n AS (SELECT id, x.place AS place, row_number() OVER (PARTITION BY id ORDER BY x.place) AS rank FROM u)
    SELECT n.id, n.rank, r.keyword, CAST(r.words AS BIGINT) AS words, r.count, floor(r.density * 100 + 0.5) / CAST(100 AS DOUBLE) AS density, floor(r.score * 10 + 0.5) / CAST(10 AS DOUBLE) AS score FROM n JOIN r ON r.id = n.id AND r.place = n.place"""
)
def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keywords(_keyword_rows(spark, sf_dir))
    return k.select("id", long("rank").alias("rank"), "keyword", long("words").alias("words"), "count", "density", "score")


@query(
    f"WITH {GRAMS} SELECT id, keyword, NOT (in_title OR in_description OR in_headings > 0 OR in_url) AS body_only, {sql_six('CAST(count AS DOUBLE) / max(count) OVER (PARTITION BY id)')} AS bar FROM r"
)
def keyword_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.keyword_bars(keyword_candidates(_keyword_rows(spark, sf_dir)))
    return bars.select("id", "keyword", "body_only", six(F.col("bar")).alias("bar"))


def _steps(e: str, steps, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {e} >= {least} THEN '{name}'" for least, name in steps) + f" ELSE '{last}' END"


SCORE = "l_quantity * 2"


@query(
    f"""SELECT l_orderkey, l_linenumber, {_steps(SCORE, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")} AS grade, {_steps(SCORE, [(90, "Very good"), (80, "Good"), (60, "Warning"), (40, "Poor")], "Critical")} AS verdict,
    {_steps(SCORE, [(80, "good"), (60, "fair")], "poor")} AS band, floor(CAST(l_discount AS DOUBLE) * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS percent,
    floor(CAST(l_extendedprice AS DOUBLE) / CAST(1024 AS DOUBLE) * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS kb FROM lineitem"""
)
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_quantity") * 2
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.grade(score).alias("grade"), numbers.verdict(score).alias("verdict"), numbers.score_band(score).alias("band"), numbers.percent(F.col("l_discount").cast("double")).alias("percent"),
        numbers.round_half_up(numbers.kilobytes(F.col("l_extendedprice").cast("double")), 1).alias("kb"),
    )
