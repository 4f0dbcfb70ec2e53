"""The registered queries of the training-data operators, thin over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroid_clustering import CLUSTERS, DIMS, ROUNDS, SCALE, cluster_vectors
from .common import read_table
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_text import extract_text
from .jaccard_join import jaccard_join
from .license_scan import GRAM_WORDS, LEAST_SHARE, LEAST_VOTES, LOWER, NO_WORD, TEMPLATES, UPPER, WORDS_A_SLIP, scan_licenses, template_words
from .line_dedup import dedup_lines
from .packing import pack_documents
from .quality import rank_quality
from .sentencepiece_sampling import segmentation_digests
from .token_counts import count_tokens
from .token_files import tokens_through_files


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_digests(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_through_files(read_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    restated = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), label=restated)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_html_extraction, op3_sentencepiece_sampling, op4_best_fit_packing, op5_line_dedup,
        op6_token_files, op7_embedding_dedup, op8_exact_dedup, op9_quality_ranking, op10_ngram_jaccard,
        op11_centroid_clustering, op12_hard_negatives, op13_license_scan,
    )
}

def _clustering_sql() -> str:
    """The rounds one after the other; a centroid is a list of integers."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def nearest(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
            SELECT v.row, v.vec_id, v.x, c.cluster, {distance} AS distance FROM v, c{n} c
            QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.cluster) = 1
        )"""

    def moved(n: int) -> str:
        return f"""c{n + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
                SELECT cluster, list(mean ORDER BY i) AS x FROM (
                    SELECT cluster, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS mean FROM a{n}, range(1, {DIMS + 1}) r(i) GROUP BY cluster, i
                ) GROUP BY cluster
            ) m USING (cluster)
        )"""

    rounds = ", ".join(f"{nearest(n)}, {moved(n)}" for n in range(ROUNDS))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS x
            FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
            WHERE len(e) = {DIMS} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS cluster, x FROM v QUALIFY cluster < {CLUSTERS}
        ), {rounds}, {nearest(ROUNDS)}
        SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)
    """


def _license_sql() -> str:
    """The same votes with the grams themselves in place of their hashes."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"({n}, '{t.label}', {quoted(template_words(t.text))}, {t.phrase})" for n, t in enumerate(TEMPLATES))
    gram = " || ' ' || ".join(f"words[i + {j}]" for j in range(GRAM_WORDS))
    return f"""
        WITH t(template, label, words, phrase) AS (VALUES {templates}),
        d AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id,
                   list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NO_WORD}'), lambda x: x <> '') AS words
            FROM documents
        ), tg AS (
            SELECT template, i - 1 AS place, {gram} AS gram FROM (SELECT template, words, unnest(range(1, len(words) - {GRAM_WORDS - 2})) AS i FROM t)
        ), dg AS (
            SELECT row, i - 1 AS pos, {gram} AS gram FROM (SELECT row, words, unnest(range(1, len(words) - {GRAM_WORDS - 2})) AS i FROM d)
        ), lines AS (
            SELECT row, template, pos - place AS diagonal, count(*) AS votes, min(pos) AS first, max(pos) AS last FROM dg JOIN tg USING (gram) GROUP BY ALL
        ), sized AS (
            SELECT l.*, label, phrase, t.words AS tw, len(t.words) - {GRAM_WORDS - 1} AS grams, len(t.words) // {WORDS_A_SLIP} AS slip FROM lines l JOIN t USING (template)
        ), steps AS (
            SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= slip THEN 0 ELSE 1 END AS fresh FROM sized WINDOW w AS (PARTITION BY row, template ORDER BY diagonal)
        ), merged AS (
            SELECT *, sum(fresh) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM steps
        ), spans AS (
            SELECT row, label, any_value(tw) AS tw, min(first) AS start, max(last) AS last, sum(votes) AS votes, any_value(grams) AS grams FROM merged GROUP BY row, template, span, label
        ), verified AS (
            SELECT row, label, len(list_intersect(words[start + 1 : last + {GRAM_WORDS}], tw)) / len(list_distinct(tw)) AS share
            FROM spans JOIN d USING (row) WHERE votes >= grams * {LEAST_VOTES} AND share >= {LEAST_SHARE}
        ), places AS (
            SELECT row, diagonal AS start, label FROM sized WHERE phrase AND votes = grams
        ), base AS (
            SELECT row, count(*) AS n, min(start) AS first, max(start) AS last, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY row
        ), every AS (
            SELECT row, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT row, label FROM places UNION ALL SELECT row, label FROM verified) GROUP BY row
        ), best AS (
            SELECT row, max(share) AS share FROM verified GROUP BY row
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.first AS first_word, base.last AS last_word, coalesce(base.labels, '') AS base_labels,
               coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0) END AS score
        FROM d LEFT JOIN base USING (row) LEFT JOIN every USING (row) LEFT JOIN best USING (row)
    """


ORACLE = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_hard_negatives": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS x
            FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
            SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.x) = len(b.x)
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5
    """,
    "op13_license_scan": _license_sql(),
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
    """,
    # pairs of one label only; a link is cosine >= 0.98 in doubles; components by repeated least neighbour
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), ok AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT a AS vec_id, b AS other FROM links
            UNION
            SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
        ), least AS (
            SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id
        ), degree AS (
            SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
        )
        SELECT v.vec_id, coalesce(degree.n, 0) AS n_links, least(v.vec_id, coalesce(least.m, v.vec_id)) AS component_id,
               v.vec_id = least(v.vec_id, coalesce(least.m, v.vec_id)) AS kept
        FROM v LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
    """,
}
