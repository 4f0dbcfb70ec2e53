"""Ranked 1 to 3 word keywords of each row: one pass over its tokens, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.constants import NOISE_WORDS, STOP_WORDS
from webgauge.functions import text as tx

LIMIT, SUBSUMED_RATIO = 25, 1.3
#: Rows whose words and keywords Python holds at once.
PIECE_ROWS = 64
BONUS = {1: 1.0, 2: 1.7, 3: 2.1}
STOP, SHORT, NOISE, NUMBER = 1, 2, 4, 8
FIELDS = [("keyword", pa.string()), ("words", pa.int32()), ("count", pa.int64()), ("density", pa.float64()), ("in_title", pa.bool_()), ("in_description", pa.bool_()), ("in_headings", pa.int32()), ("in_url", pa.bool_()), ("score", pa.float64()), ("place", pa.int32())]
SCHEMA = "keyword string, words int, count long, density double, in_title boolean, in_description boolean, in_headings int, in_url boolean, score double, place int"
_stop, _noise = frozenset(STOP_WORDS), frozenset(NOISE_WORDS)


def _flags(word: str) -> int:
    one = len(word) == 1 and word < "\U00010000"  # letters beyond the basic plane count as two
    return STOP * (word in _stop) | SHORT * (one or not word) | NOISE * (word in _noise) | NUMBER * (word.isascii() and word.isdigit())


def phrases(tokens: list[str]) -> dict[str, list[int]]:
    """(words, count, first place) of each phrase that can be a keyword and occurs at least twice.

    It neither begins nor ends with a stop word, has no word of one letter, and isn't of noise words or numbers only.
    """
    known: dict[str, int] = {}
    flags = []
    for t in tokens:
        if t not in known:
            known[t] = _flags(t)
        flags.append(known[t])
    found: dict[str, list[int]] = {}
    n = len(tokens)
    for i, f in enumerate(flags):
        if f & (STOP | SHORT):
            continue
        phrase, only = tokens[i], f
        for words in (1, 2, 3):
            if words > 1:
                j = i + words - 1
                if j >= n or flags[j] & SHORT:
                    break
                phrase = f"{phrase} {tokens[j]}"
                only &= flags[j]
                if flags[j] & STOP:
                    continue
            if not only & (NOISE | NUMBER):
                old = found.get(phrase)
                if old is None:
                    found[phrase] = [words, 1, i]
                else:
                    old[1] += 1
    return {k: v for k, v in found.items() if v[1] > 1}


def ranked(tokens: list[str], title: str, description: str, headings: list[str], url: str) -> list[tuple]:
    """The fields of each keyword candidate of one row, best first."""
    out = []
    total = max(len(tokens), 1)
    for k, (words, count, first) in phrases(tokens).items():
        a, b, c, d = k in title, k in description, sum(k in h for h in headings), k in url
        score = count * BONUS[words] + (a * 3.0 + b * 1.5 + min(c, 4) * 1.2 + d * 1.0) * 2.0
        out.append((-score, -count, words, first, k, a, b, c, d))
    out.sort()
    return [(k, words, -count, -count * words / total * 100.0, a, b, c, d, -score, place + 1) for place, (score, count, words, _, k, a, b, c, d) in enumerate(out)]


def kept(candidates: list[tuple], limit: int) -> list[tuple]:
    """Those not inside a kept longer phrase of similar count, ``limit`` at most; place counts anew, numbers are rounded."""
    out: list[tuple] = []
    for c in candidates:
        if len(out) >= limit:
            break
        if not any(k[1] > c[1] and c[0] in k[0] and c[2] <= k[2] * SUBSUMED_RATIO for k in out):
            out.append(c)
    return [(*c[:9], n + 1) for n, c in enumerate(out)]


def pieces(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """The keywords of batches of (id, tokens, title, description, headings, url), some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            b = batch.slice(at, PIECE_ROWS)
            owner, out = [], []
            for i, fields in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 6)))):
                found = ranked(*fields) if limit is None else kept(ranked(*fields), limit)
                owner += [i] * len(found)
                out += found
            columns = list(zip(*out)) or [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS))], names=["id", *(n for n, _ in FIELDS)])


def _pass(rows: DataFrame, id_column: str, limit: int | None) -> DataFrame:
    url = F.regexp_replace(F.lower(F.try_url_decode(F.replace(F.col("url"), F.lit("+"), F.lit("%2B")))), "[-_/]+", " ")
    empty = F.lit("")
    source = rows.select(
        F.col(id_column).alias("id"), F.coalesce(tx.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"), F.lower(F.coalesce("title", empty)).alias("title"), F.lower(F.coalesce("description", empty)).alias("description"),
        F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.lower(F.coalesce(h, empty))).alias("headings"), F.coalesce(url, empty).alias("url"),
    )

    return source.mapInArrow(lambda batches: pieces(batches, limit), f"id {source.schema['id'].dataType.simpleString()}, {SCHEMA}")


def keyword_candidates(rows: DataFrame, id_column: str = "id") -> DataFrame:
    """Phrases that occur at least twice in rows (id, text, title, description, headings, url), scored and ranked.

    (id, keyword, words, count, density, in_title, in_description, in_headings, in_url, score, place), place from 1.
    Every row is taken by itself; nulls count as empty; a url that isn't valid percent-encoding matches nothing.
    """
    return _pass(rows, id_column, None)


def keywords(rows: DataFrame, id_column: str = "id", limit: int = LIMIT) -> DataFrame:
    """The candidates of each row in rank order, without those inside a kept longer phrase of similar count."""
    out = _pass(rows, id_column, limit).withColumnRenamed("place", "rank")
    rounded: dict[str, Column] = {"density": F.floor(F.col("density") * 100 + 0.5) / 100.0, "score": F.floor(F.col("score") * 10 + 0.5) / 10.0}
    return out.withColumns(rounded).select("id", "rank", *[n for n, _ in FIELDS[:-1]])
