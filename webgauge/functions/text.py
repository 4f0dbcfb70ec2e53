"""Text analytics as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.constants import (
    ARIAL_WIDTHS,
    FALLBACK_WIDTH,
    LANGUAGE_LEAST_TOKENS,
    LANGUAGE_MARKERS,
    LANGUAGE_TOKENS,
    STOP_WORDS,
)
from webgauge.functions.numbers import round_half_up

WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"
SPACES = r"(?U)[\s\x{FEFF}]+"
#: Word boundary between ASCII word characters, whatever Java takes \b for.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def clean(text: Column) -> Column:
    """Unicode white space made single spaces, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(text, SPACES, " "), "^ | $", "")


def tokens(text: Column) -> Column:
    """Lower-case words with inner apostrophes and hyphens."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.btrim(w, F.lit("-'’")))  # none is empty: each begins with a letter or digit


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def sentences(text: Column) -> Column:
    """Pieces between a sentence's end mark, white space and anything but a lower-case letter; with a word at least."""
    return sentences_of_clean(clean(text))


def sentences_of_clean(text: Column) -> Column:
    """``sentences`` of a text that is clean already."""
    parts = F.split(text, r"(?<=[.!?…])(?U:\s+)(?=[^a-z])")
    return F.filter(parts, lambda s: F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")))


def stop_word_percent(words: Column) -> Column:
    """Share of stop words among tokens, in percent; 0 without tokens."""
    hits = F.size(F.filter(words, lambda w: w.isin(STOP_WORDS)))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words) * 100.0)


def _once(value: Column, use) -> Column:
    """use(value), with ``value`` evaluated once however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _hits(words: Column, markers: list[str]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(markers)))


def language(text: Column) -> Column:
    """``language_of`` the tokens of a text."""
    return language_of(tokens(text))


def language_of(found: Column) -> Column:
    """struct(code, confidence) from marker words among the first tokens; code null under 20 tokens or without hits."""
    none = F.struct(F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("confidence"))

    every = sorted({x for m in LANGUAGE_MARKERS.values() for x in m})

    def pick(r: Column) -> Column:
        best, second = r[0]["score"], r[1]["score"]
        sure = F.least(F.lit(1.0), (best - second) * 25.0 + best * 5.0)
        return F.when(best > 0, F.struct(r[0]["code"].alias("code"), sure.alias("confidence"))).otherwise(none)

    def rank(words: Column) -> Column:
        def scored(marked: Column) -> Column:
            return F.array(*[F.struct((_hits(marked, m) / F.size(words)).alias("score"), F.lit(-i).alias("place"), F.lit(c).alias("code")) for i, (c, m) in enumerate(LANGUAGE_MARKERS.items())])

        marked = F.filter(words, lambda x: x.isin(every))
        return F.when(F.size(words) < LANGUAGE_LEAST_TOKENS, none).otherwise(_once(F.sort_array(_once(marked, scored), asc=False), pick))

    return _once(F.slice(found, 1, LANGUAGE_TOKENS), rank)


def pixel_width(text: Column, font_px: int) -> Column:
    """Width in Arial: a fallback for every character, corrected by counts of those with a width of their own."""
    units = F.char_length(text) * FALLBACK_WIDTH
    for width in sorted(set(ARIAL_WIDTHS.values()) - {FALLBACK_WIDTH}):
        chars = "".join(c for c, w in ARIAL_WIDTHS.items() if w == width)
        count = F.char_length(text) - F.char_length(F.translate(text, chars, ""))
        units = units + count * (width - FALLBACK_WIDTH)
    return round_half_up(units / F.lit(1000.0) * font_px).cast("int")


def paragraph_key(text: Column) -> Column:
    """What paragraphs are compared by: lower case letters, digits and spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", "")


def repeated(items: Column) -> Column:
    """Items that occur more than once, each once, by first occurrence."""
    again = lambda ordered: F.filter(ordered, lambda x, i: x == F.get(ordered, i - 1))
    return _once(items, lambda found: F.array_intersect(found, _once(F.array_sort(found), again)))


def content_hash(words: Column, paragraphs: Column, least_words: int = 50) -> Column:
    """16 hex digits of sha1 over the word count and the first 4000 characters of the paragraphs; null for short pages."""
    joined = F.regexp_replace(F.lower(F.concat_ws(" ", paragraphs)), SPACES, " ")
    value = F.substring(F.sha1(F.concat(words.cast("string"), F.lit("|"), F.substring(joined, 1, 4000))), 1, 16)
    return F.when(words >= least_words, value)


def plural(word: Column, n: Column) -> Column:
    many = F.when(F.regexp_like(word, F.lit("[^aeiou]y$")), F.regexp_replace(word, "y$", "ies")).when(F.regexp_like(word, F.lit("(s|sh|ch|x)$")), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    return F.when(n == 1, word).otherwise(many)


def truncated(text: Column, limit: int) -> Column:
    """Text of ``limit`` characters at most, the last of a longer one an ellipsis; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)
