r"""License scans by diagonal voting, in DataFrame functions alone.

The word k-grams of every text and of the templates are hashed.  A join finds each place where a gram of a template
stands; places of one template that keep their distance to the template's own (a diagonal) vote for one span.  Diagonals
that lie next to each other, as words put in or left out move them, are merged; then a span's words are held against the
template's, so a hash alone decides nothing.

The documents are read once.  Templates are constants of the program, so their join is a broadcast of known size; what
leaves the scan is a row for each document, and a row for each gram that a template has, too.  Words travel only with
documents that have such a gram.  Everything after is keyed by the document's row number: a row's hits are bounded by its
own text, and documents never meet.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM_WORDS = 3
#: A span must have this share of its template's different words, and votes of this share of its grams.
LEAST_SHARE, LEAST_VOTES = 0.8, 0.5
#: One word in so many of a template may be put in or left out before its diagonals are told apart.
WORDS_A_SLIP = 8


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False  # places where its words stand consecutively are counted


#: Phrases that are counted, and openings of public license notices.
TEMPLATES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "released under the mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    Template("cc-by-nc", "licensed under cc by nc 4"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
]


def words_of(text: Column) -> Column:
    """Runs of digits, letters and anything beyond ASCII, A to Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, by place."""
    rolled = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(rolled, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def template_grams(spark: SparkSession, templates: list[Template], k: int) -> DataFrame:
    """(hash, template, at) of every gram of every template."""
    rows = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t.text).alias("text")) for n, t in enumerate(templates)])
    table = spark.range(1).select(F.inline(rows)).withColumn("words", words_of(F.col("text")))
    return table.select("template", F.posexplode(gram_hashes(F.col("words"), k)).alias("at", "hash"))


#: Stands for the document itself among its grams: a place and a hash of its own.
WHOLE_AT, WHOLE_HASH = -1, 0


def gram_hits(docs: DataFrame, templates: list[Template], k: int) -> DataFrame:
    """(row, doc_id, n_words, at, template, place, words), written: for each document one row with ``at`` = -1, whose
    words are null where no gram can match, and one for each gram at ``at`` that stands at ``place`` in a template."""
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k).collect()  # constants of the program
    known = F.array(*[F.lit(h) for h in sorted({g.hash for g in grams})])
    hashes = F.array(*[F.struct(F.lit(g.hash).alias("hash"), F.lit(g.template).alias("template"), F.lit(g.at).alias("place")) for g in grams], F.struct(F.lit(WHOLE_HASH).cast("long").alias("hash"), F.lit(-1).alias("template"), F.lit(-1).alias("place")))
    places = spark.range(1).select(F.inline(hashes))
    # numbering before the words keeps them in a projection of their own
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    split = numbered.withColumn("words", words_of(F.col("text"))).drop("text")
    hashed = split.withColumn("grams", gram_hashes(F.col("words"), k)).withColumn("n_words", F.size("words").cast("long"))
    no_words = F.lit(None).cast("array<string>")
    whole = F.struct(F.lit(WHOLE_AT).alias("at"), F.lit(WHOLE_HASH).cast("long").alias("hash"), F.when(F.arrays_overlap("grams", known), F.col("words")).alias("words"))
    each = F.transform("grams", lambda h, i: F.struct(i.alias("at"), h.alias("hash"), no_words.alias("words")))
    rolling = hashed.select("row", "doc_id", "n_words", F.inline(F.concat(F.array(whole), each)))
    hits = rolling.join(F.broadcast(places), "hash").where((F.col("template") < 0) == (F.col("at") < 0)).drop("hash")
    return write_table(hits, "gram-hits")


def spans_of(hits: DataFrame, templates: list[Template], k: int) -> DataFrame:
    """(row, spans, places): of each document the merged spans (template, start, length, votes, grams) that have votes
    enough, and the places (template, start) where all grams of a phrase follow each other."""
    sizes = F.array(*[F.lit(len(template_words(t.text))) for t in templates])
    phrase = F.array(*[F.lit(t.phrase) for t in templates])
    votes = hits.where("template >= 0").withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("row", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    lines = lines.withColumn("grams", F.get(sizes, F.col("template")) - (k - 1)).withColumn("slip", F.floor((F.col("grams") + (k - 1)) / WORDS_A_SLIP))
    lines = lines.repartition("row")  # serves all that follows
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slip"), F.lit(True))
    lines = lines.withColumn("span", F.sum(fresh.cast("int")).over(along))
    full = F.when(F.get(phrase, F.col("template")) & (F.col("votes") == F.col("grams")), F.struct("template", F.col("diagonal").alias("start")))
    spans = lines.groupBy("row", "template", "span").agg(
        F.min("first").alias("start"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.max("grams").alias("grams"), F.collect_list(full).alias("places")
    )
    span = F.struct("template", "start", (F.col("last") - F.col("start") + k).alias("length"))
    enough = F.when(F.col("votes") >= F.col("grams") * LEAST_VOTES, span)
    return spans.groupBy("row").agg(F.collect_list(enough).alias("spans"), F.flatten(F.collect_list("places")).alias("places"))


def template_words(text: str) -> list[str]:
    """Words of a template, for plan constants."""
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, k: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of (doc_id, text).

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the least and largest of their
    starts (null if none), ``base_labels`` their labels.  ``labels`` adds those of verified spans, ``score`` is the
    largest share of a template's different words that a verified span has (1 at a phrase, 0 if nothing is found);
    ``spans`` lists (label, start, length, share) by start.  A span is verified when that share is 0.8 or more and half of
    the template's grams vote for it; where words are put in or left out, spans are cut at the outermost gram that votes.

    A null text counts as empty and has no words; a null id stays; repeated rows are scanned alike; other columns aren't
    read; an empty table gives an empty result.  A text is one row from end to end, so it must fit a task many times
    over (its grams are a list); its hits go by row number, so a text full of phrases is one group of that size.
    A template needs at least ``k`` words.
    """
    templates = TEMPLATES if templates is None else templates
    words = [template_words(t.text) for t in templates]
    if min(map(len, words)) < k:
        raise ValueError(f"templates need {k} words or more")
    hits = gram_hits(docs, templates, k)
    whole = hits.where(F.col("at") < 0).select("row", "doc_id", "n_words", "words")
    label = F.array(*[F.lit(t.label) for t in templates])
    text = F.array(*[F.array(*map(F.lit, w)) for w in words])
    different = F.array(*[F.lit(len(set(w))) for w in words])

    found = whole.where("words IS NOT NULL").join(spans_of(hits, templates, k), "row", "left")
    here = lambda start, length: F.slice(F.col("words"), start + 1, length)
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    places = F.filter(none("places", "array<struct<template:int,start:int>>"), lambda p: here(p.start, F.size(F.get(text, p.template))) == F.get(text, p.template))
    share = lambda s: F.size(F.array_intersect(here(s.start, s.length), F.get(text, s.template))) / F.get(different, s.template)
    spans = F.transform(
        none("spans", "array<struct<template:int,start:int,length:int>>"),
        lambda s: F.struct(s.start.alias("start"), s.length.alias("length"), F.get(label, s.template).alias("label"), share(s).alias("share")),
    )
    found = found.withColumn("places", places).withColumn("spans", F.sort_array(F.filter(spans, lambda s: s.share >= LEAST_SHARE)))
    named = F.transform("places", lambda p: F.get(label, p.template))
    starts = F.transform("places", lambda p: p.start.cast("long"))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0))
    found = found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(named).alias("base_labels"), listed(F.concat(named, F.transform("spans", lambda s: s.label))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"), F.transform("spans", lambda s: F.struct(s.label.alias("label"), s.start.alias("start"), s.length.alias("length"), s.share.alias("share"))).alias("spans"),
    )
    plain = whole.where("words IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.array().cast("array<struct<label:string,start:int,length:int,share:double>>").alias("spans"),
    )
    return found.unionByName(plain)
