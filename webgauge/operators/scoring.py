"""Findings to points, category scores, the overall score and an ordered to-do list.

Findings: (page_id, cat_pos, category, check_pos, check, importance, find_pos, status, text, todo).  Every aggregation is
keyed by the page, so all of them share one shuffle on page_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgauge.constants import CATEGORIES, IMPORTANCE
from webgauge.functions.numbers import grade, verdict


def _by_name(column: Column, values: dict[str, object]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def importance_weight(column: Column) -> Column:
    return _by_name(column, {k: v[1] for k, v in IMPORTANCE.items()})


def importance_rank(column: Column) -> Column:
    return _by_name(column, {k: v[2] for k, v in IMPORTANCE.items()})


def check_points(findings: DataFrame) -> DataFrame:
    """(page_id, cat_pos, category, check_pos, check, importance, earned, max, status): a finding is a point unless info."""
    severity = _by_name(F.col("status"), {"fail": 2, "warn": 1, "ok": 0, "info": 0})
    grouped = findings.groupBy("page_id", "cat_pos", "category", "check_pos", "check", "importance").agg(
        F.count_if(F.col("status") == "ok").alias("earned"), F.count_if(F.col("status") != "info").alias("max"), F.max(severity).alias("worst")
    )
    return grouped.withColumn("status", F.when(F.col("worst") == 2, "fail").when(F.col("worst") == 1, "warn").otherwise("ok")).drop("worst")


def category_scores(checks: DataFrame, mode: str = "seo", unmeasured: Column | None = None) -> DataFrame:
    """(page_id, cat_pos, category, score, weight, measured, earned, max, ok, warn, fail); score null where nothing counts."""
    w = importance_weight(F.col("importance"))
    grouped = checks.groupBy("page_id", "cat_pos", "category").agg(
        F.sum(F.col("earned") * w).alias("got"), F.sum(F.col("max") * w).alias("of"), F.sum("earned").alias("earned"), F.sum("max").alias("max"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "fail")],
    )
    weight = _by_name(F.col("category"), {k: float(v) for k, _, v in CATEGORIES[mode]})
    score = F.when(F.col("of") > 0, F.floor(100.0 * F.col("got") / F.col("of") + 0.5).cast("int"))
    measured = F.lit(True) if unmeasured is None else ~unmeasured
    return grouped.select("page_id", "cat_pos", "category", score.alias("score"), weight.alias("weight"), measured.alias("measured"), "earned", "max", "ok", "warn", "fail")


def page_scores(categories: DataFrame) -> DataFrame:
    """(page_id, score, grade, verdict): the weighted mean of rounded category scores; 0 where none counts."""
    counts = F.col("measured") & F.col("score").isNotNull()
    total = F.sum(F.when(counts, F.col("score") * F.col("weight")))
    weight = F.sum(F.when(counts, F.col("weight")))
    out = categories.groupBy("page_id").agg(F.coalesce(F.floor(total / F.when(weight > 0, weight) + 0.5), F.lit(0)).cast("int").alias("score"))
    return out.withColumn("grade", grade(F.col("score"))).withColumn("verdict", verdict(F.col("score")))


def page_totals(findings: DataFrame) -> DataFrame:
    """(page_id, checks, findings, errors, warnings, passed) over all categories, measured or not."""
    return findings.groupBy("page_id").agg(
        F.count_distinct("cat_pos", "check_pos").alias("checks"), F.count_if(F.col("status") != "info").alias("findings"), F.count_if(F.col("status") == "fail").alias("errors"),
        F.count_if(F.col("status") == "warn").alias("warnings"), F.count_if(F.col("status") == "ok").alias("passed"),
    )


def todos(findings: DataFrame) -> DataFrame:
    """(page_id, place, check, category, action, importance, status): by rank, failures first, then catalog order; an
    action that repeats stays at its first place."""
    natural = ["cat_pos", "check_pos", "find_pos"]
    bad = findings.where(F.col("status").isin("warn", "fail") & F.col("todo").isNotNull()).withColumn("action", F.trim("todo")).where("action <> ''")
    order = [importance_rank(F.col("importance")), F.col("status") == "warn", *natural, "action"]
    first = bad.withColumn("again", F.row_number().over(Window.partitionBy("page_id", "action").orderBy(*order))).where("again = 1")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    return first.select("page_id", place.alias("place"), "check", "category", "action", "importance", "status")
