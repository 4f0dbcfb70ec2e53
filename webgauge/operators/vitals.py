"""Field metrics: ratings, split, display, pass, and the fall-back from page to origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.constants import VITALS
from webgauge.functions.numbers import percent


def _threshold(metric: Column, place: int) -> Column:
    out = None
    for k, v in VITALS.items():
        out = F.when(metric == k, v[place]) if out is None else out.when(metric == k, v[place])
    return out


def rate(metric: Column, value: Column) -> Column:
    """good, needs-improvement or poor; null for unknown metrics and missing values."""
    good, poor = _threshold(metric, 0), _threshold(metric, 1)
    return F.when(good.isNull() | value.isNull(), F.lit(None).cast("string")).when(value <= good, "good").when(value <= poor, "needs-improvement").otherwise("poor")


def display(metric: Column, value: Column) -> Column:
    ms = _threshold(metric, 2) == "ms"
    return (
        F.when(value.isNull(), "—")
        .when(ms & (value >= 1000), F.format_string("%.2f s", value / 1000.0))
        .when(ms, F.concat(F.floor(value + 0.5).cast("string"), F.lit(" ms")))
        .otherwise(F.format_string("%.2f", value.cast("double")))
    )


def period(day: Column) -> Column:
    return F.format_string("%d-%02d-%02d", F.year(day), F.month(day), F.dayofmonth(day))


def rated(records: DataFrame) -> DataFrame:
    """Records (target, metric, p75, density) with rating, core, and the shares of each rating in percent."""
    d = F.col("density")
    return records.withColumns(
        {"rating": rate(F.col("metric"), F.col("p75")), "shown": display(F.col("metric"), F.col("p75")), "core": _threshold(F.col("metric"), 4), "good": percent(F.get(d, F.lit(0))), "needs_improvement": percent(F.get(d, F.lit(1))), "poor": percent(F.get(d, F.lit(2)))}
    )


def passes(records: DataFrame) -> DataFrame:
    """(target, passes): no core metric that is present falls short."""
    return records.groupBy("target").agg(F.bool_and(F.when(F.col("core"), F.coalesce(F.col("rating"), F.lit("good")) == "good").otherwise(True)).alias("passes"))


def with_fallback(pages: DataFrame, vitals: DataFrame) -> DataFrame:
    """Pages (url, origin) with their own field data, or their origin's where their own is missing for lack of data.

    vitals: (target, scope, reason, data); reason null where data is there.
    """
    own = vitals.where("scope = 'url'").select(F.col("target").alias("url"), F.col("reason").alias("own_reason"), F.col("data").alias("own"))
    site = vitals.where("scope = 'origin'").select(F.col("target").alias("origin"), F.col("reason").alias("site_reason"), F.col("data").alias("site"))
    j = pages.join(own, "url", "left").join(site, "origin", "left")
    fell = F.coalesce("own_reason", F.when(F.col("own").isNull(), "no-data")) == "no-data"
    use = F.coalesce(fell, F.lit(False)) & F.col("site").isNotNull()
    return j.select(*pages.columns, F.when(use, F.col("site")).otherwise(F.col("own")).alias("data"), use.alias("fell_back_from_url"), F.when(use, F.lit(None).cast("string")).otherwise(F.coalesce("own_reason", F.when(F.col("own").isNull(), "no-data"))).alias("reason"))


def parse_response(body: Column) -> Column:
    """The service's JSON answer as a struct."""
    metric = "struct<histogram:array<struct<start:string,end:string,density:double>>,percentiles:struct<p75:string>>"
    day = "struct<year:int,month:int,day:int>"
    return F.from_json(body, f"record struct<key:struct<url:string,origin:string,formFactor:string>,metrics:map<string,{metric}>,collectionPeriod:struct<firstDate:{day},lastDate:{day}>>, error struct<code:int,message:string>")


def reason(status: Column) -> Column:
    """Why there is no data, by the answer's status."""
    return F.when(status == 200, F.lit(None).cast("string")).when(status == 404, "no-data").when(status == 403, "forbidden").when(status == 429, "quota").otherwise("error")


#: The service's names of the metrics.
SERVICE_NAMES = {
    "largest_contentful_paint": "lcp",
    "interaction_to_next_paint": "inp",
    "cumulative_layout_shift": "cls",
    "first_contentful_paint": "fcp",
    "experimental_time_to_first_byte": "ttfb",
}


def field_data(responses: DataFrame) -> DataFrame:
    """The service's answers (target, scope, status, body) read: (target, scope, form_factor, period, reason, data, density).

    data: metric -> 75th percentile, of known metrics with a finite one; density: metric -> its shares in three buckets;
    period: first and last day.  Where there is none, reason says why: network (a null status: no answer came),
    bad-response (no JSON), forbidden, quota or error by the status, no-data.  Answers of repeated rows are repeated.
    """
    read = responses.withColumn("_r", parse_response(F.col("body").cast("string")))
    metrics, when = F.col("_r.record.metrics"), F.col("_r.record.collectionPeriod")
    known = F.map_filter(F.coalesce(metrics, F.map_from_arrays(F.array().cast("array<string>"), F.array()).cast(dict(read.select(metrics.alias("m")).dtypes)["m"])), lambda k, _: k.isin(*SERVICE_NAMES))
    names = F.create_map(*[F.lit(x) for pair in SERVICE_NAMES.items() for x in pair])
    p75 = lambda v: F.trim(v["percentiles"]["p75"]).try_cast("double")
    usable = F.map_filter(known, lambda _, v: p75(v).isNotNull() & ~F.isnan(p75(v)) & (F.abs(p75(v)) < float("inf")))
    named = F.transform_keys(usable, lambda k, _: F.element_at(names, k))
    why = (
        F.when(F.col("status").isNull(), "network")
        .when(F.try_parse_json(F.col("body").cast("string")).isNull(), "bad-response")
        .when(F.col("status") != 200, reason(F.col("status")))
        .when(F.size("_named") == 0, "no-data")
    )
    day = lambda d: F.make_date(d["year"], d["month"], d["day"])
    out = read.withColumn("_named", named).withColumn("reason", why)
    fits = F.col("reason").isNull()
    shares = F.transform_values("_named", lambda _, v: F.transform(F.coalesce(v["histogram"], F.array().cast("array<struct<start:string,end:string,density:double>>")), lambda b: F.coalesce(b["density"], F.lit(0.0))))
    return out.select(
        "target", "scope", F.when(fits, F.col("_r.record.key.formFactor")).alias("form_factor"),
        F.when(fits & when.isNotNull(), F.struct(period(day(when["firstDate"])).alias("first"), period(day(when["lastDate"])).alias("last"))).alias("period"), "reason",
        F.when(fits, F.transform_values("_named", lambda _, v: p75(v))).alias("data"), F.when(fits, shares).alias("density"),
    )


def records(read: DataFrame) -> DataFrame:
    """A row for each metric of read answers, as ``rated`` takes them: (target, scope, metric, p75, density)."""
    each = read.where("reason IS NULL").select("target", "scope", "density", F.explode("data").alias("metric", "p75"))
    return each.withColumn("density", F.element_at(F.col("density"), F.col("metric")))
