"""Replays of the events table as streams: caps on jobs in flight, lives of jobs, and polls of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.operators import admission
from webgauge.queries.registry import query, table
from webgauge.runtime import scratch_path, session_settings
from webgauge.streaming import lifecycle
from webgauge.streaming.admission import stream_capped

#: Shares of all events, by time, at which a replay's runs end.
RUNS = (0.4, 0.7, 1.0)
#: Bins of a round of ``times_at``.
BINS = 2**14


def times_at(events: DataFrame, shares: tuple) -> list[int]:
    """For each share, the ``ts_us`` at that place of all in order (rounded down), found in ever narrower bins: an exact
    ``percentile`` gathers all different times in one task.  A bin of few events is told apart into single times at once."""
    n, low, high = events.agg(F.count("ts_us"), F.min("ts_us"), F.max("ts_us")).first()
    if not n:
        return [0] * len(shares)
    found = [(low, high, int(share * (n - 1)), n) for share in shares]  # (first time, last time, events of these before the place, all of these)
    while open_spans := {(low, high, m) for low, high, _, m in found if low < high}:
        width = {low: 1 if m <= BINS else -(-(high - low + 1) // BINS) for low, high, m in open_spans}
        bins = F.coalesce(*(F.when(F.col("ts_us").between(low, high), F.struct(F.lit(low).alias("low"), F.expr(f"(ts_us - ({low}L)) div {width[low]}L").alias("bin"))) for low, high, _ in open_spans))
        counts: dict[int, list] = {}
        for low, k, m in sorted(events.select(bins.alias("x")).where("x IS NOT NULL").groupBy("x").count().select("x.low", "x.bin", "count").collect()):
            counts.setdefault(low, []).append((k, m))
        for i, (low, high, place, _) in enumerate(found):
            for k, m in counts.get(low, []) if low < high else []:
                if place < m:
                    first = low + k * width[low]
                    found[i] = first, min(high, first + width[low] - 1), place, m
                    break
                place -= m
    return [low for low, *_ in found]


def replay(spark: SparkSession, events: DataFrame, stream: Callable[[DataFrame], DataFrame], name: str, runs: tuple = RUNS) -> tuple[DataFrame, str]:
    """(what a stream of the events gives, its checkpoint); events come in runs by time, each run a start of the stream."""
    folder = scratch_path(spark, name)
    cuts = [None, *times_at(events, RUNS[:-1])]
    # each partition of the state costs a store and a Python worker in every batch, whatever it holds
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    with session_settings(spark, spark__sql__streaming__stateStore__providerClass=lifecycle.ROCKSDB, spark__sql__shuffle__partitions=str(parts)):
        for k in range(len(runs)):
            part = events.where(F.col("ts_us") <= cuts[k + 1]) if k < len(RUNS) - 1 else events
            part = part if k == 0 else part.where(F.col("ts_us") > cuts[k])
            part.drop("ts_us").write.mode("append").parquet(f"{folder}/in")
            out = stream(spark.readStream.schema(part.drop("ts_us").schema).parquet(f"{folder}/in"))
            run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), f"{folder}/state"


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their times as instants, read as UTC whatever the session's zone."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    with session_settings(spark, spark__sql__session__timeZone="UTC"):  # a cast keeps the zone that it was made in
        return e.withColumn("ts", F.col("ts").cast("timestamp"))


# -- caps on jobs in flight --------------------------------------------------------------------------------------------------

CAPS = {"quota": 4, "window_s": 6 * 3600, "per_key": 2, "overall": 5}


def starts_and_finishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a job of its user that runs for ``value`` times ten minutes, in one of seven services."""
    e = timed_events(spark, sf_dir)
    end = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.coalesce("value", F.lit(0.0)) * 600).cast("long") * 1_000_000)
    rows = e.select("event_id", "user_id", F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("ts")), F.struct(F.lit("finish").alias("kind"), end.alias("ts")))).alias("x"))
    return rows.select((F.col("user_id") % 7).alias("service"), (F.col("user_id") % 21).alias("key"), F.col("event_id").alias("job_id"), "event_id", "x.ts", "x.kind")


CAPPED_SQL = f"""WITH RECURSIVE j AS (
        SELECT user_id % 7 AS service, user_id % 21 AS key, event_id, epoch_us(ts) AS tm, epoch_us(ts) + CAST(floor(coalesce(value, 0) * 600) AS BIGINT) * 1000000 AS until FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
    ), x AS (
        SELECT service, key, event_id, tm, 'start' AS kind FROM j UNION ALL SELECT service, key, event_id, until, 'finish' FROM j
    ), e AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY service ORDER BY tm, kind, event_id) AS n FROM x
    ), s AS (
        SELECT service, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS key, CAST(NULL AS VARCHAR) AS refusal, CAST([] AS STRUCT(job BIGINT, key BIGINT)[]) AS running,
            CAST([] AS STRUCT(key BIGINT, start BIGINT, used BIGINT)[]) AS windows FROM (SELECT DISTINCT service FROM e)
        UNION ALL
        SELECT service, n, CASE WHEN kind = 'start' THEN event_id END, key, refusal,
            CASE WHEN kind = 'finish' THEN list_filter(running, lambda r: r.job <> event_id) WHEN refusal IS NULL THEN list_append(running, {{'job': event_id, 'key': key}}) ELSE running END,
            CASE WHEN kind = 'finish' THEN windows ELSE list_append(list_filter(windows, lambda z: z.key <> key), {{'key': key, 'start': w.start, 'used': w.used + CASE WHEN refusal IS NULL THEN 1 ELSE 0 END}}) END
        FROM (
            SELECT *, CASE WHEN kind = 'finish' THEN NULL WHEN len(running) >= {CAPS["overall"]} THEN '{admission.BUSY}' WHEN len(list_filter(running, lambda r: r.key = key)) >= {CAPS["per_key"]} THEN '{admission.OWN_RUNNING}'
                WHEN w.used >= {CAPS["quota"]} THEN '{admission.QUOTA}' END AS refusal
            FROM (
                SELECT e.service, e.n, e.event_id, e.key, e.kind, s.running, s.windows,
                    coalesce(list_filter(s.windows, lambda z: z.key = e.key AND e.tm < z.start + {CAPS["window_s"] * 1000000})[1], {{'key': e.key, 'start': e.tm, 'used': CAST(0 AS BIGINT)}}) AS w
                FROM s JOIN e ON e.service = s.service AND e.n = s.n + 1
            )
        )
    )
    SELECT event_id, CAST(service AS VARCHAR) AS service, CAST(key AS VARCHAR) AS key, refusal IS NULL AS admitted, refusal, CAST(len(running) AS INTEGER) AS running FROM s WHERE event_id IS NOT NULL"""
SHOWN = ["event_id", "service", "key", "admitted", "refusal", "running"]


@query(CAPPED_SQL)
def admission_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs admitted under a quota and under caps on those that run, of a user and of a service."""
    return admission.capped_admissions(starts_and_finishes(spark, sf_dir), **CAPS).select(*SHOWN)


@query(CAPPED_SQL)
def admission_capped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream that is stopped and started again twice."""
    events = starts_and_finishes(spark, sf_dir).withColumn("ts_us", F.unix_micros("ts"))
    return replay(spark, events, lambda s: stream_capped(s, **CAPS), "capped")[0].select(*SHOWN)


# -- lives of jobs -----------------------------------------------------------------------------------------------------------------

KINDS = ["created", "progress", "progress", "done", "progress", "error", "progress"]
STALE_S, TTL_S = 6 * 3600, 18 * 3600


def events_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each user, whose events create it, report on it, and end it."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 7).cast("int"))
    e = timed_events(spark, sf_dir).withColumn("kind", kind)
    return e.select(F.col("user_id").alias("job_id"), (F.col("user_id") % 10).alias("owner"), "event_id", "ts", "kind", F.floor("value").cast("long").alias("crawled"), F.concat(F.lit("detail "), "event_id").alias("detail"), F.unix_micros("ts").alias("ts_us"))


def _jobs_sql(share: float) -> str:
    """Job states after each event among the first ones by time, and what was due between them."""
    return f"""WITH RECURSIVE a AS (SELECT * FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), f AS (
        SELECT user_id AS job, event_id, epoch_us(ts) // 1000 AS tm, {KINDS!r}[event_id % 7 + 1] AS kind, CAST(floor(value) AS BIGINT) AS crawled, 'detail ' || event_id AS detail FROM a
        WHERE epoch_us(ts) <= (SELECT quantile_cont(epoch_us(ts), {share}) FROM a)
    ), e AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY job ORDER BY tm, event_id) AS n, lead(tm) OVER (PARTITION BY job ORDER BY tm, event_id) AS next FROM f
    ), s AS (
        SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS kind, FALSE AS known, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS crawled, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS VARCHAR) AS error,
            CAST(NULL AS BIGINT) AS tm, FALSE AS applied FROM e
        UNION ALL
        SELECT job, n, kind, kind = 'created' OR there,
            CASE WHEN kind IN ('done', 'error') THEN kind WHEN kind = 'created' THEN 'running' WHEN given_up THEN 'error' ELSE status END,
            CASE WHEN kind = 'created' THEN 0 WHEN kind = 'progress' THEN coalesce(reported, crawled) ELSE crawled END, CASE WHEN kind = 'done' THEN detail WHEN kind IN ('created', 'error') OR given_up THEN NULL ELSE result END,
            CASE WHEN kind = 'error' THEN detail WHEN kind IN ('created', 'done') THEN NULL WHEN given_up THEN '{lifecycle.ABANDONED}' ELSE error END, now, kind = 'created' OR there
        FROM (
            SELECT s.* EXCLUDE (n, kind), e.n, e.kind, e.tm AS now, e.crawled AS reported, e.detail, s.status = 'running' AND s.tm + {STALE_S * 1000 + 1} <= e.tm AS given_up,
                s.known AND e.tm < s.tm + {TTL_S * 1000 + 1} + CASE WHEN s.status = 'running' THEN {STALE_S * 1000 + 1} ELSE 0 END AS there
            FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1
        )
    ), t AS (
        SELECT s.*, coalesce(e.next, (SELECT max(tm) FROM e)) AS until, s.tm + CASE WHEN s.status = 'running' THEN {STALE_S * 1000 + 1} ELSE 0 END AS over, s.status = 'running' AS runs FROM s JOIN e USING (job, n)
    )"""


@query(
    f"""{_jobs_sql(1.0)}, c AS (
        SELECT job, tm, kind AS change, status, crawled FROM t WHERE applied
        UNION ALL SELECT job, over, 'stale', 'error', crawled FROM t WHERE known AND runs AND over <= until
        UNION ALL SELECT job, over + {TTL_S * 1000 + 1}, 'expired', CASE WHEN runs THEN 'error' ELSE status END, crawled FROM t WHERE known AND over + {TTL_S * 1000 + 1} <= until
    )
    SELECT CAST(job AS VARCHAR) AS job_id, CAST(job % 10 AS VARCHAR) AS owner, tm AS "at", change, status, crawled FROM c"""
)
def job_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every job, those by timers among them, over a stream that is stopped and started again twice."""
    found = replay(spark, events_of_jobs(spark, sf_dir), lambda s: lifecycle.job_changes(s, STALE_S, TTL_S), "jobs")[0]
    return found.withColumn("at", F.unix_millis("at"))


@query(
    f"""{_jobs_sql(RUNS[1])}, l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1),
    k AS (SELECT *, runs AND over <= until AS given_up FROM l WHERE known AND over + {TTL_S * 1000 + 1} > until), asked AS (SELECT DISTINCT user_id AS job FROM events WHERE user_id IS NOT NULL)
    SELECT CAST(job AS VARCHAR) AS job_id, k.job IS NOT NULL AS found, CASE WHEN given_up THEN 'error' ELSE status END AS status, crawled, CASE WHEN k.job IS NULL THEN '{lifecycle.NOT_FOUND}' WHEN given_up THEN '{lifecycle.ABANDONED}' ELSE error END AS error,
        CASE WHEN status = 'done' THEN result END AS result FROM asked LEFT JOIN k USING (job)"""
)
def job_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poll of every job says from the state of the stream after two of its three runs."""
    events = events_of_jobs(spark, sf_dir)
    _, checkpoint = replay(spark, events, lambda s: lifecycle.job_changes(s, STALE_S, TTL_S), "polled", RUNS[:2])
    return lifecycle.poll(lifecycle.known_jobs(spark, checkpoint), events.select("job_id"))
