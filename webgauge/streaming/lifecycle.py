"""The life of jobs over a stream of their events: value state with event-time timers, read from outside while it runs.

A job runs from its creation until it is done or failed.  One that reports nothing for longer than ``stale_s`` is given up
as failed; one that no longer runs is forgotten when nothing was heard of it for longer than ``ttl_s``.  What is due
before an event is done before it, so that results don't depend on how events fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webgauge.constants import JOB_STALE_S, JOB_TTL_S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "owner string, status string, crawled long, result string, error string, created long, updated long"
CHANGES = "job_id string, owner string, at_ms long, change string, status string, crawled long"
ABANDONED = "no report for too long"
NOT_FOUND = "expired or never existed"
#: Groups of jobs that the state is kept in.
BUCKETS = 1024


class Jobs(StatefulProcessor):
    """The jobs of one bucket, with one timer at the first thing that is due among them."""

    def __init__(self, stale_ms: int, ttl_ms: int):
        self.stale_ms, self.ttl_ms = stale_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", STATE)

    def due(self, job: tuple) -> int:
        """When something happens to a job of which nothing more is heard, in milliseconds."""
        return job[6] + (self.stale_ms if job[1] == "running" else self.ttl_ms) + 1

    def elapse(self, job_id: str, job: tuple | None, until: int, changes: list) -> tuple | None:
        while job is not None and self.due(job) <= until:
            at = self.due(job)
            if job[1] == "running":
                job = (job[0], "error", job[2], None, ABANDONED, job[5], at)
                changes.append((job_id, job[0], at, "stale", job[1], job[2]))
            else:
                changes.append((job_id, job[0], at, "expired", job[1], job[2]))
                job = None
        return job

    def rows(self, changes: list) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=["job_id", "owner", "at_ms", "change", "status", "crawled"])

    def known(self) -> dict[str, tuple]:
        return {job_id: job for (job_id,), job in self.jobs.iterator()}

    def keep(self, before: dict[str, tuple], jobs: dict[str, tuple]) -> None:
        for job_id in before.keys() - jobs.keys():
            self.jobs.removeKey((job_id,))
        for job_id, job in jobs.items():
            if before.get(job_id) != job:
                self.jobs.updateValue((job_id,), job)
        timers, first = list(self.handle.listTimers()), [min(map(self.due, jobs.values()))] if jobs else []
        if timers != first:
            for timer in timers:
                self.handle.deleteTimer(timer)
            for timer in first:
                self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], ignore_index=True)
        before, changes = self.known(), []
        jobs = dict(before)
        counts = events["crawled"].astype(object).where(events["crawled"].notna(), None)
        for job_id, owner, at, kind, crawled, detail in zip(events["job_id"], events["owner"], events["at"].tolist(), events["kind"], counts, events["detail"]):
            job = self.elapse(job_id, jobs.pop(job_id, None), at, changes)
            if kind == "created":
                job = (owner, "running", 0, None, None, at, at)
            elif job is None:
                continue  # nothing to update
            elif kind == "done":
                job = (job[0], "done", job[2], detail, None, job[5], at)
            elif kind == "error":
                job = (job[0], "error", job[2], None, detail, job[5], at)
            else:
                job = (*job[:2], job[2] if crawled is None else int(crawled), *job[3:6], at)
            jobs[job_id] = job
            changes.append((job_id, job[0], at, kind, job[1], job[2]))
        self.keep(before, jobs)
        yield self.rows(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, changes = self.known(), []
        now = timerValues.getCurrentWatermarkInMs()
        left = {job_id: self.elapse(job_id, job, now, changes) for job_id, job in before.items()}
        self.keep(before, {job_id: job for job_id, job in left.items() if job is not None})
        yield self.rows(changes)

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, stale_s: float = JOB_STALE_S, ttl_s: float = JOB_TTL_S, watermark: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(job_id, owner, at, change, status, crawled): every change of every job of a stream of events (job_id, owner, event_id, ts, kind, crawled, detail).

    kind: created, progress, done or error; progress carries the pages crawled, done its result and error its message in
    ``detail``.  An update of a job that isn't known changes nothing; one of a job given up or ended counts; a job created
    again begins anew.  Events later than the watermark are dropped.  Needs the RocksDB state store.

    Jobs are kept in ``buckets`` by the hash of their id, since a call into Python and its talk with the store cost
    milliseconds; a bucket's jobs are read together.  A checkpoint holds for one number of buckets.
    """
    source = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("owner").cast("string").alias("owner"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
                           "kind", F.col("crawled").cast("long").alias("crawled"), F.col("detail").cast("string").alias("detail"))
    source = source.where("job_id IS NOT NULL AND kind IN ('created', 'progress', 'done', 'error')").withWatermark("ts", watermark).withColumn("at", F.unix_millis("ts"))
    source = source.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)))
    changes = source.groupBy("bucket").transformWithStateInPandas(Jobs(round(stale_s * 1000), round(ttl_s * 1000)), CHANGES, "Append", "eventTime")
    return changes.select("job_id", "owner", F.timestamp_millis("at_ms").alias("at"), "change", "status", "crawled")


def known_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job_id, owner, status, crawled, result, error, created, updated) as the last finished batch left them."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "jobs").load()
    return state.select(F.col("user_map_key.job_id").alias("job_id"), "user_map_value.*")


def poll(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """(job_id, found, status, crawled, error, result) of the jobs asked for; a result only of those done."""
    answer = jobs.select("job_id", F.lit(True).alias("found"), "status", "crawled", "error", F.when(F.col("status") == "done", F.col("result")).alias("result"))
    joined = asked.select(F.col("job_id").cast("string").alias("job_id")).distinct().join(answer, "job_id", "left")
    return joined.withColumns({"found": F.coalesce("found", F.lit(False)), "error": F.when(F.col("found").isNull(), NOT_FOUND).otherwise(F.col("error"))})
