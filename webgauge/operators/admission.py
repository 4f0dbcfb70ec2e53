"""Admission of requests by a quota in windows that begin with a key's first request, and by caps on jobs in flight."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgauge.constants import AUDIT_QUOTA, AUDIT_WINDOW_S, RUNNING_OVERALL, RUNNING_PER_KEY, TRACKED_KEYS


def admit_times(times: np.ndarray, quota: int, window: float, start: float | None = None, count: int = 0) -> tuple[np.ndarray, float | None, int]:
    """(admitted, window start, count in it) for ascending times of one key, going on from (start, count).

    Rejected requests neither count nor move the window.
    """
    admitted = np.zeros(len(times), bool)
    at = 0
    while at < len(times):
        if start is None or times[at] >= start + window:
            start, count = float(times[at]), 0
        end = int(np.searchsorted(times, start + window, side="left"))
        take = max(0, min(quota - count, end - at))
        admitted[at : at + take] = True
        count += take
        at = end
    return admitted, start, count


def admissions(requests: DataFrame, quota: int = AUDIT_QUOTA, window_s: float = AUDIT_WINDOW_S) -> DataFrame:
    """Requests (key, event_id, ts) with admitted: the fold over a key's time order that no window frame expresses.

    Rows are sorted by key and time in each partition and folded batch by batch, so a hot key streams through bounded
    memory instead of being one group in one frame.
    """

    def run(batches):
        key, start, count = object(), None, 0
        for pdf in batches:
            at = pdf["at"].to_numpy(float)
            change = np.flatnonzero(np.concatenate([[True], (pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1])])) if len(pdf) else []
            out = np.zeros(len(pdf), bool)
            for lo, hi in zip(change, [*change[1:], len(pdf)]):
                k = pdf["key"].iloc[lo]
                if k != key:
                    key, start, count = k, None, 0
                out[lo:hi], start, count = admit_times(at[lo:hi], quota, window_s, start, count)
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "ts": pdf["ts"], "admitted": out})

    source = requests.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    ordered = source.withColumn("at", F.unix_micros("ts") / 1e6).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(run, "key string, event_id long, ts timestamp, admitted boolean")


BUSY, OWN_RUNNING, QUOTA = "busy", "own jobs running", "quota"


class Limiter:
    """The state of one service: windows (start, requests admitted) of its keys and the jobs that run.

    A start takes nothing where it is refused; its window begins all the same.  Keys whose window is over and that run
    nothing are forgotten, oldest first, when more than ``tracked`` are known, down to nine tenths of that.
    """

    def __init__(self, quota: int, window_us: int, per_key: int = RUNNING_PER_KEY, overall: int = RUNNING_OVERALL, tracked: int = TRACKED_KEYS):
        self.quota, self.window_us, self.per_key, self.overall, self.tracked = quota, window_us, per_key, overall, tracked
        self.windows: dict[str, tuple[int, int]] = {}
        self.running: dict[str, str] = {}

    def start(self, key: str, job: str, now: int) -> str | None:
        """Why the job isn't admitted, if it isn't."""
        begun, used = self.windows.get(key, (now, 0))
        if now >= begun + self.window_us:
            begun, used = now, 0
        self.windows[key] = begun, used
        if len(self.windows) > self.tracked:
            self.sweep(now)
        if len(self.running) >= self.overall:
            return BUSY
        if job in self.running or sum(k == key for k in self.running.values()) >= self.per_key:
            return OWN_RUNNING
        if used >= self.quota:
            return QUOTA
        self.windows[key] = begun, used + 1
        self.running[job] = key
        return None

    def finish(self, job: str) -> None:
        self.running.pop(job, None)

    def sweep(self, now: int) -> None:
        busy = set(self.running.values())
        for key, (begun, _) in list(self.windows.items()):
            if len(self.windows) <= self.tracked * 0.9:
                return
            if now >= begun + self.window_us and key not in busy:
                del self.windows[key]

    def fold(self, events: pd.DataFrame) -> pd.DataFrame:
        """The starts among events (key, job_id, event_id, ts, at, kind) in order, with what became of them."""
        out = []
        for i, (key, job, at, kind) in enumerate(zip(events["key"], events["job_id"], events["at"].tolist(), events["kind"])):
            if kind == "start":
                why = self.start(key, job, at)
                out.append((i, why is None, why, len(self.running), len(self.windows)))
            else:
                self.finish(job)
        kept = events.iloc[[x[0] for x in out]][["service", "key", "job_id", "event_id", "ts"]].reset_index(drop=True)
        # typed, since pandas would take the columns of events without any start for numbers
        return kept.assign(**{name: pd.Series([x[k + 1] for x in out], dtype=kind) for k, (name, kind) in enumerate((("admitted", bool), ("refusal", object), ("running", "int32"), ("tracked", "int32")))})


CAPPED = "service string, key string, job_id string, event_id long, ts timestamp, admitted boolean, refusal string, running int, tracked int"


def job_events(events: DataFrame) -> DataFrame:
    """Events (service, key, job_id, event_id, ts, kind) in the types of the fold, with ``at`` in microseconds; kind is
    start or finish.  Rows without service, key, job or time are left out."""
    text = [F.col(c).cast("string").alias(c) for c in ("service", "key", "job_id")]
    rows = events.select(*text, F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "kind")
    return rows.where("service is not null and key is not null and job_id is not null and ts is not null and kind in ('start', 'finish')").withColumn("at", F.unix_micros("ts"))


def capped_admissions(
    events: DataFrame, quota: int = AUDIT_QUOTA, window_s: float = AUDIT_WINDOW_S, per_key: int = RUNNING_PER_KEY, overall: int = RUNNING_OVERALL, tracked: int = TRACKED_KEYS
) -> DataFrame:
    """Starts of jobs (see ``CAPPED``) with whether each is admitted, why not, and how many run after it.

    Each service admits by itself: at most ``overall`` jobs at once, ``per_key`` of a key, and ``quota`` of a key in a
    window.  Finishes at the time of a start come first, other events of one time by their id.  A finish releases what
    its job's start took; of a job refused or unknown it releases nothing.

    A service's events are sorted within its partition and folded batch by batch, with the jobs that run and the open
    windows carried on: a hot service streams through bounded memory.
    """

    def run(batches):
        service, state = None, None
        for pdf in batches:
            change = np.flatnonzero(np.concatenate([[True], pdf["service"].to_numpy()[1:] != pdf["service"].to_numpy()[:-1]])) if len(pdf) else []
            for lo, hi in zip(change, [*change[1:], len(pdf)]):
                if state is None or pdf["service"].iloc[lo] != service:
                    service, state = pdf["service"].iloc[lo], Limiter(quota, round(window_s * 1e6), per_key, overall, tracked)
                yield state.fold(pdf.iloc[lo:hi])

    ordered = job_events(events).repartition("service").sortWithinPartitions("service", "at", "kind", "event_id")
    return ordered.mapInPandas(run, CAPPED)


def in_flight(events: DataFrame, key: Column | None = None) -> DataFrame:
    """Events (key, ts, delta ±1) with how many were running after each, for each key."""
    w = Window.partitionBy("key").orderBy("ts", F.desc("delta"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("active", F.sum("delta").over(w))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """(owner, running) and, with a null owner, their total, of jobs (job_id, owner, status)."""
    return jobs.where("status = 'running'").rollup("owner").agg(F.count("*").alias("running"))
