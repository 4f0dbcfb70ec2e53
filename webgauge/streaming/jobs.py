"""Job states over a stream of job events: running to done or error, stale after silence, forgotten after their TTL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webgauge.constants import JOB_STALE_S, JOB_TTL_S

OUTPUT = "job_id string, owner string, status string, updates long, created_at timestamp, updated_at timestamp"
STATE = "owner string, status string, updates long, created double, updated double"


def stream_jobs(events: DataFrame, stale_s: int = JOB_STALE_S, ttl_s: int = JOB_TTL_S, watermark: str = "1 minute") -> DataFrame:
    """Events (job_id, owner, ts, status) to each job's state after each batch, and when it goes stale (error)."""

    def row(job: str, s: tuple) -> pd.DataFrame:
        return pd.DataFrame([[job, s[0], s[1], s[2], pd.Timestamp(s[3], unit="s"), pd.Timestamp(s[4], unit="s")]], columns=["job_id", "owner", "status", "updates", "created_at", "updated_at"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job,) = key
        if state.hasTimedOut:
            owner, status, n, created, updated = state.get
            if status == "running":
                s = (owner, "error", n, created, updated)
                state.update(s)
                state.setTimeoutTimestamp(max(int((updated + ttl_s) * 1000), state.getCurrentWatermarkMs() + 1))
                yield row(job, s)
            else:
                state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts", ignore_index=True)
        at = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        owner, status, n, created, updated = state.get if state.exists else (rows["owner"].iloc[0], "running", 0, float(at[0]), float(at[0]))
        for t, new in zip(at, rows["status"]):
            n, updated = n + 1, max(updated, float(t))
            if status == "running" and new in ("done", "error"):
                status = new
        s = (owner, status, n, created, updated)
        state.update(s)
        state.setTimeoutTimestamp(max(int((updated + (stale_s if status == "running" else ttl_s)) * 1000), state.getCurrentWatermarkMs() + 1))
        yield row(job, s)

    source = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("owner").cast("string").alias("owner"), F.col("ts").cast("timestamp").alias("ts"), "status").where("job_id is not null")
    return source.withWatermark("ts", watermark).groupBy("job_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
