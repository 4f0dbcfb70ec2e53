"""Quota admission over a stream: keyed state that outlives batches, dropped when its window is over."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webgauge.constants import AUDIT_QUOTA, AUDIT_WINDOW_S, RUNNING_OVERALL, RUNNING_PER_KEY, TRACKED_KEYS
from webgauge.operators.admission import CAPPED, Limiter, admit_times, job_events

OUTPUT = "key string, event_id long, ts timestamp, admitted boolean"


def stream_admissions(requests: DataFrame, quota: int = AUDIT_QUOTA, window_s: float = AUDIT_WINDOW_S, watermark: str = "1 minute") -> DataFrame:
    """Requests (key, event_id, ts) of a stream with admitted; requests later than the watermark are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
        start, count = state.get if state.exists else (None, 0)
        at = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        admitted, start, count = admit_times(at, quota, window_s, start, count)
        state.update((start, count))
        state.setTimeoutTimestamp(max(int((start + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(admitted=admitted)[["key", "event_id", "ts", "admitted"]]

    source = requests.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts")).where("key is not null")
    return source.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(step, OUTPUT, "start double, count long", "append", GroupStateTimeout.EventTimeTimeout)


#: Events of a service that are sent to its state as one row, and those made rows again at once.
PACKED, FOLDED = 1_000, 100_000


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(service, events) of rows of ``job_events``: Spark hands a stateful processor row after row, so events go packed."""
    for batch in batches:
        codes = batch["service"].dictionary_encode().indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = [*(np.flatnonzero(np.diff(codes[order])) + 1), len(codes)] if len(codes) else []
        rest, services, packed = batch.take(pa.array(order)).drop_columns(["service"]), [], []
        for lo, hi in zip([0, *ends], ends):
            for at in range(lo, hi, PACKED):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_batch(rest.slice(at, min(PACKED, hi - at)))
                services.append(batch["service"][order[at]].as_py())
                packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(services, "string"), pa.array(packed, "binary")], names=["service", "events"])


class CappedService(StatefulProcessor):
    """The fold of ``capped_admissions`` for one service: its running jobs, and the windows of its keys."""

    def __init__(self, *limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "jobs string")
        self.windows = handle.getValueState("windows", "keys string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Limiter(*self.limits)
        if self.windows.exists():
            state.windows = {k: tuple(v) for k, v in json.loads(self.windows.get()[0]).items()}
            state.running = json.loads(self.running.get()[0])
        events = pa.concat_tables([pa.ipc.open_stream(packed).read_all() for pdf in rows for packed in pdf["events"]]).combine_chunks()
        ids = events["event_id"]
        order = np.lexsort((pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(), pc.equal(events["kind"], "start").to_numpy(), events["at"].to_numpy()))
        for lo in range(0, len(order), FOLDED):
            part = events.take(order[lo : lo + FOLDED]).to_pandas(integer_object_nulls=True)
            yield state.fold(part.assign(service=key[0], ts=pd.to_datetime(part["at"], unit="us", utc=True)))
        self.running.update((json.dumps(state.running),))
        self.windows.update((json.dumps(state.windows),))

    def close(self) -> None:
        pass


def stream_capped(
    events: DataFrame, quota: int = AUDIT_QUOTA, window_s: float = AUDIT_WINDOW_S, per_key: int = RUNNING_PER_KEY, overall: int = RUNNING_OVERALL, tracked: int = TRACKED_KEYS
) -> DataFrame:
    """``capped_admissions`` over a stream; needs the RocksDB state store.  Batches are taken in the order they come, the
    events of one by their time; a service's jobs and windows outlive batches, and ``tracked`` bounds the windows."""
    processor = CappedService(quota, round(window_s * 1e6), per_key, overall, tracked)
    packed = job_events(events).drop("ts").mapInArrow(pack, "service string, events binary")
    return packed.groupBy("service").transformWithStateInPandas(processor, CAPPED, "Append", "none")
