"""What streams of many keys cost: jobs in buckets, events of a service packed, and cuts of a replay in bins."""

import datetime
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webgauge.operators import admission
from webgauge.queries import streams
from webgauge.runtime import session_settings
from webgauge.streaming import admission as streamed
from webgauge.streaming import lifecycle

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
LIFE = "job_id string, owner string, event_id long, ts timestamp, kind string, crawled long, detail string"
EVENTS = "service string, key string, job_id string, event_id long, ts timestamp, kind string"


def run(spark, folder, runs, schema, stream):
    """(rows of all runs, progress of all batches)."""
    progress = []
    with session_settings(spark, spark__sql__streaming__stateStore__providerClass=lifecycle.ROCKSDB):
        for rows in runs:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            out = stream(spark.readStream.schema(schema).parquet(f"{folder}/in"))
            query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            progress += query.recentProgress
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), progress


def test_jobs_share_a_bucket_and_its_timer(spark, tmp_path):
    jobs = [f"j{i}" for i in range(60)]
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    created = [(j, f"o{i % 3}", i, at(i), "created", None, None) for i, j in enumerate(jobs)]
    ended = [(j, "o", 100 + i, at(200 + i), "done", None, f"r{i}") for i, j in enumerate(jobs) if i % 2]
    late = [("late", "o", 999, at(1130), "created", None, None)]
    changes, progress = run(spark, tmp_path, [created, ended, late], LIFE, lambda s: lifecycle.job_changes(s, 300, 900))
    timers = [x.customMetrics["numRegisteredTimers"] for p in progress for x in p.stateOperators]
    assert sum(timers) > 0
    got = {(r.job_id, r.owner, r.s, r.change, r.status) for r in changes.withColumn("s", F.unix_millis("at") - int(T0.timestamp() * 1000)).collect()}
    expected = {("late", "o", 1130_000, "created", "running")}
    for i, j in enumerate(jobs):
        owner = f"o{i % 3}"
        expected.add((j, owner, i * 1000, "created", "running"))
        if i % 2:
            expected.add((j, owner, (200 + i) * 1000, "done", "done"))
            expected |= {(j, owner, (200 + i) * 1000 + 900_001, "expired", "done")} if (200 + i) * 1000 + 900_001 <= 1130_000 else set()
        else:
            expected.add((j, owner, i * 1000 + 300_001, "stale", "error"))
    assert got == expected
    left = {r.job_id: r.status for r in lifecycle.known_jobs(spark, f"{tmp_path}/state").collect()}
    assert left == {"late": "running"} | {j: "done" if i % 2 else "error" for i, j in enumerate(jobs) if not (i % 2 and i < 30)}

    # calls into Python and timers go with the buckets, not with the jobs
    _, progress = run(spark, tmp_path / "few", [created], LIFE, lambda s: lifecycle.job_changes(s, 300, 900, buckets=2))
    assert 1 <= max(x.customMetrics["numRegisteredTimers"] for p in progress for x in p.stateOperators) <= 2


@pytest.mark.parametrize("bins", [2, 16, 2**14])
def test_cuts_are_percentiles_found_without_gathering_times(spark, monkeypatch, bins):
    monkeypatch.setattr(streams, "BINS", bins)
    rng = random.Random(bins)
    for times in ([7], [-5, -5, -5], [rng.randrange(-(10**13), 10**13) for _ in range(300)], [rng.choice([-3, 0, 4, 10**15]) for _ in range(200)] + list(range(90))):
        events = spark.createDataFrame([(t,) for t in times], "ts_us long")
        exact = events.agg(F.percentile("ts_us", F.array(F.lit(0.4), F.lit(0.7)))).first()[0]
        cuts = streams.times_at(events, (0.4, 0.7))
        assert cuts == [sorted(times)[math.floor(p * (len(times) - 1))] for p in (0.4, 0.7)]
        assert [sum(t <= c for t in times) for c in cuts] == [sum(t <= c for t in times) for c in exact]
    assert streams.times_at(spark.createDataFrame([], "ts_us long"), (0.4, 0.7)) == [0, 0]


def test_times_are_read_as_utc_in_any_zone(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.000001' AS ts, 1L AS user_id UNION ALL SELECT TIMESTAMP_NTZ'2024-11-03 01:30:00', 2L").write.parquet(f"{tmp_path}/events.parquet")
    with session_settings(spark, spark__sql__session__timeZone="America/New_York"):
        got = {r.user_id: r.us for r in streams.timed_events(spark, str(tmp_path)).select("user_id", F.unix_micros("ts").alias("us")).collect()}
    assert got == {1: 1710037800000001, 2: 1730597400000000}


def test_events_of_a_service_go_packed(spark, tmp_path):
    n = 2 * streamed.PACKED + 1
    batch = pa.RecordBatch.from_pydict({"service": ["a", "b"] * n, "at": list(range(2 * n))})
    (out,) = streamed.pack([batch])
    assert out["service"].to_pylist() == ["a"] * 3 + ["b"] * 3
    back = [pa.ipc.open_stream(x).read_all()["at"].to_pylist() for x in out["events"].to_pylist()]
    assert [t for x in back[:3] for t in x] == list(range(0, 2 * n, 2)) and [t for x in back[3:] for t in x] == list(range(1, 2 * n, 2))
    assert [x.num_rows for x in streamed.pack([batch.slice(0, 0)])] == [0]

    rng, rows = np.random.default_rng(3), []
    for i, (at, long) in enumerate(zip(rng.integers(0, 40_000, 4_000).tolist(), rng.integers(0, 90, 4_000).tolist())):
        rows += [(f"s{i % 2}", f"k{i % 5}", f"j{i}", i, T0 + datetime.timedelta(seconds=at + late), kind) for kind, late in (("start", 0), ("finish", long))]
    limits, cut = (30, 3600, 1, 2, 4), T0 + datetime.timedelta(seconds=20_000)
    got, _ = run(spark, tmp_path, [[r for r in rows if r[4] <= cut], [r for r in rows if r[4] > cut]], EVENTS, lambda s: streamed.stream_capped(s, *limits))
    whole = admission.capped_admissions(spark.createDataFrame(rows, EVENTS), *limits)
    assert got.columns == whole.columns and sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
