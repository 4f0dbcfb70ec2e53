"""Caps on jobs in flight and lives of jobs, against plain folds; polls of a stream that runs."""

import datetime
import random

import pandas as pd
import pytest

from webgauge.operators import admission as a
from webgauge.runtime import session_settings
from webgauge.streaming import lifecycle
from webgauge.streaming.admission import stream_capped

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
EVENTS = "service string, key string, job_id string, event_id long, ts timestamp, kind string"


def jobs(seed, n=400, keys=6, services=2):
    rng, out = random.Random(seed), []
    for i in range(n):
        at, service = rng.randrange(4000), f"s{rng.randrange(services)}"
        out.append((service, f"k{rng.randrange(keys)}", f"j{i if rng.random() < 0.95 else 0}", i, T0 + datetime.timedelta(seconds=at), "start"))
        if rng.random() < 0.9:
            out.append((*out[-1][:4], T0 + datetime.timedelta(seconds=at + rng.randrange(0, 300)), "finish"))
    rng.shuffle(out)
    return out


def plain(rows, quota, window_s, per_key, overall, tracked):
    """The rules one by one, with a list of clients in the order they came."""
    out = {}
    for service in {r[0] for r in rows}:
        clients, running = {}, []
        for _, key, job, event, ts, kind in sorted((r for r in rows if r[0] == service), key=lambda r: (r[4], r[5], r[3])):
            if kind == "finish":
                running = [x for x in running if x[0] != job]
                continue
            client = clients.get(key)
            if client is None or ts >= client["reset"]:
                clients[key] = client = {"count": 0, "reset": ts + datetime.timedelta(seconds=window_s)}
            if len(clients) > tracked:
                for k in list(clients):
                    if len(clients) <= tracked * 0.9:
                        break
                    if ts >= clients[k]["reset"] and all(x[1] != k for x in running):
                        del clients[k]
            own = sum(x[1] == key for x in running)
            why = a.BUSY if len(running) >= overall else a.OWN_RUNNING if own >= per_key or any(x[0] == job for x in running) else a.QUOTA if client["count"] >= quota else None
            if why is None:
                client["count"] += 1
                running.append((job, key))
            out[event] = (why is None, why, len(running), len(clients))
    return out


@pytest.mark.parametrize("limits", [(3, 600, 1, 2, 3), (2, 900, 2, 4, 100), (50, 60, 3, 3, 4), (1, 5000, 9, 9, 2)])
def test_capped_admissions_are_those_of_the_rules(spark, limits):
    rows = jobs(sum(limits))
    got = {r.event_id: (r.admitted, r.refusal, r.running, r.tracked) for r in a.capped_admissions(spark.createDataFrame(rows, EVENTS), *limits).collect()}
    assert got == plain(rows, *limits)
    assert {x[1] for x in got.values()} >= {None}


def test_batches_in_which_no_job_starts(spark):
    rows = jobs(11, 30)
    with session_settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2"):
        got = {r.event_id: (r.admitted, r.refusal, r.running, r.tracked) for r in a.capped_admissions(spark.createDataFrame(rows, EVENTS), 3, 600, 1, 2, 3).collect()}
    assert got == plain(rows, 3, 600, 1, 2, 3)


def test_rows_that_name_nothing_are_left_out(spark):
    rows = [(None, "k", "j", 1, T0, "start"), ("s", None, "j", 1, T0, "start"), ("s", "k", "j", 1, None, "start"), ("s", "k", None, 1, T0, "start"), ("s", "k", "j", 1, T0, "other"), ("s", "k", "j", 2, T0, "start")]
    assert [r.event_id for r in a.capped_admissions(spark.createDataFrame(rows, EVENTS)).collect()] == [2]
    assert a.capped_admissions(spark.createDataFrame([], EVENTS)).count() == 0


def run_stream(spark, folder, rows, schema, stream, steps):
    """The rows of all runs; rows come by time in so many runs."""
    rows = sorted(rows, key=lambda r: r[schema.split(", ").index("ts timestamp")])
    with session_settings(spark, spark__sql__streaming__stateStore__providerClass=lifecycle.ROCKSDB):
        size = -(-len(rows) // steps)
        for lo in range(0, len(rows), size):
            spark.createDataFrame(rows[lo : lo + size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            out = stream(spark.readStream.schema(schema).parquet(f"{folder}/in"))
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def test_the_stream_carries_jobs_and_windows_on(spark, tmp_path):
    rows = [r for r in jobs(5, 150)]
    got = run_stream(spark, tmp_path, rows, EVENTS, lambda s: stream_capped(s, 3, 600, 1, 2, 3), 3)
    assert {r.event_id: (r.admitted, r.refusal, r.running, r.tracked) for r in got} == plain(rows, 3, 600, 1, 2, 3)


LIFE = "job_id string, owner string, event_id long, ts timestamp, kind string, crawled long, detail string"


def life(job, *events):
    return [(job, "o", i, T0 + datetime.timedelta(seconds=at), kind, crawled, detail) for i, (at, kind, crawled, detail) in enumerate(events)]


def test_lives_of_jobs(spark, tmp_path):
    """Stale after 300 s, forgotten 900 s after the last news; what comes late changes only what is known."""
    rows = (
        life("a", (0, "created", None, None), (100, "progress", 3, None), (200, "done", None, "r"))
        + life("b", (0, "created", None, None), (290, "progress", 1, None), (900, "progress", 2, None), (1000, "done", None, "late"))
        + life("c", (10, "progress", 1, None), (20, "created", None, None), (30, "error", None, "broke"), (940, "progress", 5, None))
        + life("d", (0, "created", None, None), (5000, "created", None, None))
        + life("tick", (0, "created", None, None), (8000, "created", None, None))
    )
    got = run_stream(spark, tmp_path, rows, LIFE, lambda s: lifecycle.job_changes(s, 300, 900), 3)
    seconds = lambda r: int(pd.Timestamp(r.at).tz_localize(None).timestamp() - T0.timestamp())
    of = lambda job: [(seconds(r), r.change, r.status, r.crawled) for r in sorted(got, key=lambda r: (r.at, r.change)) if r.job_id == job]
    assert of("a") == [(0, "created", "running", 0), (100, "progress", "running", 3), (200, "done", "done", 3), (1100, "expired", "done", 3)]
    assert of("b") == [(0, "created", "running", 0), (290, "progress", "running", 1), (590, "stale", "error", 1), (900, "progress", "error", 2), (1000, "done", "done", 2), (1900, "expired", "done", 2)]
    assert of("c") == [(20, "created", "running", 0), (30, "error", "error", 0), (930, "expired", "error", 0)]
    assert of("d") == [(0, "created", "running", 0), (300, "stale", "error", 0), (1200, "expired", "error", 0), (5000, "created", "running", 0), (5300, "stale", "error", 0), (6200, "expired", "error", 0)]


def test_a_poll_reads_the_state_while_the_stream_runs(spark, tmp_path):
    folder = str(tmp_path)

    def come(rows):
        spark.createDataFrame(rows, LIFE).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def polled():
        asked = spark.createDataFrame([("a",), ("b",), ("nobody",), ("a",)], "job_id string")
        return {r.job_id: (r.found, r.status, r.crawled, r.error, r.result) for r in lifecycle.poll(lifecycle.known_jobs(spark, f"{folder}/state"), asked).collect()}

    come(life("a", (0, "created", None, None), (10, "progress", 4, None)) + life("b", (0, "created", None, None)))
    with session_settings(spark, spark__sql__streaming__stateStore__providerClass=lifecycle.ROCKSDB):
        changes = lifecycle.job_changes(spark.readStream.schema(LIFE).parquet(f"{folder}/in"))
        q = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
        try:
            q.processAllAvailable()
            gone = (False, None, None, lifecycle.NOT_FOUND, None)
            assert polled() == {"a": (True, "running", 4, None, None), "b": (True, "running", 0, None, None), "nobody": gone}
            come(life("a", (20, "done", None, "report")) + life("b", (30, "error", None, "broke")))
            q.processAllAvailable()
            assert q.isActive and polled() == {"a": (True, "done", 4, None, "report"), "b": (True, "error", 0, "broke", None), "nobody": gone}
        finally:
            q.stop()


def test_settings_are_put_back(spark):
    with session_settings(spark, spark__sql__shuffle__partitions="3", spark__webgauge__none="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.webgauge.none", None) is None
