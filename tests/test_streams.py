"""Replays in micro-batches: order, late rows, bounded state, leases, and what a restart or a repeated batch does."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import jobs, leases

T0 = dt.datetime(2024, 1, 1)
EVENTS = "build long, ts timestamp_ntz, done boolean, arrival int"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def places(tmp_path, *names):
    return [f"file://{tmp_path}/{n}" for n in names]


def replay(spark, rows, schema, label="replay"):
    return jobs.file_stream(spark, jobs.staged(spark.createDataFrame(rows, schema), F.col("arrival"), label), 1)


def lease_rows(spark, stream, path, state):
    told = leases.lease_events(stream, "build", "ts", F.col("done"), 3600, "0 seconds")
    out = leases.with_timers(spark, lambda: jobs.run_available(told, "leases", path, state))
    return sorted((r["build_id"], r["kind"], (r["at"] - T0).total_seconds() / 3600) for r in out.collect())


def test_leases(spark, tmp_path):
    rows = [
        (1, at(0), False, 0), (1, at(0.5), False, 0), (1, at(1.4), False, 1),  # renewed in time, runs out at the end
        (2, at(0), False, 0), (2, at(3), False, 2),  # runs out between batches, goes on
        (3, at(3.2), False, 2), (3, at(5), False, 2),  # both in one batch
        (4, at(0), False, 0), (4, at(0.9), True, 1),  # ends
        (5, at(0), False, 0), (5, at(1), False, 0), (5, at(2), False, 1),  # just in time
        (6, at(5), False, 2), (7, at(4.5), True, 2), (9, at(5.2), False, 2),
    ]
    want = [(1, "expired", 2.4), (2, "expired", 1.0), (2, "expired", 4.0), (2, "reclaimed", 3.0), (3, "expired", 4.2), (3, "reclaimed", 5.0), (5, "expired", 3.0)]
    assert lease_rows(spark, replay(spark, rows, EVENTS), *places(tmp_path, "out", "state")) == sorted(want)


def test_leases_go_on_from_the_checkpoint(spark, tmp_path):
    """The same rows, whether the stream runs once, or stops and starts again after each file, or a batch runs twice."""
    rows = [(b, at(10 * k + b % 7 + more), b % 5 == 4, k) for b in range(40) for k in range(4) if (b + k) % 3 for more in (0, 0.4)]
    whole = jobs.staged(spark.createDataFrame(rows, EVENTS), F.col("arrival"), "whole").removeprefix("file://")
    want = lease_rows(spark, jobs.file_stream(spark, f"file://{whole}", 1), *places(tmp_path, "a", "a-state"))
    assert len(want) > 40
    folder = tmp_path / "grows"
    folder.mkdir()
    out, state = places(tmp_path, "b", "b-state")
    for k in range(4):
        os.rename(f"{whole}/_batch={k}", folder / f"_batch={k}")
        got = lease_rows(spark, jobs.file_stream(spark, f"file://{folder}", 1), out, state)
        last = max(int(f) for f in os.listdir(tmp_path / "b-state/commits") if f.isdigit())
        for f in (f"{last}", f".{last}.crc"):  # the last batch wasn't committed: it runs again
            os.unlink(tmp_path / "b-state/commits" / f)
    assert got == want


def test_many_builds_are_gone_through_by_buckets(spark, tmp_path):
    """The same as event by event, events without a build or a time among them; calls and states are as many as buckets."""
    rows = [(b if b else None, at(k * 2 + b % 5 * 0.3 + more), (b + k) % 7 == 0, k) for b in range(3000) for k in range(3) if (b * 7 + k) % 4 for more in (0, 0.5)]
    stream = replay(spark, rows + [(5, None, False, 1)], EVENTS)
    want, end = [], max(r[1] for r in rows)
    for b in range(3000):
        own = sorted((r[1], r[2]) for r in rows if r[0] == (b or None)) if b < 40 else []
        for (t, done), (after, _) in zip(own, own[1:] + [(None, None)]):
            over = t + dt.timedelta(hours=1)
            if not done and (over < after if after else over < end):
                want.append((b, "expired", over))
                want += [(b, "reclaimed", after)] if after else []
    out, state = places(tmp_path, "out", "state")
    told = leases.lease_events(stream, "build", "ts", F.col("done"), 3600, "0 seconds")
    q = leases.with_timers(spark, lambda: told.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out))
    q.awaitTermination()
    got = [(r[0] or 0, r[1], r[2]) for r in spark.read.schema(leases.TOLD).parquet(out).collect() if (r[0] or 0) < 40]
    assert sorted(got) == sorted(want) and len(want) > 40
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 4 * 257


def test_file_order_and_its_bound(spark, tmp_path):
    (path,) = places(tmp_path, "files")
    for name, hours in (("b", (0, 4)), ("a", (3, 9)), ("c", (7, 8))):
        spark.createDataFrame([(at(h), 1) for h in hours], "ts timestamp_ntz, x int").coalesce(1).write.parquet(f"{path}/f={name}")
    rows = jobs.file_order(spark.read.parquet(path), "ts").orderBy("least").collect()
    assert [r["path"].split("/f=")[1][0] for r in rows] == ["b", "a", "c"]
    assert [r["late"] for r in rows] == [dt.timedelta(0), dt.timedelta(hours=1), dt.timedelta(hours=2)]


def test_late_rows(spark, tmp_path):
    rows = [(1, at(0), False, 0), (2, at(10), False, 0), (3, at(8), False, 1), (4, at(9.5), False, 1), (5, at(20), False, 1), (6, at(18.9), False, 2), (7, at(19), False, 2), (8, at(0), False, 2)]
    target, state = places(tmp_path, "late", "state")
    stream = replay(spark, rows, EVENTS)
    for _ in range(2):  # the second time finds the last batch uncommitted, and writes it anew
        late = jobs.late_rows(stream, "ts", "1 hour", target, state)
        assert sorted(r["build"] for r in late.collect()) == [3, 6, 8]
        for f in ("2", ".2.crc"):
            os.unlink(tmp_path / "state/commits" / f)


def test_bounded_ingest(spark, tmp_path):
    rows = [(k * 10 + i, at(k * 10 + i), False, k) for k in range(30) for i in range(10)]
    rows += [(k * 10 + i, at(k * 10 + i), False, k + 1) for k in range(29) for i in (5, 9)]  # delivered again with the next batch
    rows += [(3, at(3), False, 20), (3, at(3), False, 0)]  # long after, and in one batch
    target, state = places(tmp_path, "target", "state")
    stream = replay(spark, rows, EVENTS)
    told = jobs.ingest_bounded(stream, ["build"], "ts", "12 hours", target, state)
    ids = lambda: sorted(r["build"] for r in spark.read.parquet(f"{target}/batch=*").collect())
    assert ids() == list(range(300)) and len(told) >= 30
    assert max(t["state_rows"] for t in told) <= 45  # of 300 keys
    last = max(int(f) for f in os.listdir(tmp_path / "state/commits") if f.isdigit())
    data = max(int(f.split("=")[1]) for f in os.listdir(tmp_path / "target"))
    for n in range(last, data - 1, -1):
        for f in (f"{n}", f".{n}.crc"):
            if (tmp_path / "state/commits" / f).exists():
                os.unlink(tmp_path / "state/commits" / f)
    jobs.ingest_bounded(stream, ["build"], "ts", "12 hours", target, state)
    assert ids() == list(range(300))


@pytest.mark.parametrize("name", ["events.parquet", "events.parquet_old"])
def test_a_file_and_its_neighbours(spark, tmp_path, name):
    """A stream over one file, or folder, doesn't take others whose names begin alike."""
    for k, n in enumerate(("events.parquet", "events.parquet_old", "events.parquet2")):
        spark.range(k * 10, k * 10 + 3).coalesce(1).write.parquet(f"file://{tmp_path}/{n}-folder")
        (part,) = [f for f in os.listdir(tmp_path / f"{n}-folder") if f.endswith(".parquet")]
        os.rename(tmp_path / f"{n}-folder" / part, tmp_path / n)
    got = jobs.run_available(jobs.file_stream(spark, f"file://{tmp_path}/{name}"), "one")
    first = 0 if name == "events.parquet" else 10
    assert sorted(r["id"] for r in got.collect()) == [first, first + 1, first + 2]
