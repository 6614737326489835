"""Leases of builds as a stream: each event of a build renews its lease, and a timer tells when one has run out.

The state of a build is when its lease began and whether that has run out; the timers run on event time, so what is told
follows from the events and the watermark alone, not from when the stream runs. A stream that starts again goes on from
its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TOLD = "build_id long, kind string, at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: The bucket of events without a build, which count as those of one.
NO_BUILD = -1


class Leases(StatefulProcessor):
    """Events of the builds of a bucket in the order of their time: expired, when a build's lease ran out with no event;
    reclaimed, when an event came after that. An event that ends the build ends the lease.

    A bucket's builds are gone through together as arrays, with one state and one timer, that of the lease which ends first.
    """

    def __init__(self, lease_micros: int):
        self.lease = lease_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "builds binary, since binary, expired binary, timer long")

    def _get(self) -> tuple:
        held = self.held.get() or (b"", b"", b"", None)
        return (*[np.frombuffer(x, t) for x, t in zip(held, ("<i8", "<i8", "?"))], held[3])

    def _put(self, builds, since, expired, timer: int | None) -> None:
        ends = self._ends(since[~expired])
        first = int(ends.min()) if len(ends) else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if len(builds):
            self.held.update((builds.tobytes(), since.tobytes(), expired.tobytes(), first))
        else:
            self.held.clear()

    def _ends(self, since):
        return -(-(since + self.lease) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        builds, since, expired, timer = self._get()
        events = pd.concat(list(rows))
        # what is held goes first, then each build's events in order
        new = np.repeat([False, True], [len(builds), len(events)])
        build = np.concatenate([builds, events["build_id"].to_numpy("int64")])
        at = np.concatenate([since, events["micros"].to_numpy("int64")])
        done = np.concatenate([np.zeros(len(builds), bool), events["done"].to_numpy(bool)])
        out = np.concatenate([expired, np.zeros(len(events), bool)])
        order = np.lexsort((done, at, new, build))
        new, build, at, done, out = new[order], build[order], at[order], done[order], out[order]
        same = build[1:] == build[:-1]
        leased = same & ~done[:-1]
        ran_out = leased & ~out[:-1] & (at[:-1] + self.lease < at[1:])
        again = leased & (ran_out | out[:-1])
        last = np.append(~same, True)[: len(build)] & ~done
        self._put(build[last], at[last], out[last], timer)
        if again.any():
            yield _told(key, build[:-1][ran_out], "expired", at[:-1][ran_out] + self.lease)
            yield _told(key, build[1:][again], "reclaimed", at[1:][again])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        builds, since, expired, timer = self._get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(fired + 1, timerValues.getCurrentWatermarkInMs())
        over = ~expired & (self._ends(since) < passed)
        self._put(builds, since, expired | over, None if timer == fired else timer)  # one that has fired is gone
        if over.any():
            yield _told(key, builds[over], "expired", since[over] + self.lease)

    def close(self) -> None:
        pass


def _told(key, builds, kind: str, micros) -> pd.DataFrame:
    named = pd.array([None] * len(builds) if key[0] == NO_BUILD else builds, dtype="Int64")
    return pd.DataFrame({"build_id": named, "kind": kind, "at": pd.to_datetime(micros, unit="us")})


def lease_events(stream: DataFrame, build: str, ts: str, done, lease_seconds: int, delay: str, buckets: int = 256) -> DataFrame:
    """build_id, kind (expired or reclaimed) and at of a stream of events; done tells those that end their build.

    Events that are behind the newest by more than delay, or without a time, are dropped, and a lease has run out when the watermark passes its
    end. Builds are dealt to buckets by their hash, so the calls of a micro-batch are as many as buckets, not as builds; a
    task holds the events that one micro-batch has for a bucket, and a stream keeps its number of buckets. The state store
    is RocksDB's, which timers need: its setting holds for streams that are started with it, see with_timers().
    """
    at, own = F.col(ts).cast("timestamp"), F.col(build).cast("long")
    bucket = F.when(own.isNull(), NO_BUILD).otherwise(F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int"))
    over = F.coalesce(done, F.lit(False))
    rows = stream.where(at.isNotNull()).select(bucket.alias("bucket"), F.coalesce(own, F.lit(0)).alias("build_id"), at.alias("at"), F.unix_micros(at).alias("micros"), over.alias("done")).withWatermark("at", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(Leases(lease_seconds * 1_000_000), TOLD, "Append", "EventTime")


def with_timers(spark, run):
    """run(), with the state store that timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
