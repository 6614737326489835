"""Rollups over event logs: windows back from a moment, rates, builds, capacity and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import columns as C
from tidewell.operators import relational as R

WINDOWS = (60, 300, 3600)


def seconds_before(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000


def trailing_stats(accesses: DataFrame, windows=WINDOWS) -> DataFrame:
    """Hits, misses, hit rate and bytes of the last seconds before the newest event, a row per window; bounds count.

    One pass: conditional aggregates over the rows within the longest window, then one row is unfolded.
    """
    now = accesses.agg(F.max("ts").alias("now"))
    age = seconds_before(F.col("ts"), F.col("now"))
    recent = accesses.crossJoin(now).withColumn("age", age).where(F.col("age") <= max(windows))
    hit = F.col("is_hit")
    parts = []
    for w in windows:
        own = F.col("age") <= w
        parts += [F.count_if(own & hit).alias(f"h{w}"), F.count_if(own & ~hit).alias(f"m{w}"), F.coalesce(F.sum(F.when(own & hit, F.col("bytes"))), F.lit(0)).alias(f"c{w}"), F.coalesce(F.sum(F.when(own & ~hit, F.col("bytes"))), F.lit(0)).alias(f"s{w}")]
    rows = F.array(*[F.struct(F.lit(w).alias("window_seconds"), F.col(f"h{w}").alias("hits"), F.col(f"m{w}").alias("misses"), F.col(f"c{w}").alias("bytes_from_cache"), F.col(f"s{w}").alias("bytes_from_storage")) for w in windows])
    out = recent.agg(*parts).select(F.inline(rows))
    return out.withColumn("hit_rate", C.safe_ratio(F.col("hits"), F.col("hits") + F.col("misses"), 4))


def hit_rates(accesses: DataFrame, by: str, n: int | None) -> DataFrame:
    """Hits, misses, total and rate per group, most accesses first."""
    out = accesses.groupBy(by).agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"), F.count("*").alias("total"))
    out = out.withColumn("hit_rate", C.safe_ratio(F.col("hits"), F.col("total"), 4))
    return out.orderBy(F.desc("total"), by).limit(n) if n else out


def scan_rollup(accesses: DataFrame, by: str, last: int = 1000) -> DataFrame:
    """Totals per table over all scans, and percentiles over the last ones."""
    totals = accesses.groupBy(by).agg(F.count("*").alias("scans"), F.round(F.avg("value"), 4).alias("avg_latency"), C.safe_ratio(F.count_if("is_hit"), F.count("*"), 3).alias("hit_rate"), F.sum("bytes").alias("bytes"))
    recent = R.top_per_group(accesses, [by], [F.desc("ts"), F.desc("event_id")], last)
    return totals.join(R.nearest_rank_of_few(recent, [by], "value"), by)


def eviction_pressure(evictions: DataFrame) -> DataFrame:
    """Counts and bytes of the last minute and hour before the newest event of all, the rate and its level."""
    now = evictions.agg(F.max("ts").alias("now"))
    age = seconds_before(F.col("ts"), F.col("now"))
    e = evictions.where("NOT is_hit").crossJoin(now).withColumn("age", age)
    minute, hour = F.col("age") <= 60, F.col("age") <= 3600
    out = e.agg(F.count("*").alias("total"), F.count_if(minute).alias("last_minute"), F.count_if(hour).alias("last_hour"), F.coalesce(F.sum(F.when(hour, F.col("bytes"))), F.lit(0)).alias("bytes_last_hour"), F.max("ts").alias("last_ts"))
    rate = F.col("last_hour") / 60.0
    return out.withColumn("rate", F.round(rate.cast("double"), 4)).withColumn("level", F.when(rate >= 10, "critical").when(rate >= 5, "high").when(rate >= 1, "medium").otherwise("low"))


def slow_stages(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Events (stage, ms) above their stage's threshold; the thresholds are a few rows that the planner sends along."""
    return events.join(thresholds, "stage").where(F.col("ms") > F.col("threshold"))


def build_rollup(builds: DataFrame) -> DataFrame:
    """One row over all builds; durations average over finished ones, waits over all."""
    e = lambda s: F.count_if(F.col("event") == s)
    ended = F.col("event").isin("succeeded", "failed")
    return builds.agg(
        F.count("*").alias("started"), e("succeeded").alias("succeeded"), e("failed").alias("failed"), e("cancelled").alias("cancelled"),
        (F.count("*") - e("succeeded") - e("failed") - e("cancelled")).alias("in_flight"),
        C.safe_ratio(F.sum(F.when(ended, F.col("duration_ms"))), F.count_if(ended), 2).alias("avg_duration_ms"), F.round(F.avg("queue_wait_ms"), 2).alias("avg_queue_wait_ms"), F.sum(F.when(F.col("event") == "succeeded", F.col("bytes_out"))).alias("bytes_out"),
    )


def build_rollup_by(builds: DataFrame, by: str, last: int = 100) -> DataFrame:
    """Counts per group, and floor-rank percentiles of the last durations of finished builds."""
    e = lambda s: F.count_if(F.col("event") == s).alias(s)
    totals = builds.groupBy(by).agg(F.count("*").alias("started"), e("succeeded"), e("failed"), e("cancelled"))
    ended = builds.where(F.col("event").isin("succeeded", "failed")).select(by, "duration_ms", "created_at", "build_id")
    recent = R.top_per_group(ended, [by], [F.desc("created_at"), F.desc("build_id")], last)
    ranks = R.floor_rank_of_few(recent, [by], "duration_ms").withColumnRenamed(by, "_k")
    return totals.join(ranks, F.col(by).eqNullSafe(F.col("_k")), "left").drop("_k")


def build_class(explicit: Column, estimated: Column, inputs: Column, max_bytes: int, max_inputs: int) -> Column:
    """The explicit class, else bulk for large outputs or many inputs, else interactive."""
    return F.when(explicit.isNotNull(), explicit).when(estimated > max_bytes, "bulk").when(inputs > max_inputs, "bulk").otherwise("interactive")


def accept_within_quota(builds: DataFrame, limit: int) -> DataFrame:
    """build_id, accepted: per tenant and day, in order of time, builds whose bytes fit what is left; only accepted ones use it.

    The rule is sequential within a tenant's day. Rows are dealt by tenant and day, sorted, and read as a stream: a
    task holds a batch of them and one running sum, however long a day is.
    """
    import pandas as pd

    def run(frames):
        at, used = None, 0
        for f in frames:
            out = []
            for tenant, day, size in zip(f["tenant"], f["day"], f["bytes_out"]):
                if (tenant, day) != at:
                    at, used = (tenant, day), 0
                ok = used + size <= limit
                used += size if ok else 0
                out.append(ok)
            yield pd.DataFrame({"build_id": f["build_id"], "accepted": out})

    own = builds.select("build_id", "created_at", "bytes_out", F.coalesce("tenant", F.lit("")).alias("tenant"), F.to_date("created_at").cast("string").alias("day"))
    dealt = own.repartition("tenant", "day").sortWithinPartitions("tenant", "day", "created_at", "build_id")
    return dealt.mapInPandas(run, "build_id long, accepted boolean")


def size_orders(signals: DataFrame, cap: float, exposure: float, budget: int, least: float) -> DataFrame:
    """Greedy sizing per portfolio in order of seq (portfolio, seq, ticker, strength, price, held): portfolio, seq, side, qty.

    Each order takes |strength| * cap, clamped by what is left of the exposure. Read as a stream of sorted rows, like
    the quota above.
    """
    import math

    import pandas as pd

    def run(frames):
        at, left, n = None, 0.0, 0
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.portfolio != at:
                    at, left, n = r.portfolio, exposure, 0
                if n >= budget or left <= 0 or r.held or not r.price or r.price <= 0 or abs(r.strength) < least:
                    continue
                qty = math.floor(min(abs(r.strength) * cap, left) / r.price)
                if qty <= 0:
                    continue
                out.append((r.portfolio, r.seq, "buy" if r.strength > 0 else "sell", qty))
                left, n = left - qty * r.price, n + 1
            if out:
                yield pd.DataFrame(out, columns=["portfolio", "seq", "side", "qty"])

    # signals of one seq stand in the order of their other columns
    dealt = signals.repartition("portfolio").sortWithinPartitions("portfolio", "seq", "ticker", "strength", "price", "held")
    return dealt.mapInPandas(run, "portfolio long, seq long, side string, qty long")


def capacity(levels: DataFrame) -> DataFrame:
    """One row over load levels (idx, users, goodput, limited, errors, p95): peak, limits, recommended level.

    Levels are few; the windows run over them alone.
    """
    base = F.first("p95").over(W.orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    v = levels.withColumn("base", base)
    first = lambda cond: F.min(F.when(cond, F.col("idx")))
    s = v.agg(
        F.max_by(F.struct("users", "goodput"), F.struct("goodput", -F.col("idx"))).alias("peak"), first(F.col("limited") > 0.05).alias("saturation"),
        first((F.col("base") > 0) & (F.col("p95") > 2 * F.col("base"))).alias("knee"), first(F.col("errors") > 0.01).alias("error_level"), F.max("idx").alias("last"),
    )
    limit = F.least("saturation", "knee", "error_level")
    s = s.withColumn("safe", F.when(limit.isNull(), F.col("last")).otherwise(F.greatest(F.lit(0), limit - 1)))
    pick = levels.select(F.col("idx").alias("safe"), F.col("users").alias("recommended_users"))
    return s.join(pick, "safe").select(F.col("peak.users").alias("peak_users"), F.col("peak.goodput").alias("peak_goodput"), "saturation", "knee", "error_level", "recommended_users")
