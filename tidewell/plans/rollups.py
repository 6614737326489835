"""Event rollups, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import columns as C
from tidewell.operators import registry as REG
from tidewell.operators import relational as R
from tidewell.operators import rollups as O
from tidewell.plans import fixtures as X
from tidewell.plans.base import query
from tidewell.session import new_path, table
from tidewell.streaming import jobs, leases

A, B, V = "WITH " + X.ACCESSES, "WITH " + X.BUILDS, "WITH " + X.VERSIONS


@query("w1_trailing_windows", A + ", now AS (SELECT max(ts) AS n FROM accesses) SELECT w AS window_seconds, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses, CAST(coalesce(sum(bytes) FILTER (is_hit), 0) AS BIGINT) AS bytes_from_cache, CAST(coalesce(sum(bytes) FILTER (NOT is_hit), 0) AS BIGINT) AS bytes_from_storage, round(count(*) FILTER (is_hit) / count(*), 4) AS hit_rate FROM accesses, now, (SELECT unnest([60, 300, 3600]) AS w) WHERE ts >= n - to_seconds(w) GROUP BY w")
def w1(spark, d):
    return O.trailing_stats(X.accesses(spark, d))


@query("w2_stream_windows", A + " SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses, CAST(sum(bytes) AS BIGINT) AS bytes FROM accesses GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM accesses)")
def w2(spark, d):
    events = jobs.file_stream(spark, f"{d}/events.parquet", None)
    stream = events.select("ts", (F.col("event_type") != "error").alias("is_hit"), F.floor(F.col("value") * 1000).alias("bytes"))
    return jobs.run_available(jobs.windowed_access(stream, "1 hour", None, "10 minutes"), "windows")


#: Events as they arrive: every 89th one is three days late. A batch is five days of arrival.
_ARRIVED = A + """, r AS (SELECT *, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts + CASE WHEN event_id % 89 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS DATE)) / 5) AS BIGINT) AS batch FROM accesses),
 b AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS closed FROM r GROUP BY batch)"""


def arriving(spark, d):
    """The accesses as a stream of micro-batches in the order of arrival."""
    late = F.when(F.col("event_id") % 89 == 0, F.col("ts") + F.make_dt_interval(F.lit(3))).otherwise(F.col("ts"))
    path = jobs.staged(X.accesses(spark, d), F.floor(F.date_diff(late, F.lit("1970-01-01").cast("date")) / 5), "accesses")
    return jobs.file_stream(spark, path, 1)


@query("w2_sliding_windows", _ARRIVED + """, w AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM r JOIN b USING (batch)), s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, * FROM w)
 SELECT start, start + INTERVAL 24 HOUR AS stop, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses, CAST(sum(bytes) AS BIGINT) AS bytes FROM s
 WHERE (closed IS NULL OR start + INTERVAL 24 HOUR > closed) AND start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM accesses) GROUP BY 1""")
def w2b(spark, d):
    """Windows of a day every six hours, over a replay in micro-batches. A row is left out of a window that was closed when it
    came: by the watermark of the batch before its own, which is the newest time of all batches before that one less a day."""
    return jobs.run_available(jobs.windowed_access(arriving(spark, d), "24 hours", "6 hours", "1 day"), "windows")


@query("w2_late_rows", _ARRIVED + " SELECT table_id, count(*) AS late, CAST(sum(bytes) AS BIGINT) AS bytes, min(event_id) AS first_event FROM r JOIN b USING (batch) WHERE ts < mark GROUP BY table_id")
def w2c(spark, d):
    """The side output of the same replay: the rows that came behind the watermark, by table."""
    late = jobs.late_rows(arriving(spark, d), "ts", "1 day", new_path(spark, "late"), new_path(spark, "late-state"))
    return late.groupBy("table_id").agg(F.count("*").alias("late"), F.sum("bytes").alias("bytes"), F.min("event_id").alias("first_event"))


@query("w3_table_hit_rates", A + " SELECT table_id, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses, count(*) AS total, round(count(*) FILTER (is_hit) / count(*), 4) AS hit_rate FROM accesses GROUP BY table_id ORDER BY total DESC, table_id LIMIT 10")
def w3(spark, d):
    return O.hit_rates(X.accesses(spark, d), "table_id", 10)


@query("w4_scan_rollup", A + ", r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ts DESC, event_id DESC) AS k FROM accesses) SELECT table_id, count(*) AS scans, round(avg(value), 4) AS avg_latency, round(count(*) FILTER (is_hit) / count(*), 3) AS hit_rate, CAST(sum(bytes) AS BIGINT) AS bytes, round(quantile_disc(value, 0.5) FILTER (k <= 1000), 2) AS p50, round(quantile_disc(value, 0.95) FILTER (k <= 1000), 2) AS p95, round(quantile_disc(value, 0.99) FILTER (k <= 1000), 2) AS p99 FROM r GROUP BY table_id")
def w4(spark, d):
    return O.scan_rollup(X.accesses(spark, d), "table_id")


@query("w5_counters", A + " SELECT count(*) AS scans, count(*) FILTER (is_hit) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT table_id) AS tables, round(avg(value), 4) AS avg_latency FROM accesses")
def w5(spark, d):
    return X.accesses(spark, d).agg(F.count("*").alias("scans"), F.count_if("is_hit").alias("hits"), F.sum("bytes").alias("bytes"), F.count_distinct("table_id").alias("tables"), F.round(F.avg("value"), 4).alias("avg_latency"))


@query("w6_idempotent_ingest", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids FROM events")
def w6(spark, d):
    target = new_path(spark, "ingested")
    for _ in range(2):  # the same files are delivered twice
        jobs.ingest_once(jobs.file_stream(spark, f"{d}/events.parquet").select("event_id", "ts", "user_id"), ["event_id"], target, F.to_date("ts"))
    return spark.read.parquet(target).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"))


@query("w6_bounded_ingest", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, true AS bounded FROM events")
def w6b(spark, d):
    """Events in micro-batches of three days, each of which delivers the last day of the one before again: every event is
    ingested once, and no batch remembers more than the rows of some days. bounded: whether that held (at most two batches'
    rows and the state of the batch before)."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    day = F.date_diff("ts", F.lit("1970-01-01").cast("date"))
    batch = F.floor(day / 3)
    twice = e.select("*", F.explode(F.array_distinct(F.array(batch, F.floor((day + 1) / 3)))).alias("delivery"))
    stream = jobs.file_stream(spark, jobs.staged(twice, F.col("delivery"), "deliveries"), 1)
    target = new_path(spark, "ingested")
    told = jobs.ingest_bounded(stream.select("event_id", "ts", "user_id"), ["event_id"], "ts", "2 days", target, new_path(spark, "ingest-state"))
    largest = max((p["read"] for p in told), default=0)
    bounded = all(p["state_rows"] <= 3 * largest for p in told)
    return spark.read.parquet(f"{target}/batch=*").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids")).withColumn("bounded", F.lit(bounded))


@query("w7_eviction_pressure", A + ", x AS (SELECT epoch(max(ts) OVER ()) - epoch(ts) AS age, * FROM accesses), s AS (SELECT count(*) AS total, count(*) FILTER (age <= 60) AS last_minute, count(*) FILTER (age <= 3600) AS last_hour, CAST(coalesce(sum(bytes) FILTER (age <= 3600), 0) AS BIGINT) AS bytes_last_hour, max(ts) AS last_ts FROM x WHERE NOT is_hit) SELECT *, round(last_hour / 60.0, 4) AS rate, CASE WHEN last_hour / 60.0 >= 10 THEN 'critical' WHEN last_hour / 60.0 >= 5 THEN 'high' WHEN last_hour / 60.0 >= 1 THEN 'medium' ELSE 'low' END AS level FROM s")
def w7(spark, d):
    return O.eviction_pressure(X.accesses(spark, d))


@query("w8_slow_stages", "SELECT event_id, event_type AS stage, value * 10 AS ms FROM events WHERE value * 10 > CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 250 WHEN 'purchase' THEN 500 END")
def w8(spark, d):
    thresholds = spark.createDataFrame([("click", 100.0), ("view", 250.0), ("purchase", 500.0)], "stage string, threshold double")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("stage"), (F.col("value") * 10).alias("ms"))
    return O.slow_stages(e, thresholds).select("event_id", "stage", "ms")


@query("w9_build_rollup", B + " SELECT count(*) AS started, count(*) FILTER (event = 'succeeded') AS succeeded, count(*) FILTER (event = 'failed') AS failed, count(*) FILTER (event = 'cancelled') AS cancelled, CAST(0 AS BIGINT) AS in_flight, round(avg(duration_ms) FILTER (event IN ('succeeded', 'failed')), 2) AS avg_duration_ms, round(avg(queue_wait_ms), 2) AS avg_queue_wait_ms, CAST(sum(bytes_out) FILTER (event = 'succeeded') AS BIGINT) AS bytes_out FROM reg_builds")
def w9(spark, d):
    return O.build_rollup(X.builds(spark, d))


_RANKS = ", ".join(f"v[greatest(1, CAST(floor(len(v) * {p}::DOUBLE) AS BIGINT))] AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def _by(key: str) -> str:
    return B + f", r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY created_at DESC, build_id DESC) AS k FROM reg_builds WHERE event IN ('succeeded', 'failed')), q AS (SELECT {key}, list_sort(list(duration_ms)) AS v FROM r WHERE k <= 100 GROUP BY {key}), t AS (SELECT {key}, count(*) AS started, count(*) FILTER (event = 'succeeded') AS succeeded, count(*) FILTER (event = 'failed') AS failed, count(*) FILTER (event = 'cancelled') AS cancelled FROM reg_builds GROUP BY {key}) SELECT t.*, {_RANKS} FROM t LEFT JOIN q ON t.{key} IS NOT DISTINCT FROM q.{key}"


@query("w10_builds_by_transform", _by("transform"))
def w10(spark, d):
    return O.build_rollup_by(X.builds(spark, d), "transform")


@query("w10_builds_by_tenant", _by("tenant"))
def w10b(spark, d):
    return O.build_rollup_by(X.builds(spark, d), "tenant")


@query("w11_build_class", B + " SELECT build_id, CASE WHEN build_id % 13 = 0 THEN 'interactive' WHEN bytes_out > 2000000 THEN 'bulk' WHEN build_id % 8 > 5 THEN 'bulk' ELSE 'interactive' END AS class FROM reg_builds")
def w11(spark, d):
    k = F.col("build_id")
    return X.builds(spark, d).select("build_id", O.build_class(F.when(k % 13 == 0, "interactive"), F.col("bytes_out"), k % 8, 2_000_000, 5).alias("class"))


@query("w12_stuck_builds", V + " SELECT orderkey AS build_id, created_at FROM reg_versions WHERE state = 'building' AND created_at + INTERVAL 30 DAY < (SELECT max(created_at) FROM reg_versions)")
def w12(spark, d):
    v = X.versions(spark, d)
    lease = v.crossJoin(v.agg(F.max("created_at").alias("now"))).where((F.col("state") == "building") & (F.col("created_at") + F.make_dt_interval(F.lit(30)) < F.col("now")))
    return lease.select(F.col("orderkey").alias("build_id"), "created_at").orderBy("created_at", "build_id")


_LEASES = """WITH e AS (SELECT user_id AS build_id, ts, event_type = 'purchase' AS done, lag(ts) OVER o AS ts0, lag(event_type = 'purchase') OVER o AS done0, lead(ts) OVER o AS ts1
 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS final FROM events)
SELECT build_id, 'expired' AS kind, ts + INTERVAL 24 HOUR AS at FROM e, w WHERE NOT done AND (ts1 > ts + INTERVAL 24 HOUR OR (ts1 IS NULL AND ts + INTERVAL 24 HOUR < final))
UNION ALL SELECT build_id, 'reclaimed', ts FROM e WHERE NOT done0 AND ts0 + INTERVAL 24 HOUR < ts"""


@query("w12_lease_stream", _LEASES)
def w12b(spark, d):
    """Builds whose lease of a day ran out, and those that went on after it: a stream of the events, a micro-batch for every
    four days, with timers. A purchase ends a build."""
    e = table(spark, d, "events").select("user_id", "ts", "event_type")
    path = jobs.staged(e, F.floor(F.date_diff("ts", F.lit("1970-01-01").cast("date")) / 4), "lease-events")
    stream = jobs.file_stream(spark, path, 1)
    told = leases.lease_events(stream, "user_id", "ts", F.col("event_type") == "purchase", 86_400, "10 minutes")
    out = leases.with_timers(spark, lambda: jobs.run_available(told, "leases"))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("w13_tenant_builds", B + " SELECT build_id, created_at FROM reg_builds WHERE tenant = 't2' AND event = 'failed' ORDER BY created_at DESC, build_id LIMIT 25")
def w13(spark, d):
    return X.builds(spark, d).where("tenant = 't2' AND event = 'failed'").orderBy(F.desc("created_at"), "build_id").limit(25).select("build_id", "created_at")


@query("w13_purge", B + " SELECT event, count(*) AS n FROM reg_builds WHERE event <> 'cancelled' AND created_at < (SELECT max(created_at) - INTERVAL 500 DAY FROM reg_builds) GROUP BY event")
def w13b(spark, d):
    b = X.builds(spark, d)
    old = b.crossJoin(b.agg((F.max("created_at") - F.make_dt_interval(F.lit(500))).alias("limit_ts"))).where("event <> 'cancelled' AND created_at < limit_ts")
    return old.groupBy("event").agg(F.count("*").alias("n"))


@query("w14_entry_report", V + " SELECT 't' || (custkey % 20) AS table_id, count(*) AS entries, CAST(sum(byte_size) AS BIGINT) AS bytes, round(100.0 * sum(byte_size) / 1000000000, 4)::DOUBLE AS usage_percent, min(created_at) AS oldest, max(created_at) AS newest, count(DISTINCT year(created_at)) AS snapshots FROM reg_versions GROUP BY 1")
def w14(spark, d):
    v = X.versions(spark, d).groupBy(F.concat(F.lit("t"), (F.col("custkey") % 20).cast("string")).alias("table_id"))
    return v.agg(F.count("*").alias("entries"), F.sum("byte_size").alias("bytes"), F.round(100.0 * F.sum("byte_size") / 1_000_000_000, 4).cast("double").alias("usage_percent"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.count_distinct(F.year("created_at")).alias("snapshots"))


@query("w15_evictions", V + ", b AS (SELECT CAST(sum(byte_size) AS BIGINT) // 2 AS budget, CAST(sum(byte_size) AS BIGINT) AS total FROM reg_versions), r AS (SELECT id, version, byte_size, coalesce(sum(byte_size) OVER (ORDER BY created_at, id, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM reg_versions) SELECT id, version, byte_size FROM r, b WHERE total - before > CAST(floor(budget * 0.8::DOUBLE) AS BIGINT)")
def w15(spark, d):
    v = X.versions(spark, d).select("id", "version", "created_at", "byte_size")
    budget = v.agg(F.floor(F.sum("byte_size") / 2).alias("b")).first()["b"] or 0
    return REG.evictions(v, budget)


@query("w16_inspect", V + ", h AS (SELECT id, version, provenance_hash FROM reg_versions WHERE starts_with(provenance_hash, 'a')) SELECT id, version, provenance_hash, (SELECT count(*) FROM h) AS total, (SELECT count(*) > 50 FROM h) AS truncated FROM h ORDER BY provenance_hash, id, version LIMIT 50")
def w16(spark, d):
    h = X.versions(spark, d).where(F.col("provenance_hash").startswith("a")).select("id", "version", "provenance_hash")
    total = h.agg(F.count("*").alias("total"))
    return h.orderBy("provenance_hash", "id", "version").limit(50).crossJoin(total).withColumn("truncated", F.col("total") > 50)


_LEVELS = "lv AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS idx, * FROM (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users, count(*) FILTER (event_type <> 'error') AS goodput, count(*) FILTER (event_type = 'signup') / count(*) AS limited, count(*) FILTER (event_type = 'error') / count(*) AS errors, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1))"


@query("w17_capacity", f"WITH {_LEVELS}, f AS (SELECT arg_max(users, (goodput, -idx)) AS peak_users, max(goodput) AS peak_goodput, min(idx) FILTER (limited > 0.05) AS saturation, min(idx) FILTER (p95 > 2 * (SELECT p95 FROM lv WHERE idx = 0)) AS knee, min(idx) FILTER (errors > 0.01) AS error_level, max(idx) AS last FROM lv) SELECT peak_users, peak_goodput, saturation, knee, error_level, users AS recommended_users FROM f JOIN lv ON idx = CASE WHEN least(saturation, knee, error_level) IS NULL THEN last ELSE greatest(0, least(saturation, knee, error_level) - 1) END")
def w17(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"))
    days = e.agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") != "error").alias("goodput"), C.safe_ratio(F.count_if(F.col("event_type") == "signup"), F.count("*"), 12).alias("limited"), C.safe_ratio(F.count_if(F.col("event_type") == "error"), F.count("*"), 12).alias("errors"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    return O.capacity(days.withColumn("idx", F.row_number().over(W.orderBy("day")) - 1))


@query("w18_drift", "WITH v AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY v, day) AS k, count(*) OVER () AS n, v FROM v) SELECT round(regr_slope(v, day - DATE '2024-01-01'), 6) AS slope, round((SELECT v FROM o WHERE k = n // 2 + 1), 6) AS upper_median FROM v")
def w18(spark, d):
    v = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    slope = F.round(F.regr_slope("v", F.date_diff("day", F.lit("2024-01-01").cast("date"))), 6).alias("slope")
    ordered = F.array_sort(F.collect_list("v"))  # a value per day
    return v.agg(slope, F.round(F.get(ordered, F.floor(F.count("*") / 2).cast("int")), 6).alias("upper_median"))


@query("w19_phases", "SELECT CAST(week(ts) AS INTEGER) AS phase, count(*) AS n, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95, round(quantile_disc(value, 0.99), 2) AS p99, round(count(*) / (7 * 86400), 8) AS throughput, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS hit_rate FROM events GROUP BY 1")
def w19(spark, d):
    e = table(spark, d, "events").withColumn("phase", F.weekofyear("ts"))
    totals = e.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.count("*") / (7 * 86400), 8).alias("throughput"), C.safe_ratio(F.count_if(F.col("event_type") != "error"), F.count("*"), 4).alias("hit_rate"))
    return totals.join(R.nearest_rank(e, ["phase"], "value"), "phase")


_SIZED = """WITH RECURSIVE s AS (SELECT l_suppkey AS portfolio, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq, l_partkey AS ticker, l_discount * 10 - 0.5::DOUBLE AS strength, l_extendedprice / l_quantity / 100 AS price, l_returnflag = 'R' AS held FROM lineitem),
 c AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY seq, ticker, strength, price) AS i FROM s WHERE NOT held AND price > 0 AND abs(strength) >= 0.05),
 run(portfolio, i, seq, strength, qty, room, n) AS (
 SELECT portfolio, i, seq, strength, floor(least(abs(strength) * 2000.0::DOUBLE, 10000.0::DOUBLE) / price), CASE WHEN floor(least(abs(strength) * 2000.0::DOUBLE, 10000.0::DOUBLE) / price) > 0 THEN 10000.0::DOUBLE - floor(least(abs(strength) * 2000.0::DOUBLE, 10000.0::DOUBLE) / price) * price ELSE 10000.0::DOUBLE END, CASE WHEN floor(least(abs(strength) * 2000.0::DOUBLE, 10000.0::DOUBLE) / price) > 0 THEN 1 ELSE 0 END FROM c WHERE i = 1
 UNION ALL SELECT portfolio, i, seq, strength, q, CASE WHEN q > 0 THEN room - q * price ELSE room END, CASE WHEN q > 0 THEN n + 1 ELSE n END FROM (
 SELECT c.*, room, n, CASE WHEN n >= 20 OR room <= 0 THEN 0 ELSE floor(least(abs(c.strength) * 2000.0::DOUBLE, room) / c.price) END AS q FROM run JOIN c ON c.portfolio = run.portfolio AND c.i = run.i + 1))
 SELECT portfolio, seq, CASE WHEN strength > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(qty AS BIGINT) AS qty FROM run WHERE qty > 0"""


@query("f12_order_sizing", _SIZED)
def f12(spark, d):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("portfolio"), k.alias("seq"), F.col("l_partkey").alias("ticker"), (F.col("l_discount") * 10 - 0.5).alias("strength"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price"), (F.col("l_returnflag") == "R").alias("held"))
    return O.size_orders(s, 2000.0, 10_000.0, 20, 0.05)
