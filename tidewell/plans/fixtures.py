"""Metadata tables derived from the given ones, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.session import table

VERSIONS = """reg_versions AS (SELECT 'a' || o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS version,
 CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'building' ELSE 'failed' END AS state, sha256(o_custkey || ':' || o_orderpriority) AS provenance_hash,
 CAST(floor(o_totalprice / 100) AS BIGINT) AS row_count, CAST(floor(o_totalprice) AS BIGINT) AS byte_size, o_orderdate AS created_at,
 CASE WHEN o_custkey % 7 <> 0 THEN 't' || (o_custkey % 5) END AS tenant, 'u' || (o_custkey % 11) AS principal,
 CASE WHEN o_orderkey % 2 = 0 THEN 'scan@v1' ELSE 'sql@v1' END AS executor, o_custkey AS custkey, o_orderkey AS orderkey FROM orders)"""
NAMES = """reg_names AS (SELECT 'n' || custkey AS name, id AS artifact_id, max(version) AS version, arg_max(created_at, version) AS updated_at, coalesce(any_value(tenant), '') AS tenant
 FROM reg_versions WHERE custkey % 3 = 0 AND state = 'ready' GROUP BY custkey, id)"""
EDGES = """reg_edges AS (SELECT id, version, 'artifact://' || id AS input_uri, id || '@v=' || (version - 1) AS input_version FROM reg_versions WHERE version > 1
 UNION ALL SELECT id, version, 'artifact://a' || (custkey // 2), 'a' || (custkey // 2) || '@v=1' FROM reg_versions WHERE version = 1 AND custkey > 1
 UNION ALL SELECT id, version, 'file:///wh#db.t' || (custkey % 20), CAST(year(created_at) AS VARCHAR) FROM reg_versions)"""
CURRENT = """cur AS (SELECT 'artifact://' || id AS input_uri, id || '@v=' || max(version) AS current FROM reg_versions WHERE state = 'ready' GROUP BY id
 UNION ALL SELECT input_uri, CAST(max(CAST(input_version AS BIGINT)) AS VARCHAR) FROM reg_edges WHERE NOT starts_with(input_uri, 'artifact://') GROUP BY input_uri)"""
REQUESTS = """reg_requests AS (SELECT c_custkey AS request_id, sha256(c_custkey || ':1-URGENT') AS provenance_hash, CASE WHEN c_custkey % 7 <> 0 THEN 't' || (c_custkey % 5) END AS tenant, 'n' || c_custkey AS name, 'u' || (c_custkey % 11) AS principal FROM customer)"""
BUILDS = """reg_builds AS (SELECT o_orderkey AS build_id, CASE WHEN o_custkey % 7 <> 0 THEN 't' || (o_custkey % 5) END AS tenant, o_orderpriority AS transform,
 CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'cancelled' END AS event, CAST(floor(o_totalprice) AS BIGINT) % 10000 AS duration_ms,
 CAST(floor(o_totalprice) AS BIGINT) * 10 AS bytes_out, o_orderkey % 500 AS queue_wait_ms, o_orderdate AS created_at FROM orders)"""
RUNS = """reg_runs AS (SELECT 'c' || (user_id % 50) AS cell, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS BIGINT) AS seq, CAST(floor(value * 10) AS BIGINT) AS ms, event_type IN ('click', 'view') AS hit FROM events)"""
ACCESSES = """accesses AS (SELECT user_id % 40 AS table_id, ts, event_id, event_type <> 'error' AS is_hit, CAST(floor(value * 1000) AS BIGINT) AS bytes, value FROM events)"""
CELLS = """cells AS (SELECT p_partkey AS pos, 'v' || (p_partkey % 7) AS defines, CASE WHEN p_partkey >= 3 THEN 'v' || ((p_partkey * 3) % 7) END AS refs FROM part)"""
#: A graph of steps without cycles: each customer follows those at a half and a third of its number.
GRAPH = """nodes AS (SELECT c_custkey AS node, CASE c_custkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'idle' ELSE 'ready' END AS status, c_custkey * 7 % 1000 AS ms FROM customer),
 links AS (SELECT DISTINCT p AS src, node AS dst FROM (SELECT node, node // 2 AS p FROM nodes UNION ALL SELECT node, node // 3 FROM nodes) WHERE p IN (SELECT node FROM nodes))"""


#: Rings of seven customers with a shorter way in some, chains, and pairs; each block of three is one way only.
RINGS = """rings AS (SELECT src, dst FROM (SELECT c_custkey AS src, c_custkey // 7 AS g, c_custkey % 7 AS i FROM customer) c, LATERAL (SELECT unnest([
 CASE WHEN g % 3 = 0 THEN g * 7 + (i + 1) % 7 WHEN g % 3 = 1 AND i < 6 THEN src + 1 WHEN g % 3 = 2 AND i IN (0, 3) THEN src + 1 END,
 CASE WHEN g % 3 = 2 AND i IN (1, 4) THEN src - 1 WHEN g % 3 = 2 AND i = 6 THEN src WHEN g % 6 = 0 AND i = 0 THEN src + 4 END,
 CASE WHEN i = 6 AND g % 3 < 2 THEN src + 1 END]) AS dst) x WHERE dst IN (SELECT c_custkey FROM customer))"""


def rings(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    s, g, i = F.col("src"), F.floor(F.col("src") / 7), F.col("src") % 7
    ways = [
        F.when(g % 3 == 0, g * 7 + (i + 1) % 7).when((g % 3 == 1) & (i < 6), s + 1).when((g % 3 == 2) & i.isin(0, 3), s + 1),
        F.when((g % 3 == 2) & i.isin(1, 4), s - 1).when((g % 3 == 2) & (i == 6), s).when((g % 6 == 0) & (i == 0), s + 4),
        F.when((i == 6) & (g % 3 < 2), s + 1),
    ]
    pairs = keys.select("src", F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("dst"))
    return pairs.join(keys.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def versions(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), F.col
    return o.select(
        F.concat(F.lit("a"), c("o_custkey").cast("string")).alias("id"),
        F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("version"),
        F.when(c("o_orderstatus") == "F", "ready").when(c("o_orderstatus") == "O", "building").otherwise("failed").alias("state"),
        F.sha2(F.concat_ws(":", c("o_custkey").cast("string"), "o_orderpriority"), 256).alias("provenance_hash"),
        F.floor(c("o_totalprice") / 100).alias("row_count"),
        F.floor("o_totalprice").alias("byte_size"),
        c("o_orderdate").alias("created_at"),
        _tenant(c("o_custkey")).alias("tenant"),
        F.concat(F.lit("u"), (c("o_custkey") % 11).cast("string")).alias("principal"),
        F.when(c("o_orderkey") % 2 == 0, "scan@v1").otherwise("sql@v1").alias("executor"),
        c("o_custkey").alias("custkey"),
        c("o_orderkey").alias("orderkey"),
    )


def _tenant(key):
    return F.when(key % 7 != 0, F.concat(F.lit("t"), (key % 5).cast("string")))


def names(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d).where("custkey % 3 = 0 AND state = 'ready'").groupBy("custkey", F.col("id").alias("artifact_id"))
    out = v.agg(F.max("version").alias("version"), F.max_by("created_at", "version").alias("updated_at"), F.coalesce(F.max("tenant"), F.lit("")).alias("tenant"))
    return out.select(F.concat(F.lit("n"), F.col("custkey").cast("string")).alias("name"), "artifact_id", "version", "updated_at", "tenant")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """All inputs of a version in one pass over the versions."""
    v, c = versions(spark, d), F.col
    half = F.floor(c("custkey") / 2).cast("string")
    entry = lambda u, w: F.struct(u.alias("input_uri"), w.alias("input_version"))
    before = F.when(c("version") > 1, entry(F.concat(F.lit("artifact://"), "id"), F.concat("id", F.lit("@v="), (c("version") - 1).cast("string"))))
    parent = F.when((c("version") == 1) & (c("custkey") > 1), entry(F.concat(F.lit("artifact://a"), half), F.concat(F.lit("a"), half, F.lit("@v=1"))))
    source = entry(F.concat(F.lit("file:///wh#db.t"), (c("custkey") % 20).cast("string")), F.year("created_at").cast("string"))
    ins = F.filter(F.array(before, parent, source), lambda x: x.isNotNull())
    return v.select("id", "version", F.explode(ins).alias("x")).select("id", "version", "x.*")


def requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = k.cast("string")
    return table(spark, d, "customer").select(
        k.alias("request_id"), F.sha2(F.concat(text, F.lit(":1-URGENT")), 256).alias("provenance_hash"), _tenant(k).alias("tenant"),
        F.concat(F.lit("n"), text).alias("name"), F.concat(F.lit("u"), (k % 11).cast("string")).alias("principal"),
    )


def builds(spark: SparkSession, d: str) -> DataFrame:
    c, price = F.col, F.floor("o_totalprice")
    event = F.when(c("o_orderstatus") == "F", "succeeded").when(c("o_orderstatus") == "O", "failed").otherwise("cancelled")
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("build_id"), _tenant(c("o_custkey")).alias("tenant"), c("o_orderpriority").alias("transform"), event.alias("event"),
        (price % 10000).alias("duration_ms"), (price * 10).alias("bytes_out"), (c("o_orderkey") % 500).alias("queue_wait_ms"), c("o_orderdate").alias("created_at"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    own = W.partitionBy(F.col("user_id") % 50).orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("cell"), F.row_number().over(own).cast("long").alias("seq"),
        F.floor(F.col("value") * 10).alias("ms"), F.col("event_type").isin("click", "view").alias("hit"),
    )


def accesses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 40).alias("table_id"), "ts", "event_id", (F.col("event_type") != "error").alias("is_hit"), F.floor(F.col("value") * 1000).alias("bytes"), "value")


def cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("pos"), F.concat(F.lit("v"), (k % 7).cast("string")).alias("defines"), F.when(k >= 3, F.concat(F.lit("v"), (k * 3 % 7).cast("string"))).alias("refs"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("node"), F.when(k % 5 == 0, "stale").when(k % 5 == 1, "idle").otherwise("ready").alias("status"), (k * 7 % 1000).alias("ms"))


def links(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("node")
    pairs = n.select(F.explode(F.array_distinct(F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3)))).alias("src"), F.col("node").alias("dst"))
    return pairs.join(n.withColumnRenamed("node", "src"), "src", "left_semi")
