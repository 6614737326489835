"""Sources, zone maps, snapshots and materialization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import fixtures as X
from tidewell.plans.base import query
from tidewell.session import new_path, stored, table
from tidewell.sources import artifacts as A
from tidewell.sources import scan as S
from tidewell.sources.skipping import SkippingIndex


def t(spark, d, name):
    return table(spark, d, name)


# ---------------------------------------------------------------- 2.1
@query("s1_scan", "SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_quantity >= 40 AND l_discount < 0.03 AND l_returnflag = 'R'")
def s1(spark, d):
    return S.scan(t(spark, d, "lineitem"), ["l_orderkey", "l_shipdate", "l_quantity"], [("l_quantity", ">=", 40.0), ("l_discount", "<", 0.03), ("l_returnflag", "=", "R")])


@query("s2_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def s2(spark, d):
    return S.Scanner(t(spark, d, "orders"), None, [("o_totalprice", ">", 100000.0)]).count_rows()


@query("s2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7")
def s2b(spark, d):
    return S.Scanner(t(spark, d, "orders"), ["o_orderkey", "o_totalprice"]).head(7, ["o_totalprice", "o_orderkey"])


@query("s3_batches", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_orderstatus = 'F'")
def s3(spark, d):
    def twice(frames):
        for f in frames:
            yield f.assign(twice=(f["o_totalprice"] * 2).round(2))[["o_orderkey", "twice"]]

    return S.Scanner(t(spark, d, "orders"), ["o_orderkey", "o_totalprice"], [("o_orderstatus", "=", "F")]).map_batches(twice, "o_orderkey long, twice double")


_ZONES = "z AS (SELECT l_orderkey // 1000 AS zone, count(*) AS num_rows, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey, count(*) FILTER (l_orderkey IS NULL) AS nulls_l_orderkey, min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate, count(*) FILTER (l_shipdate IS NULL) AS nulls_l_shipdate FROM lineitem GROUP BY 1)"


def zones(spark, d) -> DataFrame:
    return S.zone_map(t(spark, d, "lineitem"), F.floor(F.col("l_orderkey") / 1000), ["l_orderkey", "l_shipdate"])


@query("s5_zone_map", f"WITH {_ZONES} SELECT * FROM z")
def s5(spark, d):
    return zones(spark, d)


@query("s5_footers", "SELECT 'l_orderkey' AS column_name, count(*) AS num_rows, CAST(min(l_orderkey) AS VARCHAR) AS min, CAST(max(l_orderkey) AS VARCHAR) AS max FROM lineitem")
def s5b(spark, d):
    """Statistics of the files' footers, reduced to the table; the data pages aren't decoded."""
    f = S.footer_statistics(spark, f"{d}/lineitem.parquet").where("column_name = 'l_orderkey'")
    return f.groupBy("column_name").agg(F.sum("num_rows").alias("num_rows"), F.min(F.col("min").cast("long")).cast("string").alias("min"), F.max(F.col("max").cast("long")).cast("string").alias("max"))


@query("s6_prune", f"WITH {_ZONES} SELECT zone, num_rows FROM z WHERE max_l_orderkey >= 2500 AND min_l_orderkey < 7000")
def s6(spark, d):
    return S.prune(zones(spark, d), [("l_orderkey", ">=", 2500), ("l_orderkey", "<", 7000)]).select("zone", "num_rows")


def clustered(spark, d) -> str:
    """A copy of lineitem with a file for each thousand of order keys."""
    path = new_path(spark, "clustered")
    t(spark, d, "lineitem").withColumn("zone", F.floor(F.col("l_orderkey") / 1000)).repartition("zone").write.partitionBy("zone").parquet(path)
    return path


_HIT = "max_l_orderkey >= 2500 AND min_l_orderkey < 7000"


@query("s1_skipping_scan", f"WITH {_ZONES} SELECT l_orderkey, l_linenumber, l_quantity, (SELECT count(*) FROM z WHERE {_HIT}) AS opened, (SELECT count(*) FROM z) AS files FROM lineitem WHERE l_orderkey >= 2500 AND l_orderkey < 7000 AND l_discount < 0.03")
def s1b(spark, d):
    """A scan that opens the files which an index leaves, and how many those are."""
    index = SkippingIndex(spark, new_path(spark, "index")).build(clustered(spark, d), ["l_orderkey", "l_shipdate"])
    out = index.scan(["l_orderkey", "l_linenumber", "l_quantity"], [("l_orderkey", ">=", 2500), ("l_orderkey", "<", 7000), ("l_discount", "<", 0.03)])
    files = index.zones().count()
    return out.withColumns({"opened": F.lit(len(out.inputFiles())).cast("long"), "files": F.lit(files).cast("long")})


@query("s6_bloom_scan", "SELECT l_orderkey, l_linenumber, l_partkey, true AS fewer FROM lineitem WHERE l_partkey = (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey >= 3000)")
def s6b(spark, d):
    """The rows of one part, which each file may have: a bloom tells those that don't. fewer: whether it left at most a tenth
    more files than hold such a row, and two."""
    path = clustered(spark, d)
    index = SkippingIndex(spark, new_path(spark, "index")).build(path, ["l_orderkey"], ["l_partkey"])
    part = t(spark, d, "lineitem").where("l_orderkey >= 3000").agg(F.min("l_partkey")).first()[0]
    out = index.scan(["l_orderkey", "l_linenumber", "l_partkey"], [("l_partkey", "=", part)])
    least = spark.read.parquet(path).where(F.col("l_partkey") == part).agg(F.count_distinct("zone")).first()[0]
    return out.withColumn("fewer", F.lit(least <= len(out.inputFiles()) <= 1.1 * least + 2))


@query("s7_plan_summary", f"WITH {_ZONES}, k AS (SELECT *, max_l_orderkey >= 2500 AND min_l_orderkey < 7000 AS keep FROM z) SELECT count(*) AS total, count(*) FILTER (keep) AS surviving, count(*) FILTER (NOT keep) AS pruned, CAST(coalesce(sum(num_rows) FILTER (keep), 0) * 100 AS BIGINT) AS bytes, count(*) FILTER (keep) <= 3 AS zones_ok, coalesce(sum(num_rows) FILTER (keep), 0) * 100 <= 1000000 AS bytes_ok, CASE WHEN sum(num_rows) FILTER (keep) * 100 > 500000 THEN 'bulk' ELSE 'interactive' END AS kind FROM k")
def s7(spark, d):
    return S.plan_summary(zones(spark, d), [("l_orderkey", ">=", 2500), ("l_orderkey", "<", 7000)], 100, 3, 1_000_000, 500_000)


def snapshots(spark, d) -> DataFrame:
    """Orders committed in three batches by date."""
    batch = F.when(F.year("o_orderdate") < 1996, 0).when(F.year("o_orderdate") < 1999, 1).otherwise(2)
    return S.commit_batches(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), batch, [0, 1, 2], "snapshots")


@query("s8_snapshot_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) < 1999")
def s8(spark, d):
    return S.read_snapshot(snapshots(spark, d), 1).select("o_orderkey", "o_totalprice")


@query("s9_snapshot_difference", "SELECT o_orderkey, 'added' AS change FROM orders WHERE year(o_orderdate) >= 1999")
def s9(spark, d):
    log = snapshots(spark, d)
    return S.difference(S.read_snapshot(log, 1).select("o_orderkey"), S.read_snapshot(log).select("o_orderkey"))


_BRANCH = "a AS (SELECT o_orderkey, o_totalprice FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 AND year(o_orderdate) >= 1999 THEN -1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT (o_orderkey % 10 = 5 AND year(o_orderdate) >= 1999))"


@query("s9_manifest_difference", f"WITH {_BRANCH} SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def s9b(spark, d):
    """Two snapshots that share the files of the first two batches; the one writes the third batch as it is, the other without
    some orders and with another price for others. Only the files of the third batches are read."""
    log = snapshots(spark, d)
    o = t(spark, d, "orders").where(F.year("o_orderdate") >= 1999).select("o_orderkey", "o_totalprice", "o_orderdate")
    path = new_path(spark, "branch")
    o.where("o_orderkey % 10 <> 5").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, -1.0).otherwise(F.col("o_totalprice"))).write.parquet(path)
    log = log.unionByName(spark.createDataFrame([(3, 1, 3, path)], log.schema))
    return S.manifest_difference(log, 2, 3, o.schema, ["o_orderkey", "o_totalprice"])


@query("s10_sql_over_scans", "SELECT event_type, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM events JOIN customer ON user_id = c_custkey WHERE value > 5 GROUP BY event_type")
def s10(spark, d):
    e = S.scan(t(spark, d, "events"), ["event_type", "user_id"], [("value", ">", 5.0)])
    return S.sql_over(spark, "SELECT event_type, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM {e} JOIN {c} ON user_id = c_custkey GROUP BY event_type", e=e, c=t(spark, d, "customer").select("c_custkey", "c_mktsegment"))


@query("s11_csv", "SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def s11(spark, d):
    path = new_path(spark, "csv")
    t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return S.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("s12_projected_drop_nulls", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 20")
def s12(spark, d):
    return t(spark, d, "documents").select("doc_id", "text", "lang").dropna(subset=["text"]).orderBy("doc_id").limit(20).select("doc_id", "lang")


def all_tables(spark, d):
    return {n: t(spark, d, n) for n in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")}


_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"
_COLUMNS = f"SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name, {_TYPES} AS type, is_nullable = 'YES' AS nullable FROM information_schema.columns WHERE table_name IN ('customer', 'events', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier')"


@query("s14_schema_rows", _COLUMNS)
def s14(spark, d):
    return S.schema_rows(spark, all_tables(spark, d))


@query("s15_schema_fingerprint", f"SELECT table_name, sha256(string_agg(e, ',' ORDER BY e)) AS fingerprint FROM (SELECT table_name, column_name || ':' || type || ':' || nullable AS e FROM ({_COLUMNS})) GROUP BY table_name")
def s15(spark, d):
    return S.schema_fingerprints(S.schema_rows(spark, all_tables(spark, d)))


@query("s16_freshness", "SELECT * FROM (VALUES ('after', true, true), ('before', false, true), ('missing', true, true)) v(state, changed, known)")
def s16(spark, d):
    """Whether the token of a table's files changed by an append (against the one before); a missing table has the token of
    the word missing."""
    path = new_path(spark, "fresh")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    o.where("o_orderkey % 2 = 0").write.parquet(path)
    before = stored(S.prefix_fingerprint(spark, path).withColumn("state", F.lit("before")), "token")
    o.where("o_orderkey % 2 <> 0").write.mode("append").parquet(path)
    after = S.prefix_fingerprint(spark, path).withColumn("state", F.lit("after"))
    tokens = before.unionByName(after).unionByName(S.prefix_fingerprint(spark, path + "-missing").withColumn("state", F.lit("missing")))
    first = before.select(F.col("fingerprint").alias("first"))
    known = F.when(F.col("state") == "missing", F.col("fingerprint") == F.sha2(F.lit("missing"), 256)).otherwise(F.col("files") > 0)
    return tokens.crossJoin(first).select("state", (F.col("fingerprint") != F.col("first")).alias("changed"), known.alias("known"))


@query("s17_prefix_fingerprint")
def s17(spark, d):
    return S.prefix_fingerprint(spark, f"{d}/lineitem.parquet")


def store(spark) -> A.ArtifactStore:
    return A.ArtifactStore(spark, new_path(spark, "artifacts"))


@query("s18_put", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def s18(spark, d):
    s, df = store(spark), t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return s.fetch(s.put(df, A.provenance_hash([("orders", "1")], "put@v1", {}), name="by_status").uri)


@query("s19_json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def s19(spark, d):
    return A.get_json(A.put_json(t(spark, d, "conversations").select("conv_id", "turn", "role", "text")), "conv_id long, turn long, role string, text string")


@query("s20_fetch_by_name", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def s20(spark, d):
    s = store(spark)
    s.put(t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal"), "0" * 64, name="solvent")
    return s.fetch("solvent")


@query("s21_write_script", "SELECT * FROM (VALUES (0, 'DROP', CAST(NULL AS BIGINT)), (1, 'CREATE', NULL), (2, 'INSERT', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')), (3, 'INSERT', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')), (4, 'DROP', NULL)) v(stmt, kind, rows_affected)")
def s21(spark, d):
    import uuid

    name = f"script_{uuid.uuid4().hex}"
    o = f"parquet.`{d}/orders.parquet`"
    return A.run_script(spark, [f"DROP TABLE IF EXISTS {name}", f"CREATE TABLE {name} (k BIGINT, p DOUBLE) USING parquet", f"INSERT INTO {name} SELECT o_orderkey, o_totalprice FROM {o} WHERE o_orderstatus = 'F'", f"INSERT INTO {name} SELECT o_orderkey, o_totalprice FROM {o} WHERE o_orderstatus = 'P'", f"DROP TABLE {name}"])


@query("s22_insert_if_absent", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def s22(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.insert_if_absent(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("s23_high_water", "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id % 4 = 0 AND ts < TIMESTAMP '2024-01-20')")
def s23(spark, d):
    from datetime import datetime

    e = t(spark, d, "events").select("event_id", "ts")
    return S.after_high_water(e, e.where((F.col("event_id") % 4 == 0) & (F.col("ts") < F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz"))), "ts", 7)


@query("s24_stale_statistics", "SELECT 'changed' AS reason, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'gone', 1")
def s24(spark, d):
    """Of four recorded files two have another length by now; another one was recorded and is gone; remote ones never are."""
    path = new_path(spark, "stats")
    t(spark, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(4)).alias("k")).write.partitionBy("k").option("maxRecordsPerFile", 0).parquet(path)
    now = S.listing(spark, path).where(F.col("path").contains("/part-"))
    # one row for each k: the number of files of a partition follows the number of tasks
    recorded = stored(now.groupBy(F.regexp_extract("path", r"/k=(\d+)/", 1).alias("k")).agg(F.min_by(F.struct("path", "length", "modificationTime"), "path").alias("f")).select("k", "f.*"), "listing")
    changed = recorded.withColumn("length", F.when(F.col("k").isin("1", "3"), F.col("length") + 1).otherwise(F.col("length"))).drop("k")
    gone = recorded.where("k = '0'").drop("k").withColumn("path", F.concat("path", F.lit("-gone")))
    remote = recorded.where("k = '0'").drop("k").withColumn("path", F.lit("s3://bucket/part-0.parquet"))
    return S.stale_statistics(changed.unionByName(gone).unionByName(remote), now).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- 2.10, with writes
_JOIN = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM input0 JOIN input1 ON o_custkey = c_custkey GROUP BY c_mktsegment"


def twice(spark: SparkSession, d: str):
    """The same request two times on one store."""
    s = store(spark)
    inputs = [("file:///wh#db.orders", "1", t(spark, d, "orders")), ("file:///wh#db.customer", "1", t(spark, d, "customer"))]
    first = s.materialize(inputs, "sql@v1", {"sql": _JOIN}, name="segments")
    return s, first, s.materialize(inputs, "sql@v1", {"sql": _JOIN}, name="segments"), inputs


@query("m5_materialize", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, false AS first_hit, true AS second_hit, CAST(1 AS BIGINT) AS versions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def m5(spark, d):
    s, a, b, _ = twice(spark, d)
    n = s.versions().agg(F.count("*").alias("versions"))
    return b.df.withColumns({"first_hit": F.lit(a.hit), "second_hit": F.lit(b.hit)}).crossJoin(n)


_GROUPS = "(SELECT count(DISTINCT c_mktsegment) FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("m6_refresh", f"SELECT 'ready' AS state, {_GROUPS} AS row_count, CAST(2 AS BIGINT) AS versions, CAST(2 AS BIGINT) AS hashes")
def m6(spark, d):
    s, _, _, inputs = twice(spark, d)
    s.materialize(inputs, "sql@v1", {"sql": _JOIN}, refresh=True)
    return s.versions().groupBy("state", "row_count").agg(F.count("*").alias("versions"), F.count_distinct("provenance_hash").alias("hashes"))


@query("m8_finalize_and_name", f"SELECT 'segments' AS name, 'ready' AS state, {_GROUPS} AS row_count, true AS same")
def m8(spark, d):
    s, a, _, _ = twice(spark, d)
    return s.names().join(s.versions().select("id", "version", "state", "row_count"), ["id", "version"]).select("name", "state", "row_count", (F.col("id") == a.id).alias("same"))


@query("m7_finalize", "SELECT * FROM (VALUES ('late', 1, 'failed'), ('late', 2, 'failed'), ('early', 1, 'ready')) v(id, version, state)")
def m7b(spark, d):
    """Two builds of one result: the second one to get ready is marked as failed, and finalizing again changes nothing."""
    s, df = store(spark), t(spark, d, "nation")
    first, second = s.begin("h", id_="late"), s.begin("h", id_="early")
    for at in (first, second):
        df.write.parquet(s.payload(*at))
    s.finalize(*second, 25)
    s.finalize(*second, 25)
    s.finalize(*first, 25)
    third = s.begin("h", id_="late")
    s.fail(*third)
    return s.versions().select("id", F.col("version").cast("int").alias("version"), "state")


@query("m16_delete_version", f"SELECT 'kept' AS name, 'balances' AS id, CAST(1 AS BIGINT) AS version, count(*) AS row_count FROM customer WHERE c_acctbal > 0")
def m16b(spark, d):
    """A version goes with its names in one commit; other versions and names stay."""
    s, c = store(spark), t(spark, d, "customer").select("c_custkey", "c_acctbal")
    s.put(c.where("c_acctbal > 0"), "a" * 64, name="kept", id_="balances")
    gone = s.put(c.where("c_acctbal < 0"), "b" * 64, name="gone", id_="balances")
    s.set_name("also gone", gone.id, gone.version)
    s.delete(gone.id, gone.version)
    s.compact()
    return s.names().join(s.versions().select("id", "version", "row_count"), ["id", "version"]).select("name", "id", "version", "row_count")


def seconds(ts):
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def loaded(spark, d) -> A.ArtifactStore:
    """A store with the versions and names made from orders, taken in as one commit."""
    s, v = store(spark), X.versions(spark, d)
    rows = v.select("id", "version", "state", "provenance_hash", "row_count", seconds(F.col("created_at")).alias("at"), F.col("executor").alias("transform"), "tenant")
    s.load(rows, X.names(spark, d).select("tenant", "name", F.col("artifact_id").alias("id"), "version"))
    return s


_TEN = "ten AS (SELECT id, version, orderkey, provenance_hash, tenant FROM (SELECT *, row_number() OVER (PARTITION BY provenance_hash ORDER BY orderkey) AS k FROM reg_versions WHERE state = 'building') WHERE k = 1 ORDER BY orderkey LIMIT 10)"


@query("m7_two_writers", f"WITH {X.VERSIONS}, {_TEN} SELECT CASE WHEN ten.id IS NULL THEN v.state WHEN EXISTS (SELECT 1 FROM reg_versions r WHERE r.state = 'ready' AND r.provenance_hash = v.provenance_hash AND r.tenant IS NOT DISTINCT FROM v.tenant) THEN 'failed' ELSE 'ready' END AS state, v.tenant, ten.id IS NOT NULL AS settled, count(*) AS n, CAST(sum(v.version) AS BIGINT) AS versions FROM reg_versions v LEFT JOIN ten ON ten.id = v.id AND ten.version = v.version GROUP BY 1, 2, 3")
def m7c(spark, d):
    """Two writers finalize, by turns, ten versions that are being built; where another version of the same hash and tenant
    is ready, theirs fails. The states of all versions afterwards."""
    s = loaded(spark, d)
    writers = [s, A.ArtifactStore(spark, s.root)]
    first = X.versions(spark, d).where("state = 'building'").groupBy("provenance_hash").agg(F.min_by(F.struct("orderkey", "id", "version"), "orderkey").alias("v"))
    ten = [(r["id"], r["version"]) for r in first.select("v.*").orderBy("orderkey").limit(10).collect()]
    for i, at in enumerate(ten):
        writers[i % 2].finalize(*at, 1)
    mine = spark.createDataFrame(ten, "id string, version long").withColumn("settled", F.lit(True))
    states = s.versions().join(mine, ["id", "version"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    return states.groupBy("state", "tenant", "settled").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query("m15_collect", f"WITH {X.VERSIONS}, {X.NAMES}, o AS (SELECT max(created_at) - INTERVAL 365 DAY AS t FROM reg_versions) SELECT state, count(*) AS n, CAST(sum(row_count) AS BIGINT) AS rows, count(*) FILTER (EXISTS (SELECT 1 FROM reg_names n WHERE n.artifact_id = v.id AND n.version = v.version)) AS named FROM reg_versions v, o WHERE NOT (state IN ('ready', 'failed') AND created_at < o.t AND NOT EXISTS (SELECT 1 FROM reg_names n WHERE n.artifact_id = v.id AND n.version = v.version)) GROUP BY state")
def m15b(spark, d):
    """What is left when versions without a name, ready or failed, that are over a year older than the newest are deleted."""
    s = loaded(spark, d)
    newest = s.versions().agg(F.max("at")).first()[0] or 0.0
    s.collect_garbage(newest - 365 * 86400)
    named = s.names().select("id", "version").distinct().withColumn("named", F.lit(1))
    left = s.versions().join(named, ["id", "version"], "left")
    return left.groupBy("state").agg(F.count("*").alias("n"), F.sum("row_count").alias("rows"), F.count("named").alias("named"))


@query("m15_sweep", "WITH g AS (SELECT c_mktsegment AS id, row_number() OVER (ORDER BY c_mktsegment) AS k, count(*) AS n FROM customer GROUP BY 1) SELECT id, n AS row_count, k <= 2 AS there, CASE WHEN k > 2 THEN 'deleted' END AS reason, true AS freed FROM g UNION ALL SELECT 'orphan', NULL, false, 'orphan', true UNION ALL SELECT 'unfinished', NULL, true, NULL, true")
def m15c(spark, d):
    """Payloads by market segment: the first two have a name, the others are garbage. Beside them one that no commit tells of,
    and one that is being written. What is there after sweeping; freed: whether the bytes that are gone are those reported."""
    s, c = store(spark), t(spark, d, "customer")
    segments = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a constant few
    for k, g in enumerate(segments):
        s.put(c.where(F.col("c_mktsegment") == g), A.provenance_hash([("customer", g)], "put@v1", {}), name=g if k < 2 else None, id_=g)
    unfinished = s.begin("u", id_="unfinished")
    for at in (unfinished, ("orphan", 1)):
        c.limit(5).write.parquet(s.payload(*at))
    rows = stored(s.versions().select("id", "row_count"), "versions")
    before = stored(s.payloads(), "payloads")
    s.collect_garbage(float("inf"))
    swept = s.sweep(0, float("inf"))
    after = stored(s.payloads(), "payloads")
    total = lambda p: p.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
    freed = total(before).withColumnRenamed("b", "b0").crossJoin(total(after)).crossJoin(total(swept).withColumnRenamed("b", "b1")).select((F.col("b0") - F.col("b") == F.col("b1")).alias("freed"))
    out = before.select("id").join(rows, "id", "left").join(after.select("id", F.lit(True).alias("there")), "id", "left").join(swept.select("id", "reason"), "id", "left")
    return out.crossJoin(freed).select("id", "row_count", F.coalesce("there", F.lit(False)).alias("there"), "reason", "freed")


@query("m17_cell_versions", "SELECT 'v' || (o_custkey % 3) AS variable, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 END AS iteration, count(*) AS versions, CAST(max(o_orderkey) AS BIGINT) AS newest, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS rows FROM orders WHERE o_custkey % 10 = 1 AND o_orderstatus = 'F' GROUP BY 1, 2")
def m17d(spark, d):
    """The ready versions of the variables of one of ten cells, with loop iterations; all orders are versions of a variable."""
    s, k, c = store(spark), F.col("o_orderkey"), F.col("o_custkey")
    id_ = F.concat(F.format_string("c%d:v%d", c % 10, c % 3), F.when(k % 4 == 0, F.format_string("@iter=%d", k % 5)).otherwise(""))
    state = F.when(F.col("o_orderstatus") == "F", "ready").otherwise("building")
    s.load(t(spark, d, "orders").select(id_.alias("id"), k.alias("version"), state.alias("state"), F.floor("o_totalprice").alias("row_count")))
    return s.of_cell("c1").groupBy("variable", "iteration").agg(F.count("*").alias("versions"), F.max("version").alias("newest"), F.sum("row_count").alias("rows"))


@query("k4_resolve", f"WITH {X.VERSIONS} SELECT id, version, CASE WHEN state <> 'ready' THEN 'missing' WHEN tenant IS NULL OR tenant = 't1' THEN 'read' ELSE 'denied' END AS outcome FROM reg_versions ORDER BY orderkey LIMIT 12")
def k4c(spark, d):
    """What tenant t1 may read of the versions of the first twelve orders."""
    s, out = loaded(spark, d), []
    for r in X.versions(spark, d).orderBy("orderkey").limit(12).select("id", "version").collect():
        try:
            s.resolve(f"artifact://{r['id']}@v={r['version']}", "t1")
            out.append((r["id"], r["version"], "read"))
        except PermissionError:
            out.append((r["id"], r["version"], "denied"))
        except KeyError:
            out.append((r["id"], r["version"], "missing"))
    return spark.createDataFrame(out, "id string, version long, outcome string")


@query("m17_preview", "SELECT 'regions' AS id, CAST(1 AS BIGINT) AS version, count(*) AS row_count, 'struct<r_regionkey:bigint,r_name:string>' AS schema, string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ';' ORDER BY r_regionkey) AS preview FROM region")
def m17b(spark, d):
    s = store(spark)
    s.put(t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"), "r" * 64, name="regions", id_="regions")
    return s.preview("regions", n=10).select("id", "version", "row_count", "schema", F.array_join("preview", ";").alias("preview"))


@query("m17_cell_artifacts", "SELECT * FROM (VALUES ('total', NULL::BIGINT, 1::BIGINT), ('total', NULL, 2), ('carry', 0, 1), ('carry', 1, 1)) v(variable, iteration, version)")
def m17c(spark, d):
    """The ready versions of the variables of one cell, loop iterations among them; a cell whose name goes on is another."""
    s, df = store(spark), t(spark, d, "region")
    for id_, n in (("cell1:total", 2), ("cell1:carry@iter=0", 1), ("cell1:carry@iter=1", 1), ("cell10:total", 1)):
        for k in range(n):
            s.put(df, f"{id_}{k}", id_=id_)
    s.begin("unfinished", id_="cell1:total")
    return s.of_cell("cell1").select("variable", "iteration", "version")


@query("k4_tenant_fetch", "SELECT * FROM (VALUES ('own', 'read'), ('shared', 'read'), ('other', 'denied'), ('unfinished', 'missing'), ('all', 'read')) v(what, outcome)")
def k4b(spark, d):
    """What a tenant may fetch by URI: its own versions and those without a tenant, if they are ready."""
    s, df = store(spark), t(spark, d, "region")
    own, other, shared = (s.put(df, k, tenant=tenant, id_=k) for k, tenant in (("own", "t1"), ("other", "t2"), ("shared", None)))
    half = s.begin("half", tenant="t1")
    out = []
    for what, uri, tenant in (("own", own.uri, "t1"), ("shared", shared.uri, "t1"), ("other", other.uri, "t1"), ("unfinished", f"artifact://{half[0]}@v={half[1]}", "t1"), ("all", other.uri, None)):
        try:
            s.fetch(uri, tenant)
            out.append((what, "read"))
        except PermissionError:
            out.append((what, "denied"))
        except KeyError:
            out.append((what, "missing"))
    return spark.createDataFrame(out, "what string, outcome string")


@query("m23_resume", "WITH RECURSIVE g AS (SELECT r_regionkey AS k, CAST(r_regionkey AS BIGINT) AS x, 0 AS i FROM region UNION ALL SELECT k, (x * 3 + 1) % 1000003, i + 1 FROM g WHERE i < 7) SELECT k, x, CAST(7 AS BIGINT) AS iterations, CAST(8 AS BIGINT) AS stored FROM g WHERE i = 7")
def m23b(spark, d):
    """A loop that is stopped after 4 iterations and goes on from the third one to the seventh."""
    s = store(spark)
    start = t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").cast("long").alias("x"))
    step = lambda c: c.select("k", ((F.col("x") * 3 + 1) % 1_000_003).alias("x"))
    never = lambda a, b: False
    s.iterate("loop", "carry", start, step, never, 4)
    out, k = s.iterate("loop", "carry", start, step, never, 7, start_from=3)
    n = s.iterations("loop", "carry").agg(F.count("*").alias("stored"))
    return out.withColumn("iterations", F.lit(k).cast("long")).crossJoin(n)


@query("m18_sql_transform", "SELECT n_name, count(*) AS n, '{input0}' AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def m18(spark, d):
    return A.sql_transform(spark, "SELECT n_name, count(*) AS n, '{input0}' AS text FROM input0 JOIN input1 ON s_nationkey = n_nationkey GROUP BY n_name", [t(spark, d, "supplier"), t(spark, d, "nation")])


@query("m19_chain", "SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE value > 10 GROUP BY event_type")
def m19(spark, d):
    s = store(spark)
    big = s.materialize([("file:///wh#db.events", "1", t(spark, d, "events"))], "scan@v1", {"columns": ["event_type", "value"], "filters": [["value", ">", 10.0]]})
    return s.materialize([big.input], "sql@v1", {"sql": "SELECT event_type, round(avg(value), 6) AS mean FROM input0 GROUP BY event_type"}).df


@A.register_transform("above@v1", column=str, least=float)
def above(inputs: list[DataFrame], params: dict) -> DataFrame:
    return inputs[0].where(F.col(params["column"]) > params["least"])


@query("x1_registered_transform", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 900")
def x1(spark, d):
    return A.run_transform("above@v1", [t(spark, d, "part").select("p_partkey", "p_retailprice")], {"column": "p_retailprice", "least": 900.0})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return twice(spark, d)[2].df
