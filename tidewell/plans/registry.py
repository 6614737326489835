"""Artifact registry, access rules and dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.operators import graph as G
from tidewell.operators import ordered
from tidewell.operators import registry as R
from tidewell.operators import relational as REL
from tidewell.plans import fixtures as X
from tidewell.plans.base import query
from tidewell.session import stored, table


def w(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


V, N, E, CUR, Q, B, RUNS, CELLS, GRAPH = X.VERSIONS, X.NAMES, X.EDGES, X.CURRENT, X.REQUESTS, X.BUILDS, X.RUNS, X.CELLS, X.GRAPH


@query("a22_store_totals", w(V, N) + "SELECT count(DISTINCT v.id) AS ids, count(*) AS versions, count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'building') AS building, count(*) FILTER (state = 'failed') AS failed, CAST(sum(byte_size) AS BIGINT) AS bytes, CAST(sum(row_count) AS BIGINT) AS rows, min(created_at) AS oldest, max(created_at) AS newest, count(*) FILTER (n.name IS NULL AND state = 'ready') AS unreferenced, (SELECT count(*) FROM reg_names) AS names FROM reg_versions v LEFT JOIN reg_names n ON v.id = n.artifact_id AND v.version = n.version")
def a22(spark, d):
    return R.usage(X.versions(spark, d), X.names(spark, d))


@query("a23_counts_by_state", w(B) + "SELECT event, count(*) AS n FROM reg_builds GROUP BY event")
def a23(spark, d):
    return X.builds(spark, d).groupBy("event").agg(F.count("*").alias("n"))


@query("v4_latest_version", w(V) + "SELECT id, max(version) AS version, arg_max(state, version) AS state, arg_max(created_at, version) AS created_at FROM reg_versions GROUP BY id")
def v4(spark, d):
    return R.latest(X.versions(spark, d))


@query("v5_next_version", w(V) + "SELECT 'a' || c_custkey AS id, CAST(coalesce((SELECT max(version) FROM reg_versions r WHERE r.id = 'a' || c_custkey), 0) + 1 AS BIGINT) AS version FROM customer")
def v5(spark, d):
    batch = table(spark, d, "customer").select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey")
    return R.next_versions(X.versions(spark, d), batch, "c_custkey").select("id", "version")


@query("v6_estimated_duration", w(RUNS) + "SELECT cell, arg_max(ms, seq) FILTER (NOT hit) AS ms FROM reg_runs GROUP BY cell")
def v6(spark, d):
    return X.runs(spark, d).groupBy("cell").agg(F.max_by(F.when(~F.col("hit"), F.col("ms")), F.when(~F.col("hit"), F.col("seq"))).alias("ms"))


def savings(runs, most: int | None = None):
    """Each hit earns the duration of the last miss before it."""
    out = ordered.last_before(runs, "cell", ["seq"], F.when(~F.col("hit"), F.col("ms")), most)
    return out.withColumn("earned", F.when(F.col("hit"), F.coalesce("earlier", F.lit(0))).otherwise(0)).drop("earlier")


_SAVED = "s AS (SELECT *, CASE WHEN hit THEN coalesce(last_value(CASE WHEN NOT hit THEN ms END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS earned FROM reg_runs)"


@query("v7_cache_savings", w(RUNS, _SAVED) + "SELECT cell, CAST(sum(earned) AS BIGINT) AS saved_ms FROM s GROUP BY cell")
def v7(spark, d):
    return savings(X.runs(spark, d)).groupBy("cell").agg(F.sum("earned").alias("saved_ms"))


@query("v8_run_profile", w(RUNS, _SAVED) + "SELECT cell, count(*) AS runs, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(sum(ms) FILTER (NOT hit) AS BIGINT) AS run_ms, CAST(sum(earned) AS BIGINT) AS saved_ms, arg_max(ms, seq) AS last_ms FROM s GROUP BY cell")
def v8(spark, d):
    hit = F.col("hit")
    return savings(X.runs(spark, d)).groupBy("cell").agg(F.count("*").alias("runs"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.sum(F.when(~hit, F.col("ms"))).alias("run_ms"), F.sum("earned").alias("saved_ms"), F.max_by("ms", "seq").alias("last_ms"))


_QUOTA = """q AS (SELECT build_id, bytes_out, coalesce(tenant, '') AS t, CAST(created_at AS DATE) AS day, row_number() OVER (PARTITION BY coalesce(tenant, ''), CAST(created_at AS DATE) ORDER BY created_at, build_id) AS n FROM reg_builds),
 run(t, day, n, build_id, accepted, used) AS (SELECT t, day, n, build_id, bytes_out <= 3000000, CASE WHEN bytes_out <= 3000000 THEN bytes_out ELSE 0 END FROM q WHERE n = 1
 UNION ALL SELECT q.t, q.day, q.n, q.build_id, used + bytes_out <= 3000000, CASE WHEN used + bytes_out <= 3000000 THEN used + bytes_out ELSE used END FROM run JOIN q ON q.t = run.t AND q.day = run.day AND q.n = run.n + 1)"""


@query("v9_daily_quota", w(B, _QUOTA) + "SELECT build_id, accepted FROM run")
def v9(spark, d):
    from tidewell.operators.rollups import accept_within_quota

    return accept_within_quota(X.builds(spark, d), 3_000_000)


@query("l3_page", w(V) + "SELECT id, version, created_at FROM reg_versions ORDER BY created_at DESC, id, version LIMIT 50 OFFSET 50")
def l3(spark, d):
    return R.page(X.versions(spark, d), 50, 50).select("id", "version", "created_at")


# ---------------------------------------------------------------- 2.10
@query("m1_provenance", w(V, E) + "SELECT id, version, sha256(string_agg(input_uri || ':' || input_version, chr(10) ORDER BY input_uri, input_version) || chr(10) || '{\"sql\":\"q\"}') AS hash FROM reg_edges GROUP BY id, version")
def m1(spark, d):
    ins = F.array_sort(F.collect_list(F.struct("input_uri", "input_version")))
    texts = F.array_join(F.transform(ins, lambda x: F.concat(x["input_uri"], F.lit(":"), x["input_version"])), "\n")
    return X.edges(spark, d).groupBy("id", "version").agg(F.sha2(F.concat(texts, F.lit('\n{"sql":"q"}')), 256).alias("hash"))


@query("m2_scan_provenance", "SELECT o_custkey % 20 AS t, count(*) AS n, sha256('file:///wh#db.t' || (o_custkey % 20) || '@' || CAST(max(year(o_orderdate)) AS VARCHAR) || chr(10) || 'o_orderkey,o_totalprice' || chr(10) || 'nofilter') AS hash FROM orders GROUP BY 1")
def m2(spark, d):
    from tidewell.functions.columns import filter_fingerprint, provenance

    k = F.col("o_custkey") % 20
    out = table(spark, d, "orders").groupBy(k.alias("t")).agg(F.count("*").alias("n"), F.max(F.year("o_orderdate")).alias("y"))
    source = F.concat(F.lit("file:///wh#db.t"), F.col("t").cast("string"), F.lit("@"), F.col("y").cast("string"))
    return out.select("t", "n", provenance([source, F.lit("o_orderkey,o_totalprice")], F.lit(filter_fingerprint([]))).alias("hash"))


@query("m3_resolve_inputs", w(V, E, CUR) + "SELECT e.id, e.version, e.input_uri, coalesce(current, '<unavailable>') AS current FROM reg_edges e LEFT JOIN cur USING (input_uri)")
def m3(spark, d):
    e = X.edges(spark, d)
    return e.join(R.current_inputs(e, X.versions(spark, d)), "input_uri", "left").select("id", "version", "input_uri", F.coalesce("current", F.lit("<unavailable>")).alias("current"))


_BEST = "best AS (SELECT provenance_hash, coalesce(tenant, '') AS tk, arg_max({'id': id, 'version': version}, (created_at, id, version)) AS b FROM reg_versions WHERE state = 'ready' GROUP BY 1, 2)"


@query("m4_lookup", w(V, Q, _BEST) + "SELECT request_id, b.id AS id, b.version AS version FROM reg_requests r LEFT JOIN best ON r.provenance_hash = best.provenance_hash AND coalesce(r.tenant, '') = tk")
def m4(spark, d):
    return R.find_by_provenance(X.versions(spark, d), X.requests(spark, d))


@query("m7_settle_duplicates", w(V) + "SELECT id, version, CASE WHEN state = 'ready' AND row_number() OVER (PARTITION BY provenance_hash, coalesce(tenant, ''), state ORDER BY created_at, id, version) > 1 THEN 'failed' ELSE state END AS state FROM reg_versions")
def m7(spark, d):
    return R.settle_duplicates(X.versions(spark, d))


@query("m9_set_names", w(V, N) + """, ch AS (SELECT 'n' || custkey AS name, id AS artifact_id, version, TIMESTAMP '2030-01-01' AS updated_at, coalesce(tenant, '') AS tenant FROM reg_versions WHERE version = 1 AND state = 'ready'),
 b AS (SELECT * FROM reg_names UNION ALL SELECT * FROM ch) SELECT name, arg_max(artifact_id, (updated_at, version)) AS artifact_id, arg_max(version, (updated_at, version)) AS version, max(updated_at) AS updated_at, tenant FROM b GROUP BY name, tenant""".replace(", ch AS", ", ch AS", 1))
def m9(spark, d):
    v = X.versions(spark, d)
    changes = v.where("version = 1").select(F.concat(F.lit("n"), F.col("custkey").cast("string")).alias("name"), F.col("id").alias("artifact_id"), "version", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"), R.tenant_key().alias("tenant"))
    return R.upsert_names(X.names(spark, d), changes, v)


@query("m10_name_of_version", w(V, N) + "SELECT v.id, v.version, min(name) AS name FROM reg_versions v LEFT JOIN reg_names n ON v.id = n.artifact_id AND v.version = n.version GROUP BY v.id, v.version")
def m10(spark, d):
    n = X.names(spark, d).groupBy(F.col("artifact_id").alias("id"), "version").agg(F.min("name").alias("name"))
    return X.versions(spark, d).select("id", "version").join(n, ["id", "version"], "left")


_STATUS = """st AS (SELECT n.tenant, n.name, count(*) FILTER (e.input_uri IS NOT NULL AND coalesce(current, '<unavailable>') <> e.input_version) AS changed,
 string_agg(CASE WHEN coalesce(current, '<unavailable>') <> e.input_version THEN e.input_uri || ': ' || e.input_version || ' -> ' || coalesce(current, '<unavailable>') END, ', ' ORDER BY e.input_uri || ': ' || e.input_version) AS texts
 FROM reg_names n LEFT JOIN reg_edges e ON n.artifact_id = e.id AND n.version = e.version LEFT JOIN cur ON e.input_uri = cur.input_uri GROUP BY n.tenant, n.name)"""


@query("m11_name_status", w(V, N, E, CUR, _STATUS) + "SELECT tenant, name, changed > 0 AS is_stale, changed, CASE WHEN changed > 0 THEN 'Rebuild needed: ' || texts END AS reason FROM st")
def m11(spark, d):
    return R.name_status(X.names(spark, d), X.edges(spark, d), X.versions(spark, d))


@query("m12_explain", w(V, N, E, CUR, Q, _BEST, _STATUS) + """SELECT request_id, b IS NOT NULL AS would_hit, b IS NULL AS would_build, CASE WHEN b IS NOT NULL THEN 'artifact://' || b.id || '@v=' || b.version END AS uri,
 b IS NULL AND coalesce(st.changed > 0, false) AS is_stale, CASE WHEN b IS NULL AND st.changed > 0 THEN 'Rebuild needed: ' || texts END AS reason
 FROM reg_requests r LEFT JOIN best ON r.provenance_hash = best.provenance_hash AND coalesce(r.tenant, '') = tk LEFT JOIN st ON coalesce(r.tenant, '') = st.tenant AND r.name = st.name""")
def m12(spark, d):
    return R.explain(X.requests(spark, d), X.versions(spark, d), X.names(spark, d), X.edges(spark, d))


@query("m13_list", w(V, N) + "SELECT id, version, created_at FROM reg_versions WHERE state = 'ready' AND (tenant = 't1' OR tenant IS NULL) AND (id, version) IN (SELECT artifact_id, version FROM reg_names WHERE starts_with(name, 'n1')) ORDER BY created_at DESC, id, version LIMIT 100")
def m13(spark, d):
    named = X.names(spark, d).where(F.col("name").startswith("n1")).select(F.col("artifact_id").alias("id"), "version").distinct()
    own = R.visible(X.versions(spark, d).where("state = 'ready'"), "t1")
    return R.page(own.join(named, ["id", "version"], "left_semi"), 100, 0).select("id", "version", "created_at")


@query("m14_latest_by_prefix", w(V) + "SELECT id, max(version) AS version FROM reg_versions WHERE state = 'ready' AND starts_with(id, 'a1') GROUP BY id")
def m14(spark, d):
    return R.latest(X.versions(spark, d).where((F.col("state") == "ready") & F.col("id").startswith("a1"))).select("id", "version")


_OLD = "(SELECT max(created_at) - INTERVAL 365 DAY FROM reg_versions)"


def _before(versions, days: int):
    """The versions with the time that many days before the newest of all."""
    newest = versions.agg((F.max("created_at") - F.make_dt_interval(F.lit(days))).alias("limit_ts"))
    return versions.crossJoin(newest)


@query("m15_garbage", w(V, N) + f"SELECT state, count(*) AS n, CAST(sum(byte_size) AS BIGINT) AS bytes FROM reg_versions v WHERE state IN ('ready', 'failed') AND created_at < {_OLD} AND NOT EXISTS (SELECT 1 FROM reg_names n WHERE n.artifact_id = v.id AND n.version = v.version) GROUP BY state")
def m15(spark, d):
    return R.garbage(_before(X.versions(spark, d), 365), X.names(spark, d), F.col("limit_ts")).groupBy("state").agg(F.count("*").alias("n"), F.sum("byte_size").alias("bytes"))


@query("m16_clean_failed", w(V) + f"SELECT id, version, state FROM reg_versions WHERE NOT (state = 'failed' AND created_at < {_OLD})")
def m16(spark, d):
    return _before(X.versions(spark, d), 365).where(~((F.col("state") == "failed") & (F.col("created_at") < F.col("limit_ts")))).select("id", "version", "state")


@query("m17_info", w(V) + "SELECT 'artifact://' || id || '@v=' || version AS uri, state, row_count, byte_size, executor AS transform FROM reg_versions")
def m17(spark, d):
    spec = F.to_json(F.struct("executor"))
    return X.versions(spark, d).select(R.uri(F.col("id"), F.col("version")).alias("uri"), "state", "row_count", "byte_size", F.get_json_object(spec, "$.executor").alias("transform"))


@query("m20_cache_policy", """SELECT event_id, 'fingerprint' AS forever, 'session:' || (user_id % 3) AS session, 'ttl:' || CAST(floor(epoch(ts) / 900) AS BIGINT) AS ttl, 'snapshot:' || strftime(ts, '%Y%m%d') AS snapshot FROM events""")
def m20(spark, d):
    from tidewell.functions.columns import ttl_bucket

    c = F.concat
    return table(spark, d, "events").select("event_id", F.lit("fingerprint").alias("forever"), c(F.lit("session:"), (F.col("user_id") % 3).cast("string")).alias("session"), c(F.lit("ttl:"), ttl_bucket(F.col("ts"), 900).cast("string")).alias("ttl"), c(F.lit("snapshot:"), F.date_format("ts", "yyyyMMdd")).alias("snapshot"))


@query("m21_query_provenance", "SELECT o_orderkey, sha256('select * from t where k = :k' || chr(10) || 'int:' || o_custkey || chr(10) || 'conn' || chr(10) || o_orderpriority) AS hash FROM orders")
def m21(spark, d):
    from tidewell.functions.columns import provenance, tagged

    text = F.trim(F.regexp_replace(F.lit("select  *\n from t where k = :k "), r"\s+", " "))
    return table(spark, d, "orders").select("o_orderkey", provenance([text, tagged(F.col("o_custkey"), "int"), F.lit("conn")], F.col("o_orderpriority")).alias("hash"))


@query("m22_cell_provenance", w(V) + "SELECT id, version, sha256(sha256(provenance_hash || chr(10) || sha256(executor) || chr(10) || 'env') || ':x') AS hash FROM reg_versions")
def m22(spark, d):
    from tidewell.functions.columns import provenance

    own = provenance([F.col("provenance_hash"), F.sha2("executor", 256)], F.lit("env"))
    return X.versions(spark, d).select("id", "version", F.sha2(F.concat(own, F.lit(":x")), 256).alias("hash"))


def _rank_sql(rounds: int = 30) -> str:
    """The rounds one by one, and the first of them that moves by less than 1e-4."""
    parts = ["n AS (SELECT count(*) AS n FROM nodes)", "o AS (SELECT src, count(*) AS o FROM links GROUP BY src)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n)"]
    for k in range(1, rounds + 1):
        parts.append(f"g{k} AS (SELECT dst AS node, sum(rank / o) AS got FROM r{k - 1} JOIN links ON node = links.src JOIN o ON o.src = links.src GROUP BY dst)")
        parts.append(f"r{k} AS MATERIALIZED (SELECT nodes.node, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes LEFT JOIN g{k} USING (node), n)")
    moved = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.rank - b.rank)) AS moved FROM r{k - 1} a JOIN r{k} b USING (node)" for k in range(1, rounds + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in range(1, rounds + 1))
    parts.append(f"stop AS MATERIALIZED (SELECT coalesce(min(k) FILTER (moved < 1e-4), {rounds}) AS k FROM ({moved}))")
    return w(GRAPH, *parts) + f"SELECT node, round(rank, 8) AS rank, k AS iterations FROM ({ranks}) JOIN stop USING (k)"


@query("m23_iterate", _rank_sql())
def m23(spark, d):
    """Rank of the steps of the graph, iterated until it moves by less than 1e-4 in sum."""
    nodes, links = stored(X.nodes(spark, d).select("node"), "nodes"), stored(X.links(spark, d), "links")
    out_degree = links.groupBy("src").agg(F.count("*").alias("out"))
    n = nodes.count()
    shared = stored(links.join(out_degree, "src"), "shared")

    def step(carry):
        given = carry.join(shared, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        return nodes.join(given, "node", "left").select("node", (0.15 / n + 0.85 * F.coalesce("got", F.lit(0.0))).alias("rank"))

    def settled(a, b):
        moved = a.join(b.withColumnRenamed("rank", "r2"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("r2"))).alias("m")).first()["m"]
        return (moved or 0.0) < 1e-4

    out, k = G.iterate(nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), step, settled, 30)
    return out.select("node", F.round("rank", 8).alias("rank"), F.lit(k).alias("iterations"))


@query("m24_list_iterations", w(V) + "SELECT split_part(id, '@iter=', 1) AS base, CAST(split_part(id, '@iter=', 2) AS BIGINT) AS k, max(version) AS version FROM (SELECT 'loop' || (custkey % 10) || '@iter=' || version AS id, orderkey AS version, state FROM reg_versions WHERE state = 'ready') GROUP BY 1, 2")
def m24(spark, d):
    v = X.versions(spark, d).where("state = 'ready'")
    own = v.select(F.concat(F.lit("loop"), (F.col("custkey") % 10).cast("string"), F.lit("@iter="), F.col("version").cast("string")).alias("id"), F.col("orderkey").alias("version"))
    k = F.regexp_extract("id", r"^(.*)@iter=(\d+)$", 2).cast("long")
    return own.groupBy(F.regexp_extract("id", r"^(.*)@iter=(\d+)$", 1).alias("base"), k.alias("k")).agg(F.max("version").alias("version"))


# ---------------------------------------------------------------- 2.11
_REF = "ref AS (SELECT regexp_extract(input_version, '^(.+)@v=(\\d+)$', 1) || '@v=' || regexp_extract(input_version, '^(.+)@v=(\\d+)$', 2) AS src, id || '@v=' || version AS dst FROM reg_edges WHERE starts_with(input_uri, 'artifact://'))"


def artifact_links(spark, d):
    e = X.edges(spark, d).where(F.col("input_uri").startswith(R.OWN))
    return e.select(F.col("input_version").alias("src"), F.concat("id", F.lit("@v="), F.col("version").cast("string")).alias("dst"))


def newest_root(spark, d):
    v = X.versions(spark, d)
    top = v.agg(F.max(F.struct("custkey", "version")).alias("m")).select("m.*")
    return top.select(F.concat(F.lit("a"), F.col("custkey").cast("string"), F.lit("@v="), F.col("version").cast("string")).alias("node"))


_ROOT = "root AS (SELECT arg_max(id || '@v=' || version, (custkey, version)) AS node FROM reg_versions)"


@query("g1_lineage", w(V, E, _REF, _ROOT, "walk(node, depth) AS (SELECT node, 0 FROM root UNION SELECT src, depth + 1 FROM walk JOIN ref ON dst = node WHERE depth < 6)") + "SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node")
def g1(spark, d):
    return G.lineage(artifact_links(spark, d), newest_root(spark, d), 6)[0]


@query("g2_dependents", w(V, E, _REF) + "SELECT src, count(*) AS n, min(dst) AS first FROM ref JOIN reg_versions v ON v.id || '@v=' || v.version = dst WHERE state = 'ready' GROUP BY src")
def g2(spark, d):
    ready = X.versions(spark, d).where("state = 'ready'").select(F.concat("id", F.lit("@v="), F.col("version").cast("string")).alias("dst"))
    return artifact_links(spark, d).join(ready, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("first"))


@query("g3_artifact_reference", w(V, E) + "SELECT id, version, input_version, CASE WHEN regexp_matches(input_version, '^.+@v=\\d+$') THEN regexp_extract(input_version, '^(.+)@v=(\\d+)$', 1) END AS ref_id, CASE WHEN regexp_matches(input_version, '^.+@v=\\d+$') THEN CAST(regexp_extract(input_version, '^(.+)@v=(\\d+)$', 2) AS BIGINT) END AS ref_version FROM reg_edges")
def g3(spark, d):
    r = R.artifact_reference(F.col("input_version"))
    return X.edges(spark, d).select("id", "version", "input_version", r["id"].alias("ref_id"), r["version"].alias("ref_version"))


_DAG = "dag AS (SELECT DISTINCT (SELECT max(p.pos) FROM cells p WHERE p.defines = c.refs AND p.pos < c.pos) AS src, c.pos AS dst, c.refs AS variable FROM cells c WHERE c.refs IS NOT NULL)"


def cell_edges(cells):
    refs = cells.where("refs IS NOT NULL").select("pos", F.col("refs").alias("variable"))
    made = REL.as_of_position(refs, cells.select("pos", F.col("defines").alias("variable")))
    return made.select(F.col("producer").alias("src"), F.col("pos").alias("dst"), "variable")


@query("j10_position_as_of", w(CELLS, _DAG) + "SELECT dst AS pos, variable, src AS producer FROM dag WHERE src IS NOT NULL")
def j10(spark, d):
    return cell_edges(X.cells(spark, d)).select(F.col("dst").alias("pos"), "variable", F.col("src").alias("producer"))


@query("g4_variable_edges", w(CELLS, _DAG) + "SELECT src, dst, variable FROM dag WHERE src IS NOT NULL UNION SELECT pos - 1, pos, '' FROM cells WHERE pos % 10 = 0 AND pos - 1 IN (SELECT pos FROM cells)")
def g4(spark, d):
    c = X.cells(spark, d)
    after = c.where("pos % 10 = 0").select((F.col("pos") - 1).alias("src"), F.col("pos").alias("dst"), F.lit("").alias("variable"))
    return cell_edges(c).unionByName(after.join(c.select(F.col("pos").alias("src")), "src", "left_semi")).where("src <> dst").distinct()


@query("g5_shadowing", w(CELLS) + "SELECT variable, pos, before FROM (SELECT defines AS variable, pos, lag(pos) OVER (PARTITION BY defines ORDER BY pos) AS before FROM cells) WHERE before IS NOT NULL")
def g5(spark, d):
    before = F.lag("pos").over(W.partitionBy("defines").orderBy("pos"))
    return X.cells(spark, d).select(F.col("defines").alias("variable"), "pos", before.alias("before")).where("before IS NOT NULL")


@query("g6_roots_leaves", w(GRAPH) + "SELECT node, node NOT IN (SELECT dst FROM links) AS is_root, node NOT IN (SELECT src FROM links) AS is_leaf, (SELECT count(*) FROM links WHERE src = node) AS consumers FROM nodes")
def g6(spark, d):
    links = X.links(spark, d)
    ins, outs = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    out = X.nodes(spark, d).select("node").join(ins, "node", "left").join(outs, "node", "left")
    return out.select("node", F.col("i").isNull().alias("is_root"), F.col("o").isNull().alias("is_leaf"), F.coalesce("o", F.lit(0)).cast("long").alias("consumers"))


@query("g7_levels", w(GRAPH, "ways AS (SELECT * FROM links WHERE src <> dst)", "walk(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM ways) UNION SELECT dst, level + 1 FROM walk JOIN ways ON src = node)") + "SELECT node, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY node")
def g7(spark, d):
    return G.levels(X.nodes(spark, d), X.links(spark, d).where("src <> dst"))[0]


# the links go from smaller or equal nodes, so the graph as it is has no other cycles than links from a node to itself
@query("g8_cycles", w(GRAPH, "r(node) AS (SELECT min(node) FROM nodes UNION SELECT dst FROM r JOIN links ON src = node)", "s(node) AS (SELECT src FROM links WHERE src = dst UNION SELECT dst FROM s JOIN links ON src = node)") + """SELECT 'as it is' AS graph, (SELECT count(*) FROM s) AS stuck
 UNION ALL SELECT 'with a cycle', (SELECT count(*) FROM (SELECT node FROM s UNION SELECT node FROM r WHERE (SELECT max(node) FROM nodes) IN (SELECT node FROM r)))""")
def g8(spark, d):
    """Nodes on or behind a cycle, for the graph as it is and with one edge turned back to the first node."""
    nodes, links = X.nodes(spark, d), X.links(spark, d)
    back = nodes.agg(F.max("node").alias("src"), F.min("node").alias("dst"))
    whole = G.levels(nodes, links)[1].agg(F.lit("as it is").alias("graph"), F.count("*").alias("stuck"))
    turned = G.levels(nodes, links.unionByName(back))[1].agg(F.lit("with a cycle").alias("graph"), F.count("*").alias("stuck"))
    return whole.unionByName(turned)


_REACHED = "reached(a, b) AS (SELECT src, dst FROM rings UNION SELECT a, dst FROM reached JOIN rings ON src = b)"
_PARTS = "parts AS (SELECT r.a AS node, min(r.b) AS component FROM reached r JOIN reached s ON s.a = r.b AND s.b = r.a GROUP BY 1)"


@query("g8_components", w(X.RINGS, _REACHED, _PARTS) + "SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM parts")
def g8b(spark, d):
    """The nodes that stand on cycles, by strongly connected component."""
    parts = G.strong_components(X.rings(spark, d))
    return parts.join(parts.groupBy("component").agg(F.count("*").alias("size")).hint("merge"), "component").select("node", "component", "size")


@query("g8_shortest_cycles", w(X.RINGS, _REACHED, _PARTS, "inside AS (SELECT src, dst, p.component FROM rings JOIN parts p ON p.node = src JOIN parts q ON q.node = dst AND q.component = p.component)",
       "walk(component, node, path) AS (SELECT component, component, [component] FROM (SELECT DISTINCT component FROM parts) UNION ALL SELECT walk.component, dst, list_append(path, dst) FROM walk JOIN inside ON src = node AND inside.component = walk.component WHERE NOT list_contains(path, dst))",
       "closed AS (SELECT walk.component, path, len(path) AS n FROM walk JOIN inside ON src = node AND dst = walk.component)")
       + "SELECT component, CAST(min(n) AS INTEGER) AS length, arg_min(array_to_string(path, '>'), (n, path)) AS cycle FROM closed GROUP BY component")
def g8c(spark, d):
    """A shortest cycle through the smallest node of each component."""
    e = X.rings(spark, d)
    return G.shortest_cycles(e, G.strong_components(e)).select("component", "length", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


_UP = "up(node, depth) AS (SELECT max(node), 0 FROM nodes UNION SELECT src, 1 FROM up JOIN links ON dst = node)"


@query("g9_cascade", w(GRAPH, _UP) + "SELECT n.node, CASE WHEN n.node = (SELECT max(node) FROM nodes) THEN 'target' WHEN status = 'stale' THEN 'stale' ELSE 'missing' END AS reason, status = 'ready' AS skip, ms FROM nodes n WHERE node IN (SELECT node FROM up)")
def g9(spark, d):
    nodes = X.nodes(spark, d)
    return G.cascade(nodes, X.links(spark, d), nodes.agg(F.max("node").alias("node")))


@query("g10_downstream", w(GRAPH, "down(node) AS (SELECT CAST(3 AS BIGINT) UNION SELECT dst FROM down JOIN links ON src = node)") + "SELECT n.node FROM nodes n WHERE node IN (SELECT node FROM down) AND node <> 3 AND status = 'ready'")
def g10(spark, d):
    nodes = X.nodes(spark, d)
    return G.reachable(X.links(spark, d), nodes.where("node = 3")).where("node <> 3").join(nodes.where("status = 'ready'"), "node").select("node")


_STALE = "down(node) AS (SELECT node FROM nodes WHERE node % 97 = 0 UNION SELECT dst FROM down JOIN links ON src = node)"


@query("g11_staleness", w(GRAPH, _STALE) + "SELECT node, node IN (SELECT node FROM down) AS is_stale FROM nodes")
def g11(spark, d):
    nodes = X.nodes(spark, d)
    return G.stale_closure(nodes.select("node"), X.links(spark, d), nodes.where("node % 97 = 0"))


# each event follows the one before it of the same user, so the links are long chains
@query("g11_chains", "SELECT event_id AS node, bool_or(event_type = 'error' AND value > 25) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS is_stale FROM events")
def g11b(spark, d):
    """Staleness along the chain of each user's events, from errors of a large value."""
    e = table(spark, d, "events").select(F.col("event_id").alias("node"), "user_id", "ts", "event_type", "value")
    before = F.lag("node").over(W.partitionBy("user_id").orderBy("ts", "node"))
    return G.stale_closure(e.select("node"), e.select(before.alias("src"), F.col("node").alias("dst")), e.where("event_type = 'error' AND value > 25"))


@query("g12_cause", w(GRAPH, _STALE) + "SELECT node, CASE WHEN EXISTS (SELECT 1 FROM links WHERE dst = n.node AND src IN (SELECT node FROM down)) THEN 'input_changed' WHEN node % 2 = 0 THEN 'env_changed' ELSE 'source_changed' END AS cause FROM nodes n WHERE node IN (SELECT node FROM down)")
def g12(spark, d):
    nodes, links = X.nodes(spark, d), X.links(spark, d)
    stale = G.stale_closure(nodes.select("node"), links, nodes.where("node % 97 = 0"))
    return G.staleness_cause(stale.withColumns({"source_changed": F.col("node") % 2 != 0, "env_changed": F.col("node") % 2 == 0}), links)


# ---------------------------------------------------------------- 2.12
def acl_rules(spark):
    return spark.createDataFrame([("deny", "u3", None, "t1*"), ("deny", "*", "t2", "t1[05]"), ("allow", "*", None, "t?"), ("allow", "u1", "t1", "*")], "effect string, principal string, tenant string, glob string")


_TABLE = "'t' || (request_id % 20)"


@query("k1_acl", w(Q) + f"SELECT request_id, CASE WHEN (principal = 'u3' AND {_TABLE} GLOB 't1*') OR (tenant = 't2' AND {_TABLE} GLOB 't1[05]') THEN 'deny' WHEN {_TABLE} GLOB 't?' OR (principal = 'u1' AND tenant = 't1') THEN 'allow' ELSE 'deny' END AS verdict FROM reg_requests")
def k1(spark, d):
    r = X.requests(spark, d).withColumn("table_name", F.concat(F.lit("t"), (F.col("request_id") % 20).cast("string")))
    return R.acl_verdicts(r, acl_rules(spark))


@query("k2_scopes", w(Q) + "SELECT request_id, request_id % 9 = 0 OR request_id % 4 = 0 AS allowed FROM reg_requests")
def k2(spark, d):
    k = F.col("request_id")
    scopes = F.array_compact(F.array(F.when(k % 9 == 0, "admin:*"), F.when(k % 4 == 0, "read:t"), F.lit("list:t")))
    return X.requests(spark, d).select("request_id", (F.array_contains(scopes, "admin:*") | F.array_contains(scopes, "read:t")).alias("allowed"))


@query("k3_allow_list", w(V) + "SELECT orderkey AS request_id, CAST(CASE WHEN executor GLOB 'scan@*' THEN 1000 END AS BIGINT) AS max_rows, executor GLOB 'scan@*' AS allowed FROM reg_versions")
def k3(spark, d):
    rules = spark.createDataFrame([(1, "scan@*", 1000), (2, "*can@v1", 5)], "position int, glob string, max_rows long")
    return R.allow_listed(X.versions(spark, d).select(F.col("orderkey").alias("request_id"), F.col("executor").alias("transform")), rules)


@query("k4_visibility", w(V) + "SELECT id, version FROM reg_versions WHERE tenant = 't3' OR tenant IS NULL")
def k4(spark, d):
    return R.visible(X.versions(spark, d), "t3").select("id", "version")
