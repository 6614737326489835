"""Projection, filters, joins, aggregates, windows, sorts, sets and scalar formulas over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import columns as C
from tidewell.operators import relational as R
from tidewell.plans.base import query
from tidewell.session import table
from tidewell.sources import scan as S

# The ordered topic rules of the examples here. Word edges are spelled out: engines differ on \b beside accents.
TOPICS = [("greeting", r"(^|[^a-zà-ÿ])(hello|dear)([^a-zà-ÿ]|$)"), ("license", r"licen[sc]e"), ("secret", r"(password|token|akia)"), ("article", r"(^|[^a-zà-ÿ])(the|and)([^a-zà-ÿ]|$)"), ("artikel", r"(^|[^a-zà-ÿ])(der|die|und)([^a-zà-ÿ]|$)")]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# ---------------------------------------------------------------- 2.2 projection, filters, predicates
@query("p1_projection", "SELECT l_shipdate, l_orderkey, l_quantity FROM lineitem")
def p1(spark, d):
    return S.scan(t(spark, d, "lineitem"), ["l_shipdate", "l_orderkey", "l_quantity"])


for _name, _op in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    query(f"p2_{_name}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op.replace('!=', '<>')} 25")(
        lambda spark, d, op=_op: S.scan(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], [("l_quantity", op, 25.0)])
    )


_F1 = "substr(md5('l_discount <= float:0.05|l_quantity > float:10.0'), 1, 16)"


@query("p3_filter_fingerprint", f"SELECT count(*) AS n, {_F1} AS f1, {_F1} AS f2, 'nofilter' AS f0 FROM lineitem WHERE l_quantity > 10 AND l_discount <= 0.05")
def p3(spark, d):
    """The rows that each filter set selects, under the set's fingerprint; the order of filters doesn't matter."""
    a = [("l_quantity", ">", 10.0), ("l_discount", "<=", 0.05)]
    return t(spark, d, "lineitem").agg(F.count_if(C.conjunction(a)).alias("n"), F.lit(C.filter_fingerprint(a)).alias("f1"), F.lit(C.filter_fingerprint(a[::-1])).alias("f2"), F.lit(C.filter_fingerprint([])).alias("f0"))


@query("p4_typed_literals", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' AND o_orderstatus = 'O' AND o_custkey > 10")
def p4(spark, d):
    from datetime import datetime

    flt = [("o_orderdate", ">=", datetime(1995, 1, 1)), ("o_orderdate", "<", datetime(1996, 7, 1)), ("o_orderstatus", "=", "O"), ("o_custkey", ">", 10)]
    return S.scan(t(spark, d, "orders"), ["o_orderkey", "o_orderdate"], flt)


@query("p5_bind_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000.0 AND o_orderstatus = 'F'")
def p5(spark, d):
    sql = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status"
    return S.sql_over(spark, sql, {"least": 150000.0, "status": "F"}, orders=t(spark, d, "orders"))


@query("p6_compound_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 AND l_extendedprice > 30000 AND (l_returnflag = 'R' OR l_discount > 0.05)")
def p6(spark, d):
    c = F.col
    return t(spark, d, "lineitem").where((c("l_quantity") > 20) & (c("l_extendedprice") > 30000) & ((c("l_returnflag") == "R") | (c("l_discount") > 0.05))).select("l_orderkey", "l_linenumber")


@query("p7_computed_columns", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS revenue, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem")
def p7(spark, d):
    out = t(spark, d, "lineitem").withColumns({"revenue": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6), "month": F.date_format("l_shipdate", "yyyy-MM")})
    return out.select("l_orderkey", "l_linenumber", "revenue", "month")


@query("p8_drop_nulls", "SELECT count(*) AS rows, count(*) FILTER (quality IS NULL) AS dropped, count(*) FILTER (quality IS NOT NULL) AS kept FROM documents LEFT JOIN labels USING (doc_id)")
def p8(spark, d):
    joined = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    return R.drop_null_counts(joined, ["quality", "toxic"])


@query("p9_allow_list", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def p9(spark, d):
    return t(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("p10_value_mapping", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS status_code FROM orders")
def p10(spark, d):
    return t(spark, d, "orders").select("o_orderkey", R.mapped(F.col("o_orderstatus"), {"F": 0, "O": 1}).alias("status_code"))


_CASES = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{label}'" for label, p in TOPICS)


@query("p11_topic_rules", f"SELECT doc_id, CASE {_CASES} ELSE 'other' END AS topic FROM documents")
def p11(spark, d):
    return t(spark, d, "documents").select("doc_id", C.first_rule(F.col("text"), TOPICS, "other").alias("topic"))


@query("p12_glob", "SELECT p_partkey, p_brand GLOB 'Brand#[12]?' AS brand_hit, p_type GLOB '*A*' AS type_hit FROM part")
def p12(spark, d):
    return t(spark, d, "part").select("p_partkey", C.glob_match(F.col("p_brand"), "Brand#[12]?").alias("brand_hit"), C.glob_match(F.col("p_type"), "*A*").alias("type_hit"))


@query("p13_preview", "SELECT s_suppkey, coalesce(CAST(s_name AS VARCHAR), '—') AS s_name, (SELECT count(*) FROM supplier) AS rows, 4 AS columns FROM supplier ORDER BY s_suppkey LIMIT 5")
def p13(spark, d):
    df = t(spark, d, "supplier")
    return R.preview(df, ["s_suppkey"], 5).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "rows", "columns")


@query("p14_table_fingerprint", "SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 1000 = 1) > 0 AS changed, false AS changed_by_order FROM orders")
def p14(spark, d):
    """Whether the digest of a table tells that some rows were edited, and that they only came in another order."""
    before = t(spark, d, "orders")
    after = before.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    moved = before.repartition(7, F.xxhash64("o_orderdate"))
    digest = lambda df, label: R.fingerprint(df, label).select("rows", F.struct("rows", "xor", "sum").alias(label))
    all_ = digest(before, "a").crossJoin(digest(after, "b").drop("rows")).crossJoin(digest(moved, "c").drop("rows"))
    return all_.select("rows", (F.col("a") != F.col("b")).alias("changed"), (F.col("a") != F.col("c")).alias("changed_by_order"))


@query("p15_budgeted_rows", """
WITH r AS (SELECT doc_id, source, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents)
SELECT source, CAST(count(*) FILTER (run <= 50000) AS BIGINT) AS kept, CAST(count(*) FILTER (run > 50000) AS BIGINT) AS dropped, CAST(coalesce(max(run) FILTER (run <= 50000), 0) AS BIGINT) AS used FROM r GROUP BY source""")
def p15(spark, d):
    return R.within_budget(t(spark, d, "documents"), "source", "doc_id", F.col("n_chars") + 1, 50_000)


# ---------------------------------------------------------------- 2.3 joins
@query("j1_inner_join", "SELECT c_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")
def j1(spark, d):
    o, c = t(spark, d, "orders").select("o_custkey", "o_totalprice"), t(spark, d, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j2_using", "SELECT o_orderkey, c_name, o_totalprice FROM (SELECT o_custkey AS k, * FROM orders) JOIN (SELECT c_custkey AS k, c_name FROM customer) USING (k) ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def j2(spark, d):
    o, c = t(spark, d, "orders").withColumnRenamed("o_custkey", "k"), t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return o.join(c, "k").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "c_name", "o_totalprice")


@query("j3_using_two_keys", "SELECT l_orderkey, l_linenumber, round(a.l_quantity * b.l_discount, 4) AS x FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber)")
def j3(spark, d):
    a = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("l_discount"), 4).alias("x"))


@query("j4_left_join_groups", "SELECT c_mktsegment, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def j4(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("s"))
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    out = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment")
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orders"), F.count_distinct("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 2).alias("total"))


@query("j5_lookup", "SELECT r_name, n_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
def j5(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"))
    out = n.join(r, n.n_regionkey == r.r_regionkey).join(c, n.n_nationkey == c.c_nationkey, "left")
    return out.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))


@query("j6_anti_join", "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def j6(spark, d):
    """Customers without an order of over 400,000."""
    return R.unmatched(t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query("j7_null_safe_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END, -1) FROM orders)")
def j7(spark, d):
    o = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k"))
    return R.unmatched(t(spark, d, "customer"), o, {"c_custkey": "k"}).select("c_custkey")


@query("j8_latest_per_key", "SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE (user_id, ts) IN (SELECT user_id, max(ts) FROM events GROUP BY user_id) GROUP BY user_id, ts")
def j8(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.ts", "m.event_id")


@query("j9_self_join", "SELECT a.o_custkey, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority = b.o_orderpriority GROUP BY a.o_custkey")
def j9(spark, d):
    a, b = t(spark, d, "orders").alias("a"), t(spark, d, "orders").alias("b")
    same = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & (F.col("a.o_orderpriority") == F.col("b.o_orderpriority"))
    return a.join(b, same).groupBy(F.col("a.o_custkey").alias("o_custkey")).agg(F.count("*").alias("pairs"))


@query("j11_scalar_subqueries", "SELECT (SELECT round(sum(o_totalprice), 2) FROM orders) AS orders_total, (SELECT CAST(count(*) AS BIGINT) FROM customer) AS customers")
def j11(spark, d):
    sql = "SELECT (SELECT round(sum(o_totalprice), 2) FROM {o}) AS orders_total, (SELECT count(*) FROM {c}) AS customers"
    return S.sql_over(spark, sql, o=t(spark, d, "orders"), c=t(spark, d, "customer"))


# ---------------------------------------------------------------- 2.4 aggregates
@query("a1_global", "SELECT count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM events")
def a1(spark, d):
    return t(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


@query("a2_group", "SELECT event_type, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY event_type")
def a2(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query("a3_two_keys", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS mean_price, count(*) AS n FROM lineitem GROUP BY ALL")
def a3(spark, d):
    out = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"), F.count("*").alias("n"))
    return out.orderBy("l_returnflag", "l_linestatus")


@query("a4_filter_group", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY event_type")
def a4(spark, d):
    return t(spark, d, "events").where("event_type <> 'purchase'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a5_mean_std", "SELECT p_brand, round(avg(p_size), 6) AS p_size_mean, round(stddev_samp(p_size), 6) AS p_size_std, round(avg(p_retailprice), 6) AS p_retailprice_mean, round(stddev_samp(p_retailprice), 6) AS p_retailprice_std FROM part GROUP BY p_brand")
def a5(spark, d):
    return R.mean_and_std(t(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"])


@query("a6_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a6(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("a7_conditional", "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS net, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_suppkey")
def a7(spark, d):
    net = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(net), 2).alias("net"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("a8_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def a8(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("a9_median", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def a9(spark, d):
    return R.medians(t(spark, d, "events"), ["event_type"], "value")


@query("a10_nearest_rank", "SELECT event_type, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95, round(quantile_disc(value, 0.99), 2) AS p99 FROM events GROUP BY event_type")
def a10(spark, d):
    return R.nearest_rank(t(spark, d, "events"), ["event_type"], "value")


@query("a11_floor_rank", """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, round(v[greatest(1, CAST(floor(len(v) * 0.5::DOUBLE) AS BIGINT))], 2) AS p50, round(v[greatest(1, CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT))], 2) AS p95, round(v[greatest(1, CAST(floor(len(v) * 0.99::DOUBLE) AS BIGINT))], 2) AS p99 FROM s""")
def a11(spark, d):
    return R.floor_rank(t(spark, d, "events"), ["event_type"], "value")


_LE = " ".join(f"WHEN v <= {b} THEN 'le_{b}ms'" for b in C.BOUNDS_LE)


@query("a12_histogram_le", f"""WITH b AS (SELECT unnest([{', '.join(f"'le_{b}ms'" for b in C.BOUNDS_LE)}, 'le_inf']) AS bucket), h AS (SELECT CASE {_LE} ELSE 'le_inf' END AS bucket, count(*) AS n FROM (SELECT floor(o_totalprice / 100) AS v FROM orders) GROUP BY 1)
SELECT b.bucket, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bucket)""")
def a12(spark, d):
    return R.histogram_le(t(spark, d, "orders").select(F.floor(F.col("o_totalprice") / 100).alias("v")), "v")


_LT = " ".join(f"WHEN v < {b} THEN {i}" for i, b in enumerate(C.BOUNDS_LT))
_A13 = f"SELECT event_type, CASE {_LT} ELSE 7 END AS i, v FROM (SELECT event_type, value * 10 AS v FROM events)"


@query("a13_histogram_lt", f"SELECT event_type, {', '.join(f'count(*) FILTER (i = {i}) AS b{i}' for i in range(8))}, count(*) AS n, round(sum(v), 2) AS sum_ms, round(sum(v) / count(*), 2) AS avg_ms, round(max(v), 2) AS max_ms FROM ({_A13}) GROUP BY event_type")
def a13(spark, d):
    return R.histogram_lt(t(spark, d, "events").select("event_type", (F.col("value") * 10).alias("v")), "event_type", "v")


@query("a14_bucket_percentiles", f"""WITH h AS (SELECT event_type, i, count(*) AS n FROM ({_A13}) GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY i) AS run, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, {', '.join(f"CAST([{', '.join(map(str, C.MIDPOINTS))}][min(i) FILTER (run >= CAST(floor(total * {p}::DOUBLE) AS BIGINT)) + 1] AS INTEGER) AS p{str(p)[2:].ljust(2, '0')}" for p in (0.5, 0.95, 0.99))} FROM c GROUP BY event_type""")
def a14(spark, d):
    return R.bucket_percentiles(t(spark, d, "events").select("event_type", (F.col("value") * 10).alias("v")), "event_type", "v")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("a15_pivot", "SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"round(sum(value) FILTER (event_type = '{x}'), 2) AS {x}" for x in _TYPES) + " FROM events GROUP BY 1")
def a15(spark, d):
    out = t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", _TYPES).agg(F.sum("value"))
    return out.select("day", *[F.round(x, 2).alias(x) for x in _TYPES])


@query("a16_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a16(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("a17_mean_rate", "SELECT lang, quality, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def a17(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.round(F.avg("toxic"), 6).alias("toxic_rate"))


@query("a18_null_counts", "WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), u AS (SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS nulls FROM j UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM j UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM j) SELECT * FROM u WHERE nulls > 0")
def a18(spark, d):
    return R.null_counts(t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left"))


@query("a19_month_rollup", "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean, max(o_totalprice) AS max, min(o_totalprice) AS min, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a19(spark, d):
    v = "o_totalprice"
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg(v), 2).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.round(F.sum(v), 2).alias("total"))


@query("a20_ratio_to_target", "SELECT r_name, round(sum(o_totalprice), 2) AS revenue, round(100 * sum(o_totalprice) / (1000000.0 * (r_regionkey + 1)), 2) AS percent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def a20(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = o.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "r_regionkey").agg(F.sum("s").alias("s"))
    return out.select("r_name", F.round("s", 2).alias("revenue"), F.round(100 * F.col("s") / (1000000.0 * (F.col("r_regionkey") + 1)), 2).alias("percent"))


@query("a21_summary", "SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS flagged, round(count(*) FILTER (toxic = 1) / count(*), 4) AS rate FROM labels")
def a21(spark, d):
    n, k = F.count("*"), F.count_if(F.col("toxic") == 1)
    return t(spark, d, "labels").agg(n.alias("total"), k.alias("flagged"), C.safe_ratio(k, n, 4).alias("rate"))


@query("a24_describe", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS max FROM orders")
def a24(spark, d):
    return R.describe(t(spark, d, "orders"), "o_totalprice")


# ---------------------------------------------------------------- 2.5 windows
@query("v1_stratified_sample", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def v1(spark, d):
    return R.top_per_group(t(spark, d, "events"), ["event_type"], [F.col("ts"), F.col("event_id")], 5).select("event_type", "event_id")


@query("v2_share_of_total", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM events GROUP BY event_type")
def v2(spark, d):
    return R.share_of_total(t(spark, d, "events"), "event_type")


@query("v3_best_row", "SELECT p_type, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def v3(spark, d):
    best = F.max_by(F.struct("p_brand", "p_partkey"), F.struct("p_retailprice", -F.col("p_partkey"))).alias("b")
    return t(spark, d, "part").groupBy("p_type").agg(best).select("p_type", "b.p_brand", "b.p_partkey")


# ---------------------------------------------------------------- 2.6 sort, limit
@query("l1_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def l1(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("l2_nulls_last", "SELECT c_custkey, sum_price FROM (SELECT c_custkey, round(sum(o_totalprice), 2) AS sum_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) ORDER BY sum_price DESC NULLS LAST, c_custkey")
def l2(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("sum_price"))
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "sum_price").orderBy(F.desc_nulls_last("sum_price"), "c_custkey")


@query("l4_hottest", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def l4(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("l5_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def l5(spark, d):
    return t(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")


@query("l6_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def l6(spark, d):
    return S.Scanner(t(spark, d, "orders"), ["o_orderkey", "o_custkey"]).head(10, ["o_orderkey"])


# ---------------------------------------------------------------- 2.7 sets
@query("u1_union_all", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def u1(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    return o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 3 = 0"))


@query("u2_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def u2(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u3_concatenate", "SELECT o_orderkey, o_totalprice FROM orders")
def u3(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.concatenate(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"))


# ---------------------------------------------------------------- 2.8 formulas
_ORDERS = "(SELECT l_suppkey AS portfolio, l_partkey AS ticker, CASE WHEN l_returnflag = 'N' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_shipdate AS ts, l_orderkey, l_linenumber FROM lineitem)"


def portfolio(spark, d) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("portfolio"), F.col("l_partkey").alias("ticker"), side.alias("side"), F.col("l_quantity").alias("qty"), price.alias("price"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber")


@query("f1_positions", f"SELECT portfolio, ticker, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty, round(coalesce(sum(CASE WHEN side = 'buy' THEN qty * price END) / nullif(sum(CASE WHEN side = 'buy' THEN qty END), 0), 0), 8) AS avg_cost FROM {_ORDERS} GROUP BY portfolio, ticker HAVING sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) <> 0")
def f1(spark, d):
    return R.positions(portfolio(spark, d))


@query("f2_realized", f"SELECT ticker, round(sum(CASE WHEN side = 'sell' THEN qty * price ELSE -qty * price END), 2) AS realized FROM {_ORDERS} GROUP BY ticker")
def f2(spark, d):
    return R.realized(portfolio(spark, d))


_MARKS = f"(SELECT ticker, arg_max(price, (ts, l_orderkey, l_linenumber)) AS mark FROM {_ORDERS} GROUP BY ticker)"


@query("f3_unrealized", f"WITH p AS (SELECT ticker, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty FROM {_ORDERS} GROUP BY ticker) SELECT ticker, qty, floor(qty * mark * 100) / 100 AS value FROM p LEFT JOIN {_MARKS} USING (ticker)")
def f3(spark, d):
    return R.marked(portfolio(spark, d))


@query("f4_adjusted_total", f"WITH p AS (SELECT ticker, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty FROM {_ORDERS} GROUP BY ticker), u AS (SELECT sum(qty * mark) AS u FROM p LEFT JOIN {_MARKS} USING (ticker)), r AS (SELECT sum(CASE WHEN side = 'sell' THEN qty * price ELSE -qty * price END) AS r, sum(qty * price * 0.0005 + CASE WHEN side = 'sell' THEN least(qty * 0.000166, 8.3) ELSE 0 END) AS c FROM {_ORDERS}) SELECT round(r + u - c, 0) AS total FROM u, r")
def f4(spark, d):
    return R.adjusted_total(portfolio(spark, d))


@query("f5_cost_ledger", "SELECT CAST(ts AS DATE) AS day, event_type AS source, round(sum(value), 2) AS cost FROM events WHERE CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) - 14 FROM events) GROUP BY 1, 2")
def f5(spark, d):
    e = t(spark, d, "events")
    last = e.agg(F.date_sub(F.to_date(F.max("ts")), 14).alias("after"))
    out = e.crossJoin(last).where(F.to_date("ts") > F.col("after"))
    return out.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("source")).agg(F.round(F.sum("value"), 2).alias("cost"))


@query("f6_trade_cost", f"SELECT l_orderkey, l_linenumber, round(qty * price * 0.0005 + CASE WHEN side = 'sell' THEN least(qty * 0.000166, 8.3) ELSE 0 END, 8) AS cost FROM {_ORDERS}")
def f6(spark, d):
    return portfolio(spark, d).select("l_orderkey", "l_linenumber", F.round(C.trade_cost(F.col("side"), F.col("qty"), F.col("price")), 8).alias("cost"))


@query("f7_token_cost", "SELECT conv_id, turn, round((length(text) // 4) * CASE role WHEN 'user' THEN 3.0 WHEN 'assistant' THEN 15.0 ELSE 5.0 END / 1000000, 8) AS cost FROM conversations")
def f7(spark, d):
    prices = spark.createDataFrame([("user", 3.0), ("assistant", 15.0)], "role string, rate double")
    return R.token_cost(t(spark, d, "conversations"), prices, 5.0)


@query("f8_slippage", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity * p_retailprice, 2) AS delta FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 0.001")
def f8(spark, d):
    delta = F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")
    out = t(spark, d, "lineitem").join(t(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return out.where(F.abs(delta) > 0.001).select("l_orderkey", "l_linenumber", F.round(delta, 2).alias("delta"))


@query("f9_short_id", "SELECT o_orderkey, substr(sha256(o_custkey || ':' || o_orderpriority), 1, 16) AS short_id FROM orders")
def f9(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.short_id(F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("short_id"))


@query("f10_tokens", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def f10(spark, d):
    return t(spark, d, "documents").select("doc_id", C.approximate_tokens(F.col("text")).alias("tokens"))


@query("f11_explode_allowed", "SELECT p_partkey, w AS word FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w IN ('STANDARD', 'SMALL', 'TIN', 'BRASS', 'STEEL', 'ECONOMY', 'PROMO')")
def f11(spark, d):
    words = t(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))
    return words.where(F.col("word").isin("STANDARD", "SMALL", "TIN", "BRASS", "STEEL", "ECONOMY", "PROMO"))


@query("f13_ttl_bucket", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def f13(spark, d):
    return t(spark, d, "events").groupBy(C.ttl_bucket(F.col("ts"), 3600).alias("bucket")).agg(F.count("*").alias("n"))


@query("f14_epoch_micros", "SELECT event_id, epoch_us(ts) AS micros, ts FROM events")
def f14(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t(spark, d, "events").select("event_id", micros.alias("micros"), F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"))


@query("f15_safe_ratio", "SELECT user_id, CASE WHEN count(*) FILTER (event_type <> 'signup') = 0 THEN 0 ELSE round(count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type <> 'signup'), 4) END AS rate FROM events GROUP BY user_id")
def f15(spark, d):
    k, n = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") != "signup")
    return t(spark, d, "events").groupBy("user_id").agg(C.safe_ratio(k, n, 4).alias("rate"))


@query("f16_json_map", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def f16(spark, d):
    return t(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("f17_canonical_json", "SELECT c_custkey, '{\"a\":\"' || c_name || '\",\"b\":\"' || c_mktsegment || '\"}' AS spec FROM customer")
def f17(spark, d):
    return t(spark, d, "customer").select("c_custkey", C.canonical_json(F.create_map(F.lit("b"), F.col("c_mktsegment"), F.lit("a"), F.col("c_name"))).alias("spec"))


@query("f18_tagged_values", "SELECT o_orderkey, 'int:' || o_orderkey AS a, 'str:' || o_orderkey AS b, 'str:' || o_orderstatus AS c FROM orders")
def f18(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", C.tagged(k, "int").alias("a"), C.tagged(k, "str").alias("b"), C.tagged(F.col("o_orderstatus"), "str").alias("c"))


@query("f19_json_errors", """SELECT event_id, list_filter([CASE WHEN n IS NULL THEN 'n: required' END, CASE WHEN n > 80 THEN 'n: above 80' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'event_type: not allowed' END], lambda x: x IS NOT NULL) AS errors
FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)""")
def f19(spark, d):
    from tidewell.functions.documents import json_errors

    rules = {"n": {"type": "long", "required": True, "maximum": 80}, "event_type": {"type": "string", "enum": ["click", "view", "purchase", "signup"]}}
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("n"), "event_type"))
    return t(spark, d, "events").select("event_id", json_errors(doc, rules).alias("errors"))


@query("f20_template", "SELECT conv_id, turn, 'Role ' || role || ': {{ missing }} (' || conv_id || ')' AS prompt FROM conversations")
def f20(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", C.render("Role {{ role }}: {{ missing }} ({{id}})", {"role": F.col("role"), "id": F.col("conv_id")}).alias("prompt"))
