"""Operators on small frames: boundaries, nulls, and rules that SQL doesn't check."""

import datetime as dt
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell import session
from tidewell.functions import columns as C
from tidewell.functions.documents import json_errors
from tidewell.operators import graph as G
from tidewell.operators import modelling as M
from tidewell.operators import registry as REG
from tidewell.operators import relational as R
from tidewell.operators import rollups as O
from tidewell.sources import artifacts as A
from tidewell.sources import scan as S
from tidewell.streaming import jobs


@pytest.mark.parametrize(
    ("op", "value", "low", "high", "keep"),
    [
        ("=", 5, 1, 10, True), ("=", 0, 1, 10, False), ("=", 1, 1, 10, True), ("=", 10, 1, 10, True), ("=", 11, 1, 10, False),
        ("!=", 5, 5, 5, False), ("!=", 5, 1, 10, True), ("<", 1, 1, 10, False), ("<", 2, 1, 10, True), ("<=", 1, 1, 10, True), ("<=", 0, 1, 10, False),
        (">", 10, 1, 10, False), (">", 9, 1, 10, True), (">=", 10, 1, 10, True), (">=", 11, 1, 10, False), ("=", 5, None, None, True), (">", 5, None, 3, False), ("<", 5, 7, None, False),
    ],
)
def test_pruning_truth_table(spark, op, value, low, high, keep):
    zones = spark.createDataFrame([(low, high)], "min_x int, max_x int")
    assert S.prune(zones, [("x", op, value)]).count() == int(keep)


def test_pruning_is_a_superset(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 101))
    zones = S.zone_map(df, F.floor(F.col("id") / 50), ["x"])
    for op, v in [("=", 3), ("<", 2), (">=", 99), ("!=", 5)]:
        hit = {r["z"] for r in S.scan(df, None, [("x", op, v)]).select(F.floor(F.col("id") / 50).alias("z")).distinct().collect()}
        assert hit <= {r["zone"] for r in S.prune(zones, [("x", op, v)]).collect()}


def test_scan_rejects_unknown_columns(spark):
    with pytest.raises(ValueError):
        S.scan(spark.range(3), None, [("nope", "=", 1)])


def test_scan_reaches_the_files(spark, sf):
    df = S.scan(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey"], [("l_quantity", ">", 40.0)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_binds_are_never_spliced(spark):
    df = spark.createDataFrame([("a",), ("x' OR '1'='1",)], "s string")
    assert S.sql_over(spark, "SELECT * FROM {df} WHERE s = :v", {"v": "x' OR '1'='1"}, df=df).count() == 1
    assert S.sql_over(spark, "SELECT * FROM {df} WHERE s = :v", {"v": None}, df=df).count() == 0
    with pytest.raises(ValueError):
        S.sql_over(spark, "SELECT * FROM {df} WHERE s = :v", {}, df=df)
    with pytest.raises(TypeError):
        S.sql_over(spark, "SELECT :v", {"v": object()})


def test_filter_fingerprint_order():
    a = [("x", "=", 1), ("y", "<", "2")]
    assert C.filter_fingerprint(a) == C.filter_fingerprint(a[::-1]) != C.filter_fingerprint([("x", "=", "1"), ("y", "<", "2")])
    assert C.filter_fingerprint([]) == "nofilter"


def test_snapshots(spark, tmp_path):
    df = spark.range(30).withColumn("b", (F.col("id") % 3).cast("int"))
    log = S.commit_batches(df, F.col("b"), [0, 1, 2], "t")
    assert S.read_snapshot(log, 0).count() == 10 and S.read_snapshot(log, 1).count() == 20 and S.read_snapshot(log).count() == 30
    with pytest.raises(ValueError):
        S.read_snapshot(log, 9)
    with pytest.raises(ValueError):
        S.read_snapshot(log.limit(0))
    assert S.difference(spark.range(3), spark.range(1, 5)).groupBy("change").count().orderBy("change").collect()[0]["count"] == 2


def test_concatenate_needs_equal_schemas(spark):
    with pytest.raises(ValueError):
        R.concatenate(spark.range(2), spark.range(2).select(F.col("id").cast("string").alias("id")))


def test_safe_ratio_and_buckets(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (None, 3)], "a int, b int").select(C.safe_ratio(F.col("a"), F.col("b"), 3).alias("r"))
    assert [r["r"] for r in df.collect()] == [0.0, 0.333, 0.0]
    b = spark.createDataFrame([(10,), (11,), (5000,), (5001,)], "v int").select(C.bucket_le(F.col("v")).alias("le"), C.bucket_lt(F.col("v")).alias("lt")).collect()
    assert [(r["le"], r["lt"]) for r in b] == [("le_10ms", 1), ("le_25ms", 1), ("le_5000ms", 7), ("le_inf", 7)]


def test_globs(spark):
    rows = [("a.b", "a.*"), ("axb", "a.*"), ("t15", "t1[05]"), ("t12", "t1[05]"), ("x+y", "x+?")]
    df = spark.createDataFrame(rows, "n string, g string").select(F.regexp_like("n", C.glob_regex(F.col("g"))).alias("m"))
    assert [r["m"] for r in df.collect()] == [True, False, True, False, True]


def test_json_errors(spark):
    rules = {"n": {"type": "int", "required": True, "minimum": 1, "maximum": 5}, "s": {"type": "string", "enum": ["a"]}}
    docs = ['{"n": 3, "s": "a"}', '{"n": 9, "s": "b"}', '{"s": "a"}', "not json", None, '{"n": "x"}']
    got = [r["e"] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(json_errors(F.col("d"), rules).alias("e")).collect()]
    assert got[0] == [] and got[1] == ["n: above 5", "s: not allowed"] and got[2] == ["n: required"]
    assert all(any(e.startswith("$") for e in got[i]) for i in (3, 4, 5))


def test_as_of_position(spark):
    p = spark.createDataFrame([("x", 1), ("x", 4), ("y", 2)], "variable string, pos long")
    r = spark.createDataFrame([("x", 1), ("x", 4), ("x", 5), ("y", 2), ("z", 9)], "variable string, pos long")
    assert {(x["pos"], x["producer"]) for x in R.as_of_position(r, p).collect()} == {(4, 1), (5, 4)}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src long, dst long")
    n = spark.range(1, 7).withColumnRenamed("id", "node")
    assert {r["node"]: r["depth"] for r in G.reach(e, n.where("node = 1")).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    done, stuck = G.levels(n, e)
    assert {r["node"]: r["level"] for r in done.collect()} == {1: 0, 6: 0, 2: 1, 3: 1, 4: 2, 5: 3} and stuck.count() == 0
    loop = e.unionByName(spark.createDataFrame([(5, 3)], "src long, dst long"))
    assert {r["node"] for r in G.levels(n, loop)[1].collect()} == {3, 4, 5}
    nodes, seen = G.lineage(e, n.where("node = 5"), 1)
    assert {r["node"] for r in nodes.collect()} == {5, 4} and {(r["src"], r["dst"]) for r in seen.collect()} == {(4, 5)}
    assert G.reach(e.limit(0), n.limit(0)).count() == 0


def test_strong_components_and_cycles(spark):
    rng = __import__("random").Random(5)
    for n, m in ((1, 0), (40, 55)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        e = spark.createDataFrame(sorted(edges), "src long, dst long")
        reach = {a: {b for a2, b in edges if a2 == a} for a in range(n)}
        for _ in range(n):
            reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
        want = {a: min(b for b in range(n) if b in reach[a] and a in reach[b]) for a in range(n) if a in reach[a]}
        parts = G.strong_components(e)
        assert {r["node"]: r["component"] for r in parts.collect()} == want
        for r in G.shortest_cycles(e, parts).collect():
            walk = r["cycle"]
            assert walk[0] == r["component"] and all(x in edges for x in zip(walk, walk[1:] + walk[:1])) and len(walk) == r["length"]
            assert r["length"] == shortest(edges, walk[0])


def shortest(edges, start):
    length, at = 0, {start}
    while True:
        length, at = length + 1, {b for a, b in edges if a in at}
        if start in at:
            return length


def test_rounds_of_graphs_send_no_table_through_the_driver(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **b))[1])
    before = [spark.conf.get(k, None) for k in session.BROADCAST]
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src long, dst long")
    assert {r["node"] for r in G.levels(spark.range(6).withColumnRenamed("id", "node"), e)[1].collect()} == {0, 1, 2, 3, 4}
    assert [tuple(r) for r in G.shortest_cycles(e, G.strong_components(e)).collect()] == [(0, 3, [0, 1, 2])]
    assert sum("Join" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
    assert [spark.conf.get(k, None) for k in session.BROADCAST] == before


def test_strong_components_of_a_long_chain(spark):
    """A chain that no trimming takes away at once: colours in a random order cut it into pieces."""
    e = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(30, 28), (0, 0)], "src long, dst long"))
    assert {(r["node"], r["component"]) for r in G.strong_components(e).collect()} == {(0, 0), (28, 28), (29, 28), (30, 28)}


def test_ancestors_by_doubling(spark, monkeypatch):
    """A chain of 10,000 versions in 14 rounds, and a branch beside it."""
    p = spark.range(10_000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent")).unionByName(spark.createDataFrame([(20_000, 7)], "node long, parent long"))
    rounds = []
    keep = G.stored
    monkeypatch.setattr(G, "stored", lambda df, label: (rounds.append(label), keep(df, label))[1])
    got = G.ancestors(p, spark.createDataFrame([(9_999,)], "node long"))
    assert got.count() == 10_000 and len([r for r in rounds if r == "reached"]) <= 16
    assert {r["node"] for r in G.ancestors(p, spark.createDataFrame([(20_000,)], "node long")).collect()} == {20_000, *range(8)}


def test_reachable_folds_chains(spark, monkeypatch):
    """10,000 versions in a chain, and 300 ways that part and meet again, take some tens of stored steps; the rows are those of
    the frontier rounds."""
    steps, keep = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, label: (steps.append(label), keep(df, label))[1])
    e = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["node"] for r in G.reachable(e, spark.createDataFrame([(9_000,)], "node long")).collect()} == set(range(9_000, 10_001))
    assert steps.count("jump") <= 17 and "frontier" not in steps
    steps.clear()
    k = F.col("id") * 3
    part = spark.range(300).select(F.explode(F.array(*[F.struct((k + a).alias("src"), (k + b).alias("dst")) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))])).alias("e")).select("e.src", "e.dst")
    assert {r["node"] for r in G.reachable(part, spark.createDataFrame([(300,)], "node long")).collect()} == set(range(300, 901))
    assert len(steps) < 30 and "frontier" not in steps


def test_reachable_against_python(spark):
    """Rings, rings with a root, seeds within chains and without a link, links to oneself, nulls, repeated roots."""
    rng = __import__("random").Random(11)
    for n, m, share in ((30, 34, 0.25), (30, 34, 0.0), (9, 0, 0.25)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1), (2, None)]
        edges += [(100, 101), (101, 102), (102, 100), (102, 103), (200, 201), (201, 200), (201, 202)]
        roots = [rng.randrange(n), rng.randrange(n), 201, 500]
        want = set(roots)
        while more := {b for a, b in edges if a in want and b is not None} - want:
            want |= more
        got = G.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(r,) for r in roots + roots], "node long"), share).collect()
        assert sorted(r["node"] for r in got) == sorted(want)


def test_manifest_difference_reads_what_differs(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("x"))
    log = S.commit_batches(df, F.floor(F.col("id") / 25).cast("int"), [0, 1, 2, 3], "snapshots")
    again = spark.range(50, 80).select("id", (F.col("id") % 3).alias("x"))
    again.coalesce(1).write.parquet(f"file://{tmp_path}/rewritten")
    log = log.unionByName(spark.createDataFrame([(7, 1, 9, f"file://{tmp_path}/rewritten")], "snapshot_id long, parent_id long, committed_at long, path string"))
    files = S.snapshot_files(log, 3)
    assert files.count() >= 4 and S.snapshot_files(log).count() < files.count()
    both = S.snapshot_files(log, 0)
    for r in both.collect():  # files that both have aren't opened: they needn't even be there
        os.unlink(r["path"].removeprefix("file:"))
    got = S.manifest_difference(log, 3, 7, df.schema)
    want = {(i, "removed") for i in range(80, 100)}
    assert {(r["id"], r["change"]) for r in got.collect()} == want
    got = S.manifest_difference(log, 7, 3, df.schema, ["id"])
    assert {(r["id"], r["change"]) for r in got.collect()} == {(i, "added") for i in range(80, 100)}
    assert S.manifest_difference(log, 3, 3, df.schema).count() == 0
    with pytest.raises(ValueError):
        S.snapshot_files(log, 99)


def test_running_total(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("i"), (F.col("id") % 13).alias("v"))
    rows = sorted(df.collect())
    total, want = 0, {}
    for r in rows:
        want[r["i"]] = total
        total += r["v"]
    assert {r["i"]: r["before"] for r in REG.running_total(df.repartition(7), ["k", "i"], "v").collect()} == want


def test_quota_never_exceeds(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, f"t{i % 3}", t + dt.timedelta(hours=i), 40 + i % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "build_id long, tenant string, created_at timestamp_ntz, bytes_out long")
    got = {r["build_id"]: r["accepted"] for r in O.accept_within_quota(df, 200).collect()}
    used = {}
    for i, tenant, at, size in rows:
        k = (tenant, at.date())
        fits = used.get(k, 0) + size <= 200
        assert got[i] == fits
        used[k] = used.get(k, 0) + (size if fits else 0)


def test_split_is_exact(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = M.stratified_split(df, "y", "id", 0.2).groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in got} == {(1, "test"): 333, (1, "train"): 1334, (0, "test"): 666, (0, "train"): 2667}
    assert M.stratified_split(df, "y", "id", 0.0).where("split = 'test'").count() == 0


def test_scoring_uses_the_cache(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "prompt string")
    cache = f"file://{tmp_path}/answers"
    spark.createDataFrame([("a", '{"s": "x"}')], "prompt string, answer string").select(F.sha2("prompt", 256).alias("prompt_hash"), "answer").write.parquet(cache)
    got = {r["answer"]: r["errors"] for r in M.score_texts(df, cache, lambda p: '{"s": "y"}' if p == "b" else "asked again", {"s": {"type": "string", "required": True, "enum": ["x", "z"]}}).collect()}
    assert got == {'{"s": "x"}': [], '{"s": "y"}': ["s: not allowed"]}

    def never(prompt):
        raise RuntimeError("asked again")

    assert M.score_texts(df, cache, never, {"s": {"type": "string"}}).count() == 2


def test_materialize(spark, tmp_path):
    s = A.ArtifactStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([("k", 1), ("k", 2)], "g string, v int")
    one = [("file:///w#t", "7", df)]
    a = s.materialize(one, "sql@v1", {"sql": "SELECT g, sum(v) AS s FROM input0 GROUP BY g"}, name="n")
    b = s.materialize(one, "sql@v1", {"sql": "SELECT g, sum(v) AS s FROM input0 GROUP BY g"})
    assert (a.hit, b.hit, a.uri == b.uri) == (False, True, True) and s.fetch("n").first()["s"] == 3
    c = s.materialize(one, "sql@v1", {"sql": "SELECT g, sum(v) AS s FROM input0 GROUP BY g"}, refresh=True)
    d = s.materialize([("file:///w#t", "8", df)], "sql@v1", {"sql": "SELECT g, sum(v) AS s FROM input0 GROUP BY g"})
    assert len({a.uri, c.uri, d.uri}) == 3
    assert s.materialize(one, "sql@v1", {"sql": "SELECT g, sum(v) AS s FROM input0 GROUP BY g"}, tenant="t").hit is False
    s.delete_name("n")
    with pytest.raises(KeyError):
        s.fetch("n")
    with pytest.raises(ValueError):
        s.set_name("m", a.id, 99)
    with pytest.raises(Exception):
        s.put(df.select(F.raise_error(F.lit("no")).alias("x")), "f" * 64)
    assert s.versions().where("state = 'failed'").count() == 1
    for bad in [("nope@v1", {}), ("sql@v1", {}), ("sql@v1", {"sql": 3}), ("sql@v1", {"sql": " "})]:
        with pytest.raises((KeyError, ValueError, TypeError)):
            A.run_transform(bad[0], [df], bad[1])
    t2 = s.put(df, "2" * 64, tenant="t2", name="mine")
    assert s.fetch(t2.uri, "t2").count() == s.fetch("mine", "t2").count() == 2
    with pytest.raises(PermissionError):
        s.fetch(t2.uri, "t1")
    with pytest.raises(KeyError):
        s.fetch("mine", "t1")
    building = s.begin("3" * 64)
    with pytest.raises(KeyError):
        s.fetch(f"artifact://{building[0]}@v={building[1]}")
    assert not s.delete(t2.id, t2.version, "t1") and s.delete(t2.id, t2.version, "t2") and not s.delete(t2.id, t2.version)
    with pytest.raises(KeyError):
        s.fetch("mine", "t2")
    before = sorted(map(str, s.versions().collect()))
    s.compact()
    s.put(df, "4" * 64, name="later")
    assert set(before) < set(map(str, s.versions().collect())) and s.fetch("later").count() == 2
    assert A.provenance_hash([("a", "1"), ("b", "1")], "t", {}) != A.provenance_hash([("b", "1"), ("a", "1")], "t", {})


def test_stream_drops_late_rows_and_closes_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "ts timestamp_ntz, is_hit boolean, bytes long"
    path = f"file://{tmp_path}/in"
    spark.createDataFrame([(t + dt.timedelta(minutes=m), True, 1) for m in (1, 30, 61, 150)], schema).coalesce(1).write.parquet(path)
    stream = jobs.file_stream(spark, path + "/")
    out = jobs.run_available(jobs.windowed_access(stream, "1 hour", None, "10 minutes"), "t")
    assert {(r["start"].hour, r["hits"]) for r in out.collect()} == {(0, 2), (1, 1)}


def test_replay_of_many_files_keeps_older_rows(spark, tmp_path):
    """Late rows in the files after the first two thousand: Spark drops by the watermark of the batch before the last."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewell.plans import rollups

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(2002):
        ts = dt.datetime(2024, 1, 1 if i >= 2000 else 2, 6 if i else 20)
        file = folder / f"part-{i:05}.parquet"
        pq.write_table(pa.table({"ts": pa.array([ts], pa.timestamp("us")), "event_type": ["view"], "value": [1.0]}), file)
        os.utime(file, (1.7e9 + i, 1.7e9 + i))
    got = {(r["start"], r["hits"]) for r in rollups.w2(spark, f"file://{tmp_path}").collect()}
    assert got == {(dt.datetime(2024, 1, 1, 6), 2), (dt.datetime(2024, 1, 2, 6), 1999)}


def test_shared_folder_is_needed_on_a_cluster():
    from tidewell.session import shared_dir

    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder}

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, folder):
            self.set = folder

    spark = type("Session", (), {})()
    spark.sparkContext = Context("spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(spark)
    spark.sparkContext = Context("yarn", "hdfs://shared/")
    assert shared_dir(spark) == "hdfs://shared"
    spark.sparkContext = Context("local[4]")
    assert shared_dir(spark).startswith("file:///tmp/spark-")


def test_files_fingerprint_and_footers(spark, sf, tmp_path):
    """The listing's digest against hashes of what the file system tells, and footers that are read without the files."""
    import hashlib

    from pyspark.sql.functions import col

    folder = tmp_path / "t"
    spark.range(100).repartition(5).write.parquet(f"file://{folder}")
    names = [p for p in folder.iterdir() if not p.name.startswith((".", "_"))]
    entries = [f"{p.name}:{p.stat().st_size}:{p.stat().st_mtime_ns // 10**6 * 1000}" for p in names]
    parts = {}
    for e in entries:
        parts.setdefault(int(hashlib.sha256(e.encode()).hexdigest()[:8], 16) % 4096, []).append(e)
    digest = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    got = S.prefix_fingerprint(spark, f"file://{folder}").first()
    assert (got["fingerprint"], got["files"]) == (digest([digest(sorted(v)) for _, v in sorted(parts.items())]), len(names))
    footers = S.footer_statistics(spark, f"file://{folder}").agg({"num_rows": "sum"}).first()[0]
    assert footers == 100
    fresh = S.schema_rows(spark, {"t": spark.range(1)}), S.schema_rows(spark, {"t": spark.range(1).select(F.when(col("id") > 5, col("id")).alias("id"))})
    assert len({S.schema_fingerprints(x).first()["fingerprint"] for x in fresh}) == 2  # nullability counts


def test_sequential_rank_iteration(spark, sf):
    """m23 against the same iteration in Python."""
    from tidewell.plans import fixtures as X
    from tidewell.plans import registry

    nodes = [r["node"] for r in X.nodes(spark, sf).collect()]
    links = [(r["src"], r["dst"]) for r in X.links(spark, sf).collect()]
    out = {}
    for a, _ in links:
        out[a] = out.get(a, 0) + 1
    rank, k = {n: 1 / len(nodes) for n in nodes}, 0
    for k in range(1, 31):
        new = {n: 0.15 / len(nodes) for n in nodes}
        for a, b in links:
            new[b] += 0.85 * rank[a] / out[a]
        moved, rank = sum(abs(new[n] - rank[n]) for n in nodes), new
        if moved < 1e-4:
            break
    got = {r["node"]: (r["rank"], r["iterations"]) for r in registry.m23(spark, sf).collect()}
    assert set(got) == set(nodes) and all(abs(got[n][0] - rank[n]) < 1e-7 and got[n][1] == k for n in nodes)


def test_vectors_and_models(spark, sf):
    """x4 against the encoder on the driver; x7 and x10 against what their models predict and weigh."""
    from tidewell.plans import modelling

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["vector"] for r in modelling.x4(spark, sf).collect()}
    assert got == dict(zip(docs, M.hashing_vectors(list(docs.values()), 32)))
    rows = [(i, float(i % 7), float((i * 13) % 11), int(i % 7 > 3), "test" if i % 4 == 0 else "train") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tells double, noise double, y int, split string")
    table, models = M.fit_and_compare(df, ["tells", "noise"], "y")
    assert {r["model"]: (r["train_accuracy"], r["test_accuracy"]) for r in table.collect()}["random_forest"] == (1.0, 1.0)
    weights = models["random_forest"].featureImportances
    assert weights[0] > 0.9 and abs(sum(weights) - 1) < 1e-9


def test_both_ways_of_ranks_and_running_values(spark):
    """Ranges of the order against one task, on skewed groups with ties, nulls and a null group."""
    import random

    from tidewell.operators import ordered
    from tidewell.operators import relational as R
    from tidewell.plans import registry

    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1.5, 2.5, rng.random() * 10]), rng.randint(0, 9)) for i in range(3000)] + [("one", 9000, 4.0, 1)]
    df = spark.createDataFrame(rows, "g string, k int, v double, c int").repartition(7)
    same = lambda f: sorted(map(str, f(1 << 100).collect())) == sorted(map(str, f(0).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert same(lambda most: R.within_budget(df, "g", "k", F.col("c"), 800, most))
        assert same(lambda most: ordered.last_before(df, "g", ["k"], F.col("v"), most))
        cells = df.select(F.col("g").alias("variable"), F.col("k").alias("pos")).where("g IS NOT NULL")
        assert same(lambda most: R.as_of_position(cells.where("pos % 3 = 0"), cells.where("pos % 2 = 0"), most=most))
        runs = df.select(F.col("g").alias("cell"), F.col("k").alias("seq"), F.col("c").alias("ms"), (F.col("c") > 4).alias("hit"))
        assert same(lambda most: registry.savings(runs, most))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("at", [{}, {"accuracy": 4, "range_rows": 20}])
def test_ranks_by_selection(spark, at):
    """Against a task that holds each group: skewed groups, ties, nulls, a null group, a group of nulls, one value, no rows;
    pivots so rough that ranges are split again and again."""
    import random

    from tidewell.operators import ordered
    from tidewell.operators import relational as R

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, 2.5, rng.random() * 10])) for _ in range(2000)]
    df = spark.createDataFrame(rows + [("one", 4.0), ("none", None), ("none", None)] + [("same", 7.0)] * 90, "g string, n double").repartition(5)
    rows_of = lambda x: sorted(map(str, x.collect()))
    assert rows_of(R.nearest_rank(df, ["g"], "n", 6, **at)) == rows_of(R.nearest_rank_of_few(df, ["g"], "n", 6))
    assert rows_of(R.floor_rank(df, ["g"], "n", 6, **at)) == rows_of(R.floor_rank_of_few(df, ["g"], "n", 6))
    assert rows_of(R.medians(df, ["g"], "n", **at)) == rows_of(df.groupBy("g").agg(F.round(F.percentile("n", 0.5), 6).alias("median")))
    whole = df.agg(*[F.round(F.percentile("n", p), 4).alias(q) for q, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    assert rows_of(R.describe(df, "n", **at).select("q1", "q2", "q3")) == rows_of(whole)
    assert R.nearest_rank(df.limit(0), ["g"], "n", **at).count() == 0 and R.describe(df.limit(0), "n", **at).first()["q2"] is None
    big = spark.range(5000).select((F.col("id") + (1 << 53)).alias("x"))  # a double can't tell these values apart
    assert ordered.at_ranks(big, [], "x", {"r": lambda n: F.ceil(n * 0.3)}, [0.3], **at).first()["r"] == (1 << 53) + 1499
    pair = spark.range(900).select((F.col("id") % 2 + (1 << 62) + 7).alias("x"))  # no pivot falls between or on them
    assert ordered.at_ranks(pair, [], "x", {"r": lambda n: F.ceil(n * 0.6)}, [0.6], **at).first()["r"] == (1 << 62) + 8


def test_the_size_of_an_input_is_estimated(spark, sf):
    """No job runs; what isn't known is large."""
    from tidewell.operators import ordered

    tracker = spark.sparkContext.statusTracker()
    e = spark.read.parquet(f"{sf}/events.parquet")  # reads the schema
    spark.sparkContext.setJobGroup("estimate", "")
    assert ordered.fits(e.where("value > 3").select("ts", "value")) and not ordered.fits(e, 100)
    assert not ordered.fits(spark.createDataFrame(spark.sparkContext.parallelize([(1,)], 1), "x int"))
    assert not list(tracker.getJobIdsForGroup("estimate"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jdbc_options():
    with pytest.raises(ValueError):
        S.jdbc_options("jdbc:x", "SELECT 1", "k")
    o = S.jdbc_options("jdbc:postgresql://h/d", "SELECT * FROM t", "k", (0, 100), 4)
    assert o["numPartitions"] == "4" and o["dbtable"] == "(SELECT * FROM t) q" and "READ ONLY" in o["sessionInitStatement"]
    assert S.jdbc_options("jdbc:sqlite:x", "SELECT 1") == {"url": "jdbc:sqlite:x", "fetchsize": "10000", "query": "SELECT 1"}


def test_embed_holds_one_call_at_a_time():
    """The batches that a task gives back are those of single calls, and every row has its vector."""

    class Rows:
        dtypes = [("id", "bigint"), ("text", "string")]
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    texts = [f"a b {k}" if k % 7 else None for k in range(1000)]
    run = M.embed(Rows(), "id", "text", batch=64)
    out = list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": texts})])))
    assert [b.num_rows for b in out] == [64] * 15 + [40]
    assert [v for b in out for v in b.column("vector").to_pylist()] == M.hashing_vectors(texts, 32)
    assert [k for b in out for k in b.column("id").to_pylist()] == list(range(1000))
