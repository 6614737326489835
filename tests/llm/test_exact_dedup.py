"""op11: its filters, snapshots and groups against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import op11_exact_dedup as ded

ROWS = "doc_id long, text string, key int, size string"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5_000, 60_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 60, n))
    seed, fingerprints = ded.build_filter(keys)
    assert ded.passes(keys, len(keys), seed, fingerprints).all()
    if n >= 5_000:
        assert len(fingerprints) < 1.45 * n
        others = np.setdiff1d(rng.integers(0, 1 << 60, 200_000), keys)
        assert 0.002 < ded.passes(others, len(keys), seed, fingerprints).mean() < 0.006


def test_filter_of_repeated_keys():
    with pytest.raises(ValueError):
        ded.build_filter(np.array([5, 5]), tries=3)


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, len(t or "")))
    out = []
    for norm, own in groups.items():
        keep, chars = min(own, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out += [(d, keep, len(own), d == keep and n == chars, hashlib.sha256(norm.encode()).hexdigest()) for d, n in own]
    return sorted(out, key=repr)


def cases():
    texts = ["", " ", None, "a b", "ab", "a b", "a\x0bb", "a\x1cb", "A b", "日本 語", "日本語", "x " * 3000, "x" * 3000]
    rows = list(enumerate(texts)) + [(100 + i, "hot copy") for i in range(200)] + [(400, " hot copy "), (399, "hot\tcopy ")]
    rows += [(500, "twice"), (500, "twice"), (500, "twice "), (None, "twice"), (None, "null id"), (None, None)]
    rows += [(600 + i, f"text {i % 150}") for i in range(300)] + [(2000, "long word " * 120_000), (2001, "longword" * 120_000)]
    return [(d, t, 1, "x") for d, t in rows]


@pytest.mark.parametrize(("deliveries", "key_bits", "hot_rows"), [(1, 60, 1000), (2, 60, 20), (3, 6, 20), (4, 0, 1000)])
def test_deliveries(spark, tmp_path, deliveries, key_bits, hot_rows):
    """Keys of few bits meet in one place, so that filters let all through, and the bytes decide."""
    rows = cases()
    docs = spark.createDataFrame(rows, ROWS).withColumn("part", F.pmod(F.hash("doc_id", "text"), F.lit(deliveries)))
    own = lambda k: docs.where(F.col("part") == k)
    parts = [(own(k), ded.digested(own(k), key_bits=key_bits)) for k in range(deliveries)]
    got = ded.deduplicated(parts, f"file://{tmp_path}/index", hot_rows=hot_rows, key_bits=key_bits, keys_per_shard=40, bucket_chars=20_000)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got.collect()), key=repr) == brute(rows)
    paths = ded.snapshots(spark, f"file://{tmp_path}/index")
    assert len(paths) == deliveries - 1
    texts = [r["norm"] for p in paths for r in spark.read.parquet(f"{p}/texts").collect()]
    assert len(texts) == len(set(texts))  # a text is stored once, in the snapshot that met it first


def test_screening_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", 0, "x") for i in range(3000)], ROWS)
    other = spark.createDataFrame([(i, f"text {i}", 0, "x") for i in range(2900, 6000)], ROWS)
    folder = f"file://{tmp_path}/index"
    none = docs.limit(0)
    assert ded.ingest(none, ded.digested(none), folder).count() == 0 and len(ded.snapshots(spark, folder)) == 1
    assert ded.ingest(docs, ded.digested(docs), folder).where("known").count() == 0
    groups = ded.grouped(ded.digested(other))
    last = ded.snapshots(spark, folder)[-1]
    assert 100 <= ded.screen(groups, last).count() < 160  # those that are there, and one in 256 of the others
    again = ded.ingest(other, ded.digested(other), folder)
    assert again.where("known").count() == 100 and again.where("known AND root = digest").count() == 100
    assert ded.deduplicated([(none, ded.digested(none))], f"{folder}2").count() == 0


def test_stored_texts_are_not_shuffled(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(i, f"text {i}", 0, "x") for i in range(300)], ROWS)
    folder = f"file://{tmp_path}/index"
    ded.ingest(docs, ded.digested(docs), folder, bucket_chars=500)
    path = ded.snapshots(spark, folder)[0]
    buckets = spark.read.parquet(f"{path}/filters").first()["buckets"]
    name = ded._bucketed(spark, f"{path}/texts", buckets)
    exact = spark.table(name).select("key", F.col("norm").alias("stored"))
    texts = ded.texts_of(docs, ded.grouped(ded.digested(docs)))
    both = exact.join(ded._once(texts, buckets).hint("shuffle_hash"), "key").where("norm <= stored AND norm >= stored")
    both.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(key") + plan.count("REPARTITION_BY_NUM") == 2 and "ShuffledHashJoin" in plan  # one, named twice
    assert buckets > 4 and both.count() == 300
    spark.sql(f"DROP TABLE {name}")
