"""op12 against a brute-force version."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import op12_whitening as wh
from tidewell.llm.common import join_groups

ROWS = "vec_id long, embedding array<double>, digest int, copies string"


def brute(rows, components=4, weights="one"):
    whole = [(i, tuple(math.floor(256 * c) for c in v)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = {}
    for _, x in whole:
        lengths[len(x)] = lengths.get(len(x), 0) + 1
    width = max(lengths, key=lambda k: (lengths[k], k))
    whole = [(i, x) for i, x in whole if len(x) == width]
    counts = {}
    for _, x in whole:
        counts[x] = counts.get(x, 0) + 1
    xs = sorted(counts)
    w = np.array([1 if weights == "one" else counts[x] for x in xs])
    n = int(w.sum())
    sums = [sum(int(k) * x[j] for k, x in zip(w, xs)) for j in range(width)]
    centred = np.array(xs, float) - np.array([s / n for s in sums])
    e, u = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > e[0] * 1e-11).sum()))
    z = centred @ u[:, :k] / np.sqrt(e[:k])
    of = dict(zip(xs, z))
    dev = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs}
    return {n}, e[:k] / e.sum(), [(i, dev[x], of[x]) for i, x in whole]


def table_rows(seed=1, n=400, width=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) @ np.diag(np.arange(width, 0, -1.0)) / 4
    rows = [(i, [float(c) for c in v], 0, "x") for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1], 0, "x") for i in range(150)]  # one common vector
    rows += [(5, rows[7][1], 0, None), (5, rows[7][1], 0, None), (None, rows[8][1], 0, "x")]
    rows += [(2000, None, 0, "x"), (2001, [None] + [0.0] * (width - 1), 0, "x"), (2002, [math.nan] * width, 0, "x"), (2003, [math.inf] + [0.0] * (width - 1), 0, "x"), (2004, [], 0, "x"), (2005, [1.0], 0, "x")]
    return rows + [(2006, [-0.0] * width, 0, "x"), (2007, [0.0] * width, 0, "x"), (2008, [0.001] * width, 0, "x")]  # one x vector


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_brute_force(spark, weights):
    rows = table_rows()
    got = wh.whiten(spark.createDataFrame(rows, ROWS).repartition(5), weights=weights).collect()
    n, explained, want = brute(rows, weights=weights)
    assert {r["n"] for r in got} == n and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9)
    order = lambda r: (str(r[0]), r[1], tuple(np.round(np.abs(r[2]), 6)))
    mine, theirs = (sorted(x, key=order) for x in ([(r["vec_id"], r["deviation"], np.array(r["whitened"])) for r in got], want))
    assert [r[:2] for r in mine] == [r[:2] for r in theirs]
    a, b = (np.array([r[2] for r in x]) for x in (mine, theirs))
    signs = np.sign((a * b).sum(axis=0))
    assert np.allclose(a, b * signs, atol=1e-8)


def test_few_directions_and_none(spark):
    frame = lambda vs: spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vs)], ROWS)
    line = wh.whiten(frame([[k / 4, k / 2, 1.0] for k in range(9)])).collect()
    assert {len(r["whitened"]) for r in line} == {1} and line[0]["explained"] == pytest.approx([1.0])
    for vectors in ([], [None], [[1.0, 2.0]] * 5, [[]]):
        assert wh.whiten(frame(vectors)).count() == 0


def test_deviation_of_large_numbers():
    x = np.array([[1, -1], [2**40, 5], [2**62, 0]], np.int64)
    n, sums = 3, [1 + 2**40 + 2**62, 4]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert wh.deviations(x, n, sums).to_pylist() == [w if w < 2**63 else None for w in want]
    assert wh.deviations(x[:1], 7, [3, 5]).to_pylist() == [(7 - 3) ** 2 + (7 + 5) ** 2]


def test_sums_of_large_numbers_and_counts():
    x, w = [[2**62, -3], [-(2**63), 2**33], [5, -1], [2**63 - 1, 0]], [40_000, 70_000, 3, 1 << 14]
    batch = pa.RecordBatch.from_arrays([pa.array(x), pa.array(w)], ["x", "weight"])
    (got,) = wh._exact_sums([batch, batch.slice(0, 0), batch])
    assert got["total"].to_pylist() == [str(2 * sum(k * v[j] for k, v in zip(w, x))) for j in range(2)]


def test_table(spark, sf):
    """On the given table, where whitening again with more decimals doesn't change what a row has."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = wh.op12_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    by = {(r["vec_id"], r["component"]): r for r in got.collect()}
    n, explained, want = brute(rows)
    assert len(by) == 4 * len(rows)
    z = np.array([[by[i, k]["whitened"] for k in (1, 2, 3, 4)] for i, *_ in want])
    other = np.array([w[2] for w in want])
    assert np.allclose(z, other * np.sign((z * other).sum(axis=0)), atol=1e-8)
    assert all(by[i, k]["deviation"] == dev for i, dev, _ in want for k in (1, 4))
    assert [by[rows[0][0], k]["explained"] for k in (1, 2, 3, 4)] == pytest.approx(list(explained))


def test_join_groups_with_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    for hot_rows in (1, 50, 1000):
        got = join_groups(rows, groups, "k", "n", hot_rows).orderBy("i").collect()
        assert [(r["k"], r["i"], r["least"]) for r in got] == [("hot" if i % 3 else f"k{i}", i, 1 if i % 3 else i) for i in range(300)]
