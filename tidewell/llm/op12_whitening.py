"""Embedding whitening with a covariance of weighted multiplicities.

1. Each vector becomes a vector x of whole numbers, floor(scale * c). Identical x vectors are grouped and counted before
   the shuffle, so a vector that a third of all rows have is one row.
2. The fit works on the distinct vectors, each with a weight: one, or its count. A first pass sums them exactly, in whole
   numbers. A second one centres each batch by that mean and multiplies it with itself (a matrix product for each batch);
   a task keeps one matrix, and the tasks' matrices are added row by row in as many tasks as there are rows.
3. The driver holds one matrix of dimension x dimension, and takes its eigenvectors.
4. Each distinct vector is whitened once, and the rows get the result of their vector by a join on the SHA-256 of x.
   Vectors of very many rows are joined by broadcast (`common.join_groups`).

Cases: rows whose vector is null, or holds an entry that is null or not finite, are dropped; so are vectors of another
length than most have (of lengths with as many rows the larger one counts), which have no place in the matrix. Entries
beyond the range of a long become its ends. Repeated rows, and rows with equal or null vec_ids, are whitened each.
Directions without variance (an eigenvalue of less than 1e-11 of the largest one) can't be whitened, and give no component;
so a table with one distinct vector gives no rows, like an empty one. A deviation that doesn't fit in a long is null.
Eigenvectors point where their largest entry is positive. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import join_groups
from tidewell.session import stored, table

#: Least share of the largest eigenvalue that counts as variance.
NO_VARIANCE = 1e-11
WHITENED = "digest binary, copies long, deviation long, whitened array<double>"


def integer_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and x, for the rows whose vectors are whole and finite."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", x.alias("x"))


def vector_digest():
    return F.unhex(F.sha2(F.array_join("x", ","), 256))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """x, its digest and copies, of the vectors of the length that most rows have; stored."""
    groups = stored(vectors.groupBy("x").agg(F.count("*").alias("copies")).withColumn("digest", vector_digest()), "vectors")
    lengths = groups.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return groups.where(F.size("x") == (lengths["width"] if lengths else 0))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def _exact_sums(batches):
    """The weighted sum of each dimension, as a whole number of any size."""
    total = None
    for b in batches:
        if not len(b):
            continue
        x, w = _matrix(b.column("x"), np.int64), b.column("weight").to_numpy()
        often = w >= 1 << 15  # at most a 2^15th of the rows that were grouped
        own = (x[often].astype(object) * w[often].astype(object)[:, None]).sum(axis=0)
        for at in range(0, len(x), 1 << 15):
            part, times = x[at : at + (1 << 15)], np.where(often, 0, w)[at : at + (1 << 15), None]
            # the upper and the lower 32 bits of 2^15 numbers, each less than 2^15 times: below 2^63
            own = own + (((part >> 32) * times).sum(axis=0).astype(object) << 32) + ((part & 0xFFFFFFFF) * times).sum(axis=0).astype(object)
        total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total])], ["dim", "total"])


def _products(mean: np.ndarray, column: str):
    def run(batches):
        total = np.zeros((len(mean), len(mean)))
        for b in batches:
            if len(b):
                centred = _matrix(b.column(column), np.float64) - mean
                total += (centred * b.column("weight").to_numpy().astype(np.float64)[:, None]).T @ centred
        rows = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(mean)), pa.int32()), rows], ["dim", "products"])

    return run


def _added(batches):
    """The sum of the tasks' rows of each dimension."""
    rows: dict[int, np.ndarray] = {}
    for b in batches:
        for k, row in zip(b.column("dim").to_pylist(), _matrix(b.column("products"), np.float64) if len(b) else ()):
            rows[k] = rows[k] + row if k in rows else row
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["dim", "products"])


def centred_covariance(vectors: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance of a column of vectors around mean, weighted by the column weight, divided by n."""
    parts = vectors.select(column, "weight").mapInArrow(_products(mean, column), "dim int, products array<double>")
    tasks = max(1, min(len(mean), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros((len(mean), len(mean)))
    for r in parts.repartition(tasks, "dim").mapInArrow(_added, "dim int, products array<double>").collect():  # a row for each dimension
        out[r["dim"]] = r["products"]
    return out / n


@dataclass
class Whitening:
    """What a fit found: n, exact sums by dimension, eigenvalues (falling) and, as columns, their unit eigenvectors, both of
    the components that were asked for; total: the sum of all eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit(distinct: DataFrame, components: int = 4, weights: str = "one") -> Whitening | None:
    """distinct: as distinct_vectors gives them. weights: one (each distinct vector counts once) or count. None without rows."""
    weighted = distinct.select("x", (F.lit(1) if weights == "one" else F.col("copies")).cast("long").alias("weight"))
    n = weighted.agg(F.sum("weight")).first()[0] or 0
    parts = weighted.mapInArrow(_exact_sums, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = [int(r["total"]) for r in sorted(parts.collect(), key=lambda r: r["dim"])]  # a row for each dimension
    if not sums:
        return None
    covariance = centred_covariance(weighted, "x", np.array([s / n for s in sums]), n)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > max(values[0], 0) * NO_VARIANCE).sum()))
    vectors = vectors[:, :kept] * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(values))] < 0, -1, 1)[:kept]
    return Whitening(n, sums, values[:kept], vectors, float(np.trace(covariance)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over the dimensions of (n * x - sum)^2 for each row, exact; null where it is no long."""
    about = ((x.astype(np.float64) * n - np.array(sums, np.float64)) ** 2).sum(axis=1)
    small = (about < 2.0**62) & (np.abs(x).max(axis=1, initial=0).astype(np.float64) * n < 2.0**62)
    out = np.zeros(len(x), np.int64)
    if small.any():  # sums of vectors that small fit too, unless others are large: then they are taken as whole numbers
        if max(map(abs, sums)) < 1 << 62:
            out[small] = ((x[small] * n - np.array(sums, np.int64)) ** 2).sum(axis=1)
        else:
            small[:] = False
    known = small.copy()
    for i in np.flatnonzero(~small):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums))
        if exact < 1 << 63:
            out[i], known[i] = exact, True
    return pa.array(out, mask=~known)


def _whitened(found: Whitening):
    def run(batches):
        mean, project = found.mean, found.vectors / np.sqrt(found.values)
        for b in batches:
            if len(b):
                x = _matrix(b.column("x"), np.int64)
                z = pa.array(list((x - mean) @ project), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("copies"), deviations(x, found.n, found.sums), z], ["digest", "copies", "deviation", "whitened"])

    return run


def identity_error(whitened: DataFrame, n: int, components: int, weights: str = "one") -> float:
    """The largest absolute entry of the covariance of the whitened distinct vectors minus the identity."""
    z = whitened.select("whitened", (F.lit(1) if weights == "one" else F.col("copies")).cast("long").alias("weight"))
    mean = np.array(z.agg(*[F.sum(F.get("whitened", F.lit(k)) * F.col("weight")) for k in range(components)]).first(), np.float64) / n
    return float(np.abs(centred_covariance(z, "whitened", mean, n) - np.eye(components)).max())


def whiten(embeddings: DataFrame, components: int = 4, weights: str = "one", scale: float = 256.0) -> DataFrame:
    """vec_id, whitened (an array, by component), deviation, n, explained (an array) and identity_error of each vector."""
    vectors = integer_vectors(embeddings, scale)
    distinct = distinct_vectors(vectors)
    found = fit(distinct, components, weights)
    if found is None or not len(found.values):
        return embeddings.sparkSession.createDataFrame([], vectors.select("vec_id").schema).selectExpr("vec_id", "array(0D) AS whitened", "0L AS deviation", "0L AS n", "array(0D) AS explained", "0D AS identity_error")
    once = stored(distinct.select("x", "digest", "copies").mapInArrow(_whitened(found), WHITENED), "whitened")
    error = identity_error(once, found.n, len(found.values), weights)
    rows = stored(vectors.select("vec_id", vector_digest().alias("digest")), "rows")
    explained = F.array(*[F.lit(float(e / found.total)) for e in found.values])
    return join_groups(rows, once, "digest", "copies").select("vec_id", "whitened", "deviation", F.lit(found.n).cast("long").alias("n"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings")).select("*", F.posexplode("whitened").alias("at", "value"))
    component = (F.col("at") + 1).cast("int").alias("component")
    return rows.select("vec_id", component, "n", "deviation", F.col("value").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error")
