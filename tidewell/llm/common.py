"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def worker_cache(key: tuple, make: Callable, alone: bool = False):
    """One value per Python worker and key, kept between tasks when Spark reuses the worker.

    Values of another kind (the first part of the key) are dropped when a new one is made: a worker that goes on to
    another operator's tasks doesn't hold on to the tables of the last one. alone: those of the same kind go too.
    """
    store = sys.__dict__.setdefault("_tidewell_cache", {})
    if key not in store:
        for other in [k for k in store if alone or k[0] != key[0]]:
            del store[other]
        store[key] = make()
    return store[key]


def tidied(f: Callable) -> Callable:
    """f, an iterator function of a task, giving freed memory back to the system when it ends: workers live on."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: nothing to trim

    return run


def filesystem(uri: str):
    """A file system of pyarrow and the path within it, for tasks that read or write files of the shared folder."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spread(n_rows: int, per_task: int) -> int:
    """How many tasks give each about per_task rows."""
    return max(1, -(-int(n_rows) // per_task))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that repartition(n, column) sends there, so that numbered work is dealt evenly.

    The numbers come from Spark's own hash function; if a partition were left without one, it would share another's.
    """
    found: dict[int, int] = {}
    tried = 4 * n + 64
    while len(found) < n and tried < 10_000 * n:
        numbers = spark.range(tried).select(F.col("id").cast("int").alias("k"))
        rows = numbers.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
        found, tried = {r["p"]: r["k"] for r in rows}, 4 * tried
    return [found.get(p, p) for p in range(n)]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable, so that the optimizer can't repeat its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_rows: int = 1000, hot_share: int = 20_000) -> DataFrame:
    """Each row with the columns of its group; groups has one row for each key, and in `size` how many rows have it.

    Keys of very many rows are few by definition, at most hot_share of them have over a hot_share-th of all rows: they are
    joined by broadcast, so their rows aren't shuffled. All others have bounded numbers of rows. hot_rows: rows from which
    a key may count as hot. Both tables are read twice, so they should be stored ones.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    most = max(hot_rows, total // hot_share)
    hot = F.broadcast(groups.where(F.col(size) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= most), key)
    return rows.join(hot, key).unionByName(rest)
