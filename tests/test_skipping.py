"""An index of files decides what a scan opens."""

import os

import pytest
from pyspark.sql import functions as F

from tidewell.sources import scan as S
from tidewell.sources.skipping import SkippingIndex, bits_per_value


@pytest.fixture
def data(spark, tmp_path):
    df = spark.range(4000).select("id", (F.col("id") * 7919 % 4001).alias("code"), F.when(F.col("id") % 3 != 0, F.col("id") % 50).alias("x"), F.when(F.col("id") >= 500, F.col("id").cast("string")).alias("s"), F.floor(F.col("id") / 100).alias("zone"))
    path = f"file://{tmp_path}/data"
    df.repartition("zone").write.partitionBy("zone").parquet(path)
    return path, df.drop("zone")


FILTERS = [
    [("id", ">=", 250), ("id", "<", 420)], [("id", "=", 17)], [("id", "!=", 17), ("id", "<=", 99)], [("id", ">", 5000)], [],
    [("x", "=", 7), ("id", "<", 1000)], [("s", ">", "3999")], [("s", "=", "777"), ("x", ">=", 0)], [("code", "=", 1234)], [("code", "=", 99999)], [("code", "=", 5), ("id", "<", 2000)],
]


@pytest.mark.parametrize("filters", FILTERS)
def test_rows_equal_the_full_scan_and_files_are_few(spark, tmp_path, data, filters):
    path, df = data
    index = SkippingIndex(spark, f"file://{tmp_path}/index").build(path, ["id", "x", "s"], ["code"])
    got, want = index.scan(["id", "code"], filters), S.scan(df, ["id", "code"], filters)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    opened, need = len(got.inputFiles()), want.select(F.floor(F.col("id") / 100)).distinct().count()
    assert need <= opened == index.surviving(filters).count() <= 40
    if filters and filters[0][0] in ("id", "s"):
        assert opened <= need + 1
    if any(c == "code" for c, *_ in filters):
        assert opened <= need + 2


def test_all_null_files_are_skipped(spark, tmp_path, data):
    path, _ = data
    index = SkippingIndex(spark, f"file://{tmp_path}/index").build(path, ["s"])
    assert index.surviving([("s", "!=", "1")]).count() == 35 and index.zones().count() == 40


def test_refresh(spark, tmp_path, data):
    path, df = data
    index = SkippingIndex(spark, f"file://{tmp_path}/index").build(path, ["id"], ["code"])
    assert index.refresh() == 0
    begun = index.scan(["id"], [("id", "<", 150)])
    spark.range(9000, 9100).select("id", F.lit(77777).cast("long").alias("code"), F.lit(1).cast("long").alias("x"), F.lit("z").alias("s")).coalesce(1).write.parquet(f"{path}/zone=90")
    assert index.scan(["id"], [("code", "=", 77777)]).count() == 0  # the index stands for the files that it knows
    assert index.refresh() == 1
    assert index.scan(["id"], [("code", "=", 77777)]).count() == 100 and len(index.scan(["id"], [("code", "=", 77777)]).inputFiles()) <= 2
    assert begun.count() == 150
    folder = path.removeprefix("file://") + "/zone=0"
    for f in os.listdir(folder):
        os.unlink(f"{folder}/{f}")
    assert index.refresh() == 0 and index.scan(["id"], [("id", "<", 150)]).count() == 50
    with pytest.raises(FileNotFoundError):
        SkippingIndex(spark, f"file://{tmp_path}/none").zones()
    with pytest.raises(ValueError):
        index.scan(None, [("nope", "=", 1)])


def test_needless_files_do_not_grow_with_the_files(spark, tmp_path):
    """Looking up values that one of many full files holds: hardly another one is left."""
    path = f"file://{tmp_path}/many"
    df = spark.range(120 * 3200).select("id", (F.col("id") * 7919 % (120 * 3200)).alias("code"), F.floor(F.col("id") / 3200).alias("zone"))
    df.repartition("zone").write.partitionBy("zone").parquet(path)
    index = SkippingIndex(spark, f"file://{tmp_path}/index").build(path, ["id"], ["code"])
    assert sum(index.surviving([("code", "=", v)]).count() for v in range(0, 12000, 1000)) <= 12 + 3
    assert bits_per_value(9000, 0.1, 5) > bits_per_value(90, 0.1, 5) > 10


def test_bits_follow_the_files_when_they_double(spark, tmp_path):
    path = f"file://{tmp_path}/grows"
    put = lambda zones: [spark.range(z * 10, z * 10 + 10).select("id", (F.col("id") * 3).alias("code")).coalesce(1).write.parquet(f"{path}/zone={z}") for z in zones]
    put(range(2))
    index = SkippingIndex(spark, f"file://{tmp_path}/index").build(path, ["id"], ["code"])
    put(range(2, 5))
    assert index.refresh() == 5 and index.refresh() == 0  # more than twice as many files: all are read again
    put([5])
    assert index.refresh() == 1 and index.scan(["id"], [("code", "=", 156)]).count() == 1 == len(index.scan(["id"], [("code", "=", 12)]).inputFiles())
