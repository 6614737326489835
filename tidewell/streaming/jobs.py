"""Structured Streaming forms of the rollups. Timestamps without a zone become UTC timestamps before the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.session import new_path, stored


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1000) -> DataFrame:
    """A stream over the Parquet files at path (a folder or a file); the schema is that of a batch read.

    files_per_trigger None: all files that are there are one micro-batch, so a watermark drops none of their rows.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern; this one matches the file alone
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def staged(df: DataFrame, batch: Column, label: str) -> str:
    """Writes df below a new folder, a file for each batch number, for a replay in their order, one file in each micro-batch
    (files_per_trigger=1): a file source goes by the time of change, which is set one second apart. Returns the folder.

    A batch is as much as one task writes; number them so that they are (by the hour, say).
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    rows = df.withColumn("_batch", batch.cast("long"))
    rows.repartition("_batch").sortWithinPartitions("_batch").write.partitionBy("_batch").option("maxRecordsPerFile", 0).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(folder) if "=" in s.getPath().getName())
    for i, (_, at) in enumerate(numbers):
        for f in fs.listStatus(at):
            if f.getPath().getName().endswith(".parquet"):
                fs.setTimes(f.getPath(), 1_000_000_000_000 + 1000 * i, -1)
    return path


def file_order(df: DataFrame, ts: str) -> DataFrame:
    """path, least, newest, and late: by how much rows of the file are behind the newest row of the files before it, the files
    taken in the order of their least time. The largest late is the delay with which a replay in this order drops nothing."""
    files = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(ts).alias("least"), F.max(ts).alias("newest"))
    before = F.max("newest").over(W.orderBy("least", "path").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    return files.withColumn("late", F.greatest(before - F.col("least"), F.expr("INTERVAL '0' SECOND")))


def windowed_access(stream: DataFrame, window: str, slide: str | None, delay: str) -> DataFrame:
    """Hits, misses and bytes per window of event time; rows later than delay behind the newest are dropped."""
    own = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    w = F.window("at", window, slide) if slide else F.window("at", window)
    out = own.groupBy(w.alias("w")).agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"), F.sum("bytes").alias("bytes"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "hits", "misses", "bytes")


def run_available(stream: DataFrame, label: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """Runs a stream over what is there into a Parquet folder and reads the result. path, state: those of an earlier run that
    this one goes on with; without them the folder and the checkpoint are new."""
    spark = stream.sparkSession
    path, state = path or new_path(spark, label), state or new_path(spark, f"{label}-state")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def late_rows(stream: DataFrame, ts: str, delay: str, target: str, state: str) -> DataFrame:
    """Runs a stream over what is there and keeps the rows that a watermark of this delay finds late, that is those behind
    the newest time of all batches before theirs by more than delay; returns them.

    A batch writes folders of its own below target: its late rows, and its newest time. One that runs again writes them anew,
    and reads the times of the batches before it, so it finds the same.
    """
    spark, schema = stream.sparkSession, stream.schema

    def split(batch: DataFrame, number: int) -> None:
        own = stored(batch, "batch")  # read twice
        own.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{target}/newest/batch={number}")
        marks = spark.read.schema(f"newest {schema[ts].dataType.simpleString()}, batch long").parquet(f"{target}/newest")
        newest = marks.where(F.col("batch") < number).agg(F.max("newest").alias("newest"))
        late = own.crossJoin(newest).where(F.col(ts) < F.col("newest") - F.expr(f"INTERVAL {delay}")).drop("newest")
        late.write.mode("overwrite").parquet(f"{target}/late/batch={number}")

    q = stream.writeStream.foreachBatch(split).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{target}/late/batch=*")


def ingest_bounded(stream: DataFrame, key: list[str], ts: str, delay: str, target: str, state: str) -> list[dict]:
    """Appends the rows of a stream to the Parquet folder target, each key once, without reading target; returns the state
    rows and the rows written of each micro-batch.

    Keys are remembered for the delay: a row that is delivered again within it adds nothing, and one that comes later than
    that is behind the watermark and dropped. A batch writes a folder of its own, so one that runs again after a failure
    replaces what it wrote. What is remembered is as much as comes within the delay, however large target is.
    """
    once = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(key).drop("_at")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = once.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return [{"batch": p["batchId"], "state_rows": p["stateOperators"][0]["numRowsTotal"], "read": p["numInputRows"]} for p in q.recentProgress if p["stateOperators"]]


def ingest_once(stream: DataFrame, key: list[str], target: str, day: Column | None = None) -> None:
    """Appends each micro-batch to the Parquet folder target without rows whose key is there already.

    A batch that is delivered again adds nothing, since its rows are there. day: a date that follows from the key's row;
    the target is partitioned by it, and a batch reads only the days that it holds itself.
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, _: int) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(target)
        fresh = batch.dropDuplicates(key)
        if day is not None:
            fresh = fresh.withColumn("ingest_day", day.cast("string"))
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            there = spark.read.schema(fresh.schema).parquet(target)
            if day is not None:
                days = [r[0] for r in fresh.select("ingest_day").distinct().collect()]  # as many as a batch has days
                there = there.where(F.col("ingest_day").isin(days) | F.col("ingest_day").isNull())
            fresh = fresh.join(there.select(*key), key, "left_anti")
        out = fresh.write.mode("append")
        (out if day is None else out.partitionBy("ingest_day")).parquet(target)

    q = stream.writeStream.foreachBatch(append).option("checkpointLocation", new_path(spark, "ingest-state")).trigger(availableNow=True).start()
    q.awaitTermination()
