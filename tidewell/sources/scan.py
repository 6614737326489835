"""Table scans, zone maps, snapshots, listings and SQL over registered scans."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.functions.columns import conjunction
from tidewell.operators.graph import ancestors
from tidewell.session import new_path, stored

Filter = tuple[str, str, object]


def scan(df: DataFrame, columns: Sequence[str] | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
    """Exact filtered scan: filters are ANDed, columns keep the requested order. Unknown columns raise."""
    unknown = {c for c, *_ in filters} - set(df.columns)
    if unknown:
        raise ValueError(f"unknown filter columns: {sorted(unknown)}")
    out = df.where(conjunction(filters)) if filters else df
    return out.select(*columns) if columns is not None else out


class Scanner:
    """A scan handle."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, filters: Sequence[Filter] = ()):
        self.df = scan(df, columns, filters)

    @property
    def schema(self):
        return self.df.schema

    def count_rows(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def head(self, n: int, order: Sequence[str | Column]) -> DataFrame:
        return self.df.orderBy(*order).limit(n)

    def to_table(self):
        """All rows as an Arrow table on the driver; for small results."""
        return self.df.toArrow()

    def to_rows(self) -> Iterator:
        """Rows one partition at a time."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def map_batches(self, f, schema: str) -> DataFrame:
        """f over pandas batches on the executors: the batch form of a fetch that doesn't pass the driver."""
        return self.df.mapInPandas(f, schema)


def sql_over(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL over named frames, written {name}; binds are :name and never spliced. No view is left behind."""
    allowed = (str, bool, int, float, bytes)
    from datetime import date, datetime, time
    from decimal import Decimal

    for k, v in (args or {}).items():
        if v is not None and type(v) not in (*allowed, date, datetime, time, Decimal):
            raise TypeError(f"bind {k} has type {type(v).__name__}")
    missing = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", re.sub(r"'(?:[^']|'')*'", "", sql))) - set(args or {})
    if missing:
        raise ValueError(f"no value for {sorted(missing)}")
    return spark.sql(sql, args=args or None, **frames)


# ---------------------------------------------------------------- zone maps
def zone_map(df: DataFrame, zone: Column, columns: Sequence[str]) -> DataFrame:
    """Rows, and minimum, maximum and null count of each column, for each zone (a file, or a range of a key)."""
    stats = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]
    return df.groupBy(zone.alias("zone")).agg(F.count("*").alias("num_rows"), *stats)


def file_zone_map(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The zone map by file of a file-based DataFrame, in one pass over the named columns."""
    return zone_map(df, F.col("_metadata.file_path"), columns)


FOOTER = "path string, row_group int, num_rows long, bytes long, column_name string, min string, max string, nulls long"


def footer_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Row-group statistics from Parquet footers alone, a row for each row group and column.

    The files are listed without their contents; a task opens its files and reads their ends. Only in a file system that
    pyarrow doesn't know, the files are read whole by Spark.
    """
    seekable = re.match(r"/|(file|hdfs|s3a?|gs):", path) is not None

    def read(frames):
        import io

        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"]):
                if content is None:
                    files, inner = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", p))
                    with files.open_input_file(inner) as f:
                        meta = pq.read_metadata(f)
                else:
                    meta = pq.read_metadata(io.BytesIO(content))
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics
                        has = s is not None and s.has_min_max
                        rows.append((p, g, group.num_rows, group.total_byte_size, col.path_in_schema, str(s.min) if has else None, str(s.max) if has else None, s.null_count if s is not None and s.has_null_count else None))
            yield pd.DataFrame(rows, columns=["path", "row_group", "num_rows", "bytes", "column_name", "min", "max", "nulls"]).astype({"nulls": "Int64"})

    files = binary_files(spark, path, "*.parquet")
    return files.select("path", F.lit(None).cast("binary").alias("content") if seekable else "content").mapInPandas(read, FOOTER)


def may_match(op: str, value: object, low: Column, high: Column) -> Column:
    """Whether a zone with these bounds can hold a row; unknown bounds never prune."""
    v = F.lit(value)
    hit = {
        "=": (low <= v) & (high >= v),
        "!=": ~((low == v) & (high == v)),
        "<": low < v,
        "<=": low <= v,
        ">": high > v,
        ">=": high >= v,
    }[op]
    return F.coalesce(hit, F.lit(True))


def prune(zones: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """The zones that no filter excludes: a superset of those with matching rows."""
    keep = [may_match(op, v, F.col(f"min_{c}"), F.col(f"max_{c}")) for c, op, v in filters if f"min_{c}" in zones.columns]
    return zones.where(reduce(Column.__and__, keep, F.lit(True)))


def plan_summary(zones: DataFrame, filters: Sequence[Filter], row_bytes: int, max_zones: int, max_bytes: int, bulk_bytes: int) -> DataFrame:
    """Total, surviving and pruned zones, estimated bytes, limit verdicts and class of a scan, in one aggregate."""
    keep = reduce(Column.__and__, [may_match(op, v, F.col(f"min_{c}"), F.col(f"max_{c}")) for c, op, v in filters], F.lit(True))
    size = F.coalesce(F.sum(F.when(keep, F.col("num_rows"))), F.lit(0)) * row_bytes
    out = zones.agg(F.count("*").alias("total"), F.count_if(keep).alias("surviving"), size.cast("long").alias("bytes"))
    return out.select("total", "surviving", (F.col("total") - F.col("surviving")).alias("pruned"), "bytes", (F.col("surviving") <= max_zones).alias("zones_ok"), (F.col("bytes") <= max_bytes).alias("bytes_ok"), F.when(F.col("bytes") > bulk_bytes, "bulk").otherwise("interactive").alias("kind"))


# ---------------------------------------------------------------- snapshots
def read_snapshot(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The files of a snapshot from a log (snapshot_id, parent_id, committed_at, path): those of it and its ancestors.

    None is the latest snapshot. An unknown id raises. The walk follows parents, one per snapshot; the log of
    snapshots is metadata, small beside the data.
    """
    rows = {r["snapshot_id"]: r for r in log.select("snapshot_id", "parent_id", "committed_at").distinct().collect()}
    if not rows:
        raise ValueError("no snapshot")
    at = max(rows.values(), key=lambda r: (r["committed_at"], r["snapshot_id"]))["snapshot_id"] if snapshot is None else snapshot
    if at not in rows:
        raise ValueError(f"unknown snapshot {snapshot}")
    chain = []
    while at is not None:
        chain.append(at)
        at = rows[at]["parent_id"]
    paths = [r["path"] for r in log.where(F.col("snapshot_id").isin(chain)).select("path").distinct().collect()]
    return log.sparkSession.read.parquet(*paths)


def commit_batches(df: DataFrame, batch: Column, batches: Sequence[int], label: str) -> DataFrame:
    """Writes each batch of df as one snapshot below a new folder; returns the log."""
    spark, root = df.sparkSession, new_path(df.sparkSession, label)
    df.withColumn("_batch", batch).write.partitionBy("_batch").parquet(root)
    log = [(b, batches[i - 1] if i else None, i, f"{root}/_batch={b}") for i, b in enumerate(batches)]
    return spark.createDataFrame(log, "snapshot_id long, parent_id long, committed_at long, path string")


def snapshot_files(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """path of each file of a snapshot: those of it and its ancestors, as a table. None is the latest snapshot.

    A path of the log may be a folder. The log isn't brought to the driver: ancestors are found by doubling, in as many
    rounds as the logarithm of their number.
    """
    commits = log.select(F.col("snapshot_id").alias("node"), F.col("parent_id").alias("parent"), "committed_at").distinct()
    own = commits.where(F.col("node") == snapshot) if snapshot is not None else commits.orderBy(F.desc("committed_at"), F.desc("node")).limit(1)
    if own.isEmpty():
        raise ValueError("no snapshot" if snapshot is None else f"unknown snapshot {snapshot}")
    chain = ancestors(commits.select("node", "parent").distinct(), own)
    places = log.join(chain.withColumnRenamed("node", "snapshot_id"), "snapshot_id", "left_semi").select("path").distinct()

    def listed(frames):
        from pyarrow import fs

        for frame in frames:
            out = []
            for p in frame["path"]:
                files, inner = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", p))
                head = p[: len(p) - len(inner)] if p.endswith(inner) else p.split(":")[0] + ":"
                info = files.get_file_info(inner)
                found = [info] if info.is_file else files.get_file_info(fs.FileSelector(inner, recursive=True))
                out += [head + f.path for f in found if f.is_file and f.path.endswith(".parquet")]
            yield pd.DataFrame({"path": out})

    return stored(places.mapInPandas(listed, "path string").distinct(), "files")


def read_files(files: DataFrame, schema: StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of the Parquet files that a table names in path, read where the rows of that table are."""
    wanted = StructType([f for f in schema.fields if columns is None or f.name in columns])
    names = wanted.names

    def read(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            for p in b.column("path").to_pylist():
                own, inner = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", p))
                with own.open_input_file(inner) as f:
                    yield from (x.select(names) for x in pq.ParquetFile(f).iter_batches(columns=names))

    return files.select("path").repartition("path").mapInArrow(read, wanted)


def manifest_difference(log: DataFrame, before: int, after: int, schema: StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that only one of two snapshots has, labelled; repeated rows count. Files that both have are left out first, as
    they add the same to both, so only files that differ are read."""
    old, new = snapshot_files(log, before), snapshot_files(log, after)
    only = lambda a, b: read_files(a.join(b, "path", "left_anti"), schema, columns)
    return difference(only(old, new), only(new, old))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, labelled; repeated rows count."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


# ---------------------------------------------------------------- listings
def listing(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """path, length and modification time of the files below path; contents aren't read."""
    return binary_files(spark, path, names).select("path", "length", "modificationTime")


def binary_files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)


def prefix_fingerprint(spark: SparkSession, path: str, parts: int = 4096) -> DataFrame:
    """A digest of the name:size:time of the files below path, in any order; for a missing path of the word missing.

    The files are dealt to `parts` by a hash of their names; the digest of each part's sorted entries comes first, then
    the digest of the parts' digests, so no task holds all entries.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.range(1).select(F.sha2(F.lit("missing"), 256).alias("fingerprint"), F.lit(0).cast("long").alias("files"))
    entry = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "length", F.unix_micros("modificationTime"))
    return entries_fingerprint(listing(spark, path).select(entry.alias("entry")), parts)


def entries_fingerprint(entries: DataFrame, parts: int = 4096) -> DataFrame:
    """fingerprint, files: over the strings entry."""
    part = F.conv(F.substring(F.sha2("entry", 256), 1, 8), 16, 10).cast("long") % parts
    own = entries.groupBy(part.alias("part")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("entry"))), 256).alias("d"), F.count("*").alias("n"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"])
    return own.agg(F.sha2(F.concat_ws("\n", joined), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def stale_statistics(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded files that changed or are gone. Remote files (an object-store path) are never stale."""
    now = current.select(F.col("path").alias("p"), F.col("length").alias("l"), F.col("modificationTime").alias("m"))
    out = recorded.join(now, F.col("path") == F.col("p"), "left")
    local = ~F.col("path").rlike("^(s3a?|gs|abfss?)://")
    why = F.when(F.col("p").isNull(), "gone").when((F.col("length") != F.col("l")) | (F.col("modificationTime") != F.col("m")), "changed")
    return out.select("path", F.when(local, why).alias("reason")).where("reason IS NOT NULL")


def schema_rows(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """A row for each column of each frame: table_name, ordinal, column_name, type, nullable."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for name, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, nullable boolean")


def schema_fingerprints(columns: DataFrame) -> DataFrame:
    """SHA-256 per table over its sorted column:type:nullable."""
    entry = F.concat_ws(":", "column_name", "type", F.col("nullable").cast("string"))
    return columns.groupBy("table_name").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(entry))), 256).alias("fingerprint"))


def jdbc_options(url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> dict[str, str]:
    """Options of a read-only JDBC scan; with a partition column the read is dealt to that many tasks."""
    out = {"url": url, "fetchsize": "10000", "sessionInitStatement": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY" if url.startswith("jdbc:postgresql") else ""}
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        out |= {"dbtable": f"({query}) q", "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    else:
        out["query"] = query
    return {k: v for k, v in out.items() if v}


def read_database(spark: SparkSession, url: str, query: str, **more) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **more)).load()


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    out = spark.read.csv(path, schema=schema, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    return out.select(*columns) if columns else out


# ---------------------------------------------------------------- incremental writes
def insert_if_absent(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of delta whose key target lacks; of rows with the same key in delta one."""
    return delta.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def after_high_water(source: DataFrame, target: DataFrame, ts: str, look_back_days: int) -> DataFrame:
    """Rows of source after target's largest ts; with an empty target those of the last days of source."""
    high = target.agg(F.max(ts).alias("hwm")).crossJoin(source.agg(F.max(ts).alias("last")))
    mark = F.coalesce("hwm", F.col("last") - F.make_dt_interval(F.lit(look_back_days)))
    return source.crossJoin(high.select(mark.alias("_mark"))).where(F.col(ts) > F.col("_mark")).drop("_mark")
