"""Data skipping: an index of a table's files that decides which of them a scan opens.

The index is a table itself. Its zones have, for each file, the rows and, by column, minimum, maximum and nulls; its blooms
have, for columns of many values, bits that the hashes of a file's values set. A bloom is dealt to buckets of 32,768 bits for each
hash, and a value's bits all lie in the bucket that its hash names, so looking a value up reads one bucket of each file. How
many bits there are for a value follows from the number of files, so that a look-up opens no more needless ones in a table
of many files. A scan reads
the zones with its filters, of the blooms only the buckets of its values, and then opens the files that are left; the
filters are exact afterwards, as an index only tells which files can't hold a row.

refresh() indexes the files that are new or have changed and forgets those that are gone; all are indexed anew when they are
more than twice as many as when the bits were chosen. Each state of the index is a
folder of its own that counts when it is complete, so a scan that has begun isn't disturbed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import stored
from tidewell.sources.scan import Filter, file_zone_map, listing, prune, scan

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768
BLOOMS = "column_name string, bucket int, path string, bits array<binary>"


def bits_per_value(files: int, needless: float, hashes: int) -> float:
    """Bits of a bloom for each value, so that looking a value up finds about so many needless ones of the files."""
    filled = min(0.5, (needless / max(1, files)) ** (1 / hashes))
    return hashes / -math.log1p(-filled)


def _buckets(rows: Column, bits: float, hashes: int) -> Column:
    return F.greatest(F.ceil(rows * F.lit(bits) / (hashes * BITMAP_BITS)), F.lit(1))


def _bits(value: Column, buckets: Column | int, hashes: int) -> tuple[Column, list[Column]]:
    """The bucket of a value, and the places of its bits in it. Equal values of any type of whole numbers have equal places."""
    h = F.xxhash64(value.cast("string"))
    places = [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BITMAP_BITS)).cast("int") for k in range(hashes)]
    return F.pmod(h, F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int"), places


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0


class SkippingIndex:
    """The index at a path, of the Parquet files below another one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- building
    def build(self, data: str, columns: Sequence[str], blooms: Sequence[str] = (), needless: float = 0.1, hashes: int = 5) -> SkippingIndex:
        """Indexes all files below data: bounds of columns, and blooms of others. needless: how many files without a value its
        look-up may find on average."""
        return self._write(data, list(columns), list(blooms), needless, hashes, None)

    def refresh(self) -> int:
        """Brings the index up to date with the files; how many files were read."""
        m = self._meta()
        before = self.zones()
        now = listing(self.spark, m["data"], "*.parquet").select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
        if now.count() > 2 * m["files"]:
            return self._write(m["data"], list(m["columns"]), list(m["blooms"]), m["needless"], m["hashes"], None).zones().count()
        kept = stored(before.join(now, ["path", "bytes", "changed"], "left_semi"), "zones")
        fresh = [r[0] for r in now.join(kept.select("path"), "path", "left_anti").select("path").collect()]  # they are about to be opened
        if fresh or kept.count() < before.count():
            self._write(m["data"], list(m["columns"]), list(m["blooms"]), m["needless"], m["hashes"], (kept, fresh))
        return len(fresh)

    def _write(self, data: str, columns: list, blooms: list, needless: float, hashes: int, since: tuple | None) -> SkippingIndex:
        old = self._generation()
        folder = f"{self.path}/g={old + 1:06d}"
        files = listing(self.spark, data, "*.parquet").select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
        paths = since[1] if since else [r[0] for r in files.select("path").collect()]
        zones, rows = since[0] if since else None, None
        if paths:
            rows = self.spark.read.parquet(*paths)
            own = file_zone_map(rows.select("*", "_metadata"), columns).withColumnRenamed("zone", "path").join(files, "path")
            zones = own if zones is None else zones.unionByName(own)
        if zones is None:
            raise ValueError(f"no Parquet files below {data}")
        meant = self._meta()["files"] if since else len(paths)
        bits = bits_per_value(meant, needless, hashes)
        schema = rows.schema.json() if rows is not None else self._meta()["schema"]
        zones.repartitionByRange("path").write.parquet(f"{folder}/zones")
        zones = self.spark.read.schema(zones.schema).parquet(f"{folder}/zones")
        self._blooms(rows, blooms, bits, hashes, zones, old, since).repartitionByRange("column_name", "bucket").sortWithinPartitions("column_name", "bucket").write.parquet(f"{folder}/blooms")
        meta = [(data, columns, blooms, meant, needless, bits, hashes, schema)]
        self.spark.createDataFrame(meta, "data string, columns array<string>, blooms array<string>, files int, needless double, bits_per_value double, hashes int, schema string").coalesce(1).write.parquet(f"{folder}/meta")
        return self

    def _blooms(self, rows: DataFrame | None, blooms: list, bits: float, hashes: int, zones: DataFrame, old: int, since: tuple | None) -> DataFrame:
        parts = []
        if rows is not None and blooms:
            # buckets follow a file's rows, so a bucket has about as many values in any file
            sizes = zones.select("path", _buckets(F.col("num_rows"), bits, hashes).alias("buckets"))
            for c in blooms:
                values = rows.where(F.col(c).isNotNull()).select(F.col("_metadata.file_path").alias("path"), F.col(c).alias("value")).join(sizes, "path")
                bucket, places = _bits(F.col("value"), F.col("buckets"), hashes)
                own = values.select("path", bucket.alias("bucket"), *[p.cast("long").alias(f"place_{k}") for k, p in enumerate(places)])
                bitmaps = F.array(*[F.bitmap_construct_agg(f"place_{k}") for k in range(hashes)])
                parts.append(own.groupBy(F.lit(c).alias("column_name"), "bucket", "path").agg(bitmaps.alias("bits")))
        if since:  # what stays of the files that are still there
            kept = self.spark.read.schema(BLOOMS).parquet(f"{self.path}/g={old:06d}/blooms")
            parts.append(kept.join(since[0].select("path"), "path", "left_semi"))
        none = self.spark.createDataFrame([], BLOOMS)
        return reduce(DataFrame.unionByName, parts).select(*[f.split()[0] for f in BLOOMS.split(", ")]) if parts else none

    # ---- reading
    def _generation(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/g=*/meta/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(s.getPath().getParent().getParent().getName()[2:]) for s in found), default=0)

    def _read(self, name: str) -> DataFrame:
        now = self._generation()
        if not now:
            raise FileNotFoundError(f"no index at {self.path}")
        return self.spark.read.parquet(f"{self.path}/g={now:06d}/{name}")

    def _meta(self):
        return self._read("meta").first()

    def zones(self) -> DataFrame:
        """path, bytes, changed, num_rows, and min_, max_, nulls_ of the columns, a row for each file."""
        return self._read("zones")

    def surviving(self, filters: Sequence[Filter]) -> DataFrame:
        """The zones of the files that can hold rows which pass all filters."""
        meta, zones = self._meta(), self.zones()
        left = prune(zones, filters)
        for c, _, _ in filters:
            if f"nulls_{c}" in zones.columns:  # no comparison holds for nulls
                left = left.where(F.col(f"nulls_{c}") < F.col("num_rows"))
        for c, op, v in filters:
            if op == "=" and c in meta["blooms"]:
                sized = left.select("path", _buckets(F.col("num_rows"), meta["bits_per_value"], meta["hashes"]).alias("buckets"))
                kind = T.StructType.fromJson(json.loads(meta["schema"]))[c].dataType
                bucket, places = _bits(F.lit(v).cast(kind), F.col("buckets"), meta["hashes"])
                wanted = sized.select("path", bucket.alias("bucket"))
                rows = self._read("blooms").where(F.col("column_name") == c).join(wanted, ["path", "bucket"])
                hit = reduce(Column.__and__, [_is_set(F.col("bits")[k], p) for k, p in enumerate(places)])
                left = left.join(rows.where(hit).select("path"), "path", "left_semi")
        return left

    def scan(self, columns: Sequence[str] | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
        """The rows that pass the filters, from the surviving files alone."""
        paths = [r[0] for r in self.surviving(filters).select("path").collect()]  # the files to open
        schema = T.StructType.fromJson(json.loads(self._meta()["schema"]))
        return scan(self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema), columns, filters)
