"""Deterministic sharded WARC writer and reader.

write_warc sorts the records by key over ranges, rolls files by compressed size, builds all headers and digests anew,
writes each file under a temporary name and renames it when it is whole, and ends with a manifest. Only files of the
manifest count, so an attempt that dies leaves nothing that a reader sees. The borders of the ranges follow from the
table alone (every `range_bytes` of payload in the order of the keys), so any cluster and any number of partitions gives
the same files, and an attempt that runs again gives the same bytes under the same name: it leaves a file that is there
already as it is. Temporary files of dead attempts are deleted at the end.

Of records with equal payloads (equal SHA-1 of at least min_dedup bytes), the one with the largest page_id keeps the
payload; the others become revisit records that refer to it. A record is named by page_id, digest and its number among
the equal ones.

Cases: null html is an empty payload; a null url gives a record without target; a null page_id is never referred to
and sorts first. Repeated rows with the largest page_id are responses all. Pages with one page_id stand in the order of
digest and url. Empty tables give an empty archive. Payloads of any length are written whole. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import filesystem, partition_keys, spread, whole_text
from tidewell.operators.registry import running_total
from tidewell.session import new_path, table

MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null page_id in the order of the keys.
NO_PAGE = -(1 << 63)


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, name: str, date: str, body: bytes, more: list[str], content: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", *more]
    head += [f"WARC-Block-Digest: sha1:{_b32(body)}", f"Content-Type: {content}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _urn(page_id: int | None, digest: str, copy: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}:{copy}"


def _page_record(page_id, url, html, digest: str, copy: int, n_bytes: int, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    more = [] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)]
    more.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        more += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to, digest, 0)}>"]
        body = http
    else:
        body = http + html.encode()
    return _record("response" if refers_to is None else "revisit", _urn(page_id, digest, copy), date, body, more, "application/http; msgtype=response")


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """A file that is written under a temporary name."""

    def __init__(self, folder: str, name: str, first: int | None):
        self.fs, self.root = filesystem(folder)
        self.name, self.first, self.last, self.records, self.bytes, self.sha = name, first, first, 0, 0, hashlib.sha256()
        self.temporary = f"{self.root}/.{name}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def add(self, member: bytes) -> None:
        self.stream.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def _there(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(f"{self.root}/{self.name}").type == fs.FileType.File

    def commit(self) -> tuple:
        """Renames the file. One that is there comes from an attempt with the same rows, so it holds the same bytes."""
        self.stream.close()
        try:
            if self._there():
                self.fs.delete_file(self.temporary)
            else:
                self.fs.move(self.temporary, f"{self.root}/{self.name}")
        except OSError:
            if not self._there():
                raise
            self.drop()
        return self.name, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last

    def drop(self) -> None:
        try:
            self.stream.close()
            self.fs.delete_file(self.temporary)
        except OSError:
            pass  # gone already; the writer's end deletes what is left


def _writer(folder: str, roll_bytes: int, level: int, date: str):
    def manifest(rows) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["file", "records", "bytes", "sha256", "first_page", "last_page"])
        return out.astype({"first_page": "Int64", "last_page": "Int64"})

    def run(frames):
        shard, now, seq = None, None, 0
        told: dict = {}  # (page_id, digest) -> refers_to of the page at hand
        copies: dict = {}  # (page_id, digest) -> records so far, of the page at hand
        try:
            for frame in frames:
                rows = []
                for range_, key, url, html, digest, n_bytes, refers_to in frame[["range", "key", "url", "html", "digest", "n_bytes", "refers_to"]].itertuples(index=False):
                    page_id = None if key == NO_PAGE else key
                    if html is None:
                        told = {k: v for k, v in told.items() if k[0] == page_id} | {(page_id, digest): int(refers_to)}
                        continue
                    if shard and range_ != now:
                        rows.append(shard.commit())
                        shard = None
                    if range_ != now:
                        now, seq = range_, 0
                    if shard is None:
                        name = f"shard-{range_:06d}-{seq:05d}.warc.gz"
                        shard = _Shard(folder, name, page_id)
                        shard.add(_member(_record("warcinfo", f"urn:shard:{name}", date, b"format: WARC File Format 1.1\r\n", [f"WARC-Filename: {name}"], "application/warc-fields"), level))
                    copies = {k: v for k, v in copies.items() if k[0] == page_id}
                    copy = copies[page_id, digest] = copies.get((page_id, digest), -1) + 1
                    shard.add(_member(_page_record(page_id, url, html, digest, copy, int(n_bytes), told.get((page_id, digest)), date), level))
                    shard.records += 1
                    shard.last = page_id
                    if shard.bytes >= roll_bytes:
                        rows.append(shard.commit())
                        shard, seq = None, seq + 1
                if rows:
                    yield manifest(rows)
            if shard:
                last, shard = shard, None
                yield manifest([last.commit()])
        finally:
            if shard:
                shard.drop()

    return run


def warc_records(pages: DataFrame, min_dedup: int = 1000) -> DataFrame:
    """key (page_id, or NO_PAGE), url, html, digest, n_bytes of each page; beside them a row with refers_to and no html for
    each revisit.

    The rows of the second kind come from page_id and digest alone, so the pages themselves are shuffled once, by the
    writer, which reads a page's row after those that tell what it refers to.
    """
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("key")
    own = pages.select(key, F.col("url").cast("string").alias("url"), whole_text("html").alias("html"))
    own = own.withColumns({"digest": F.sha1(F.encode("html", "utf-8")), "n_bytes": F.octet_length("html").cast("long")})
    small = own.where(F.col("n_bytes") >= min_dedup).select("key", "digest")
    keepers = small.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = small.join(keepers, "digest").where((F.col("refers_to") != NO_PAGE) & (F.col("key") != F.col("refers_to"))).distinct()
    return own.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits, allowMissingColumns=True)


def range_borders(records: DataFrame, range_bytes: int, max_ranges: int) -> list[tuple]:
    """The first (key, digest) of each range of about range_bytes of payload, in order; more bytes where there would be
    over max_ranges, which bounds what the driver holds. They follow from the rows alone."""
    keys = records.where("html IS NOT NULL").groupBy("key", "digest").agg(F.sum("n_bytes").alias("total"))
    run = running_total(keys, ["key", "digest"], "total")
    total = run.agg(F.max(F.col("before") + F.col("total"))).first()[0] or 0
    each = max(range_bytes, spread(total, max_ranges))
    return sorted(tuple(r) for r in run.groupBy(F.floor(F.col("before") / each)).agg(F.min(F.struct("key", "digest")).alias("k")).select("k.*").collect())


def write_warc(records: DataFrame, folder: str, roll_bytes: int = 32_000_000, level: int = 5, date: str = "1970-01-01T00:00:00Z", range_bytes: int = 24_000_000, max_ranges: int = 20_000) -> DataFrame:
    """Writes records (as warc_records gives them) below folder; returns the manifest, stored in folder/manifest."""
    spark = records.sparkSession
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    borders = range_borders(records, range_bytes, max_ranges)
    tasks = partition_keys(spark, max(1, len(borders)))

    @F.pandas_udf("range int, task int")
    def dealt_to(key: pd.Series, digest: pd.Series) -> pd.DataFrame:
        ranges = [max(0, bisect.bisect_right(borders, k) - 1) for k in zip(key, digest)]
        return pd.DataFrame({"range": ranges, "task": [tasks[r] for r in ranges]})

    dealt = records.withColumn("to", dealt_to("key", "digest")).select("*", "to.range", "to.task").drop("to").repartition(len(tasks), "task")
    dealt = dealt.sortWithinPartitions("range", "key", "digest", F.col("html").isNotNull(), "url")
    dealt.mapInPandas(_writer(folder, roll_bytes, level, date), MANIFEST).write.parquet(f"{folder}/manifest")
    # what attempts that died have left
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, ".shard-*.tmp")) or []:
        files.delete(status.getPath(), False)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def iterate_members(stream, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member of a file; holds one member at a time."""
    z, at, held, used = zlib.decompressobj(31), 0, [], 0
    data = stream.read(chunk)
    while data:
        held.append(z.decompress(data))
        used += len(data) - len(z.unused_data)
        if z.eof:
            yield at, b"".join(held)
            data, at, held = z.unused_data or stream.read(chunk), used, []
            z = zlib.decompressobj(31)
        else:
            data = stream.read(chunk)
    if held:
        raise ValueError("the last member isn't whole")


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{_b32(body)}":
        raise ValueError(f"digest mismatch in {fields['WARC-Record-ID']}")
    return fields, body


def _reader(folder: str):
    def page(x: str):
        return int(x) if (x := x.strip("<>").removeprefix("urn:page:").split(":")[0]) else None

    def run(frames):
        fs, root = filesystem(folder)
        for frame in frames:
            for name in frame["file"]:
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for at, raw in iterate_members(stream):
                        fields, body = parse_record(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = body.partition(b"\r\n\r\n")
                        n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if fields["WARC-Type"] == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload mismatch in {fields['WARC-Record-ID']}")
                        refers = page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                        rows.append((page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n_bytes, digest, fields["WARC-Type"], refers, name, at))
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "at"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page record of the files that the manifest names; digests and payloads are verified on the way."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    n = max(1, manifest.count())
    return manifest.repartition(n, "file").mapInPandas(_reader(folder), RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_warc(warc_records(table(spark, sf_dir, "pages")), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
