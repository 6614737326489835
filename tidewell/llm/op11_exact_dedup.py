"""Exact deduplication of deliveries against an index of immutable snapshots, screened by binary-fuse filters.

Texts are equal when they are identical once white space is deleted. A delivery takes these steps:

1. Its documents are grouped by the SHA-256 of the normalised text (counted before the shuffle): duplicates within the
   delivery. Each group knows its size and the document that stays.
2. The groups' keys (60 bits of the digest) are screened by the filters of each snapshot, a filter for each shard of the
   keys. A key that no filter knows is new for certain, and of its text nothing is read.
3. The others' texts are joined with the exact buckets of the snapshot, and compared byte for byte. The buckets lie in a
   table that is bucketed by key, so the stored texts aren't shuffled, whatever their number: the few texts that the
   filters let through go to them. Groups that are equal to a stored text join its group.
4. The texts of new groups become a snapshot: buckets first, then filters. It counts once its filters are complete, and
   is never changed.

A filter has three places for each key, and the exclusive or of what stands there is the key's fingerprint. It is built by
peeling places that only one key has, a round at a time with numpy, and filled in the reverse order: 9 bits a key for 8-bit
fingerprints, of which one in 256 keys that aren't there passes.

No task holds a group: copies are counted before shuffles, digests of very many documents are joined by broadcast
(`common.join_groups`), and their copies don't travel with their texts.

Cases: a null text counts as empty. Repeated rows of the document that stays are all kept; of rows with one doc_id and
other white space the longer one is. A null doc_id comes last among equals. Empty tables give no rows, and an empty
snapshot knows nothing. Texts of any length are compared whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import join_groups, spread, tidied, whole_text
from tidewell.session import new_path, stored, table

FILTERS = "shard int, shards int, buckets int, n_keys long, seed long, fingerprints binary"
KEY_BITS = 60


# ---------------------------------------------------------------- the filter
def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key."""
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for times, shift in ((0xFF51AFD7ED558CCD, 33), (0xC4CEB9FE1A85EC53, 33), (1, 33)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h


def filter_shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments that the first of the three places may lie in."""
    length = 1 << min(18, max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    places = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(places / length)) - 2)


def places_of(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three places of each hash, in three segments that follow each other."""
    low = np.uint64(length - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * length)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64)


def fingerprints_of(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, the place of each) by rounds: places that one key alone has, when those of the rounds before are gone."""
    n = places.shape[1]
    count, link = np.bincount(places.ravel(), minlength=size), np.zeros(size, np.int64)
    for row in places:
        np.bitwise_xor.at(link, row, np.arange(n))
    rounds, free = [], np.flatnonzero(count == 1)
    while len(free):
        keys, at = np.unique(link[free], return_index=True)
        rounds.append((keys, free[at]))
        touched = places[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(link, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        free = touched[count[touched] == 1]
    return rounds


def build_filter(keys: np.ndarray, tries: int = 100) -> tuple[int, bytes]:
    """seed and fingerprints of a filter of distinct keys."""
    length, segments = filter_shape(len(keys))
    size = (segments + 2) * length
    for seed in range(tries):
        h = mixed(keys, seed)
        places = places_of(h, length, segments)
        rounds = peel(places, size)
        if sum(len(k) for k, _ in rounds) == len(keys):
            break
    else:
        raise ValueError(f"no filter for {len(keys)} keys: are they distinct?")
    out, own = np.zeros(size, np.uint8), fingerprints_of(h)
    for k, at in reversed(rounds):
        out[at] = own[k] ^ np.bitwise_xor.reduce(out[places[:, k]], axis=0)
    return seed, out.tobytes()


def passes(keys: np.ndarray, n_keys: int, seed: int, fingerprints: bytes) -> np.ndarray:
    """Whether a filter of n_keys keys may hold each key; True for all that it does hold."""
    if not n_keys:
        return np.zeros(len(keys), bool)
    h = mixed(keys, seed)
    held = np.frombuffer(fingerprints, np.uint8)[places_of(h, *filter_shape(n_keys))]
    return np.bitwise_xor.reduce(held, axis=0) == fingerprints_of(h)


# ---------------------------------------------------------------- documents and groups
def normalised() -> Column:
    return F.regexp_replace(whole_text(), r"[\x20\x09-\x0D]+", "")


def digested(docs: DataFrame, *more: Column, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, n_chars (of the text as it is), digest, key, and columns that are asked for."""
    hexed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(whole_text()).cast("long").alias("n_chars"), F.sha2(normalised(), 256).alias("hex"), *more)
    key = F.shiftright(F.conv(F.substring("hex", 1, 15), 16, 10).cast("long"), KEY_BITS - key_bits)
    return hexed.withColumns({"digest": F.unhex("hex"), "key": key}).drop("hex")


def grouped(keyed: DataFrame) -> DataFrame:
    """A row for each digest: key, size, and best, the n_chars and doc_id of the document that stays."""
    backwards = F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1)))  # the smallest id is the largest, without overflow
    return keyed.groupBy("digest", "key").agg(F.count("*").alias("size"), F.max(F.struct("n_chars", backwards.alias("backwards"), "doc_id")).alias("best"))


def texts_of(docs: DataFrame, groups: DataFrame, hot_rows: int = 1000, hot_share: int = 20_000, key_bits: int = KEY_BITS) -> DataFrame:
    """digest, key and normalised text of the documents of the groups (stored): of hot ones that of one document alone.

    Groups of at most hot_rows documents, or a hot_share-th of all, may come with several rows.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    hot = groups.where(F.col("size") > max(hot_rows, total // hot_share)).select("digest", F.col("best.doc_id").alias("of"), F.col("best.n_chars").alias("of_chars"))
    own = digested(docs, normalised().alias("norm"), key_bits=key_bits).join(F.broadcast(hot), "digest", "left")
    one = F.col("of_chars").isNull() | (F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("n_chars") == F.col("of_chars")))
    return own.where(one).select("digest", "key", "norm")


# ---------------------------------------------------------------- snapshots
def _bucketed(spark: SparkSession, path: str, buckets: int) -> str:
    """A name for the bucketed texts at path, to be dropped after use: the files stay."""
    name = f"texts_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (key BIGINT, digest BINARY, norm STRING) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def _built(shards: int, buckets: int):
    def run(key: tuple, keys: pa.Table) -> pa.Table:
        own = np.unique(keys["key"].to_numpy())
        seed, fingerprints = build_filter(own)
        row = dict(zip([c.split()[0] for c in FILTERS.split(", ")], (key[0].as_py(), shards, buckets, len(own), seed, fingerprints)))
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("buckets", pa.int32()), ("n_keys", pa.int64()), ("seed", pa.int64()), ("fingerprints", pa.binary())]))

    return run


def _once(texts: DataFrame, buckets: int) -> DataFrame:
    """Texts by bucket, each digest once."""
    return texts.repartition(buckets, "key").groupBy("key", "digest").agg(F.first("norm").alias("norm"))


def write_snapshot(texts: DataFrame, groups: DataFrame, path: str, keys_per_shard: int = 50_000, bucket_chars: int = 32_000_000, most_buckets: int = 100_000) -> None:
    """The snapshot at path: the texts (digest, key, norm; a digest may come with several rows) of groups, and its filters."""
    spark = texts.sparkSession
    n, chars = groups.agg(F.count("*"), F.coalesce(F.sum("best.n_chars"), F.lit(0))).first()
    # as many buckets as other shuffles have partitions at least: a later delivery may be larger, and what passes the filters
    # by chance is dealt to them; Spark takes at most most_buckets
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = spread(n, keys_per_shard), min(most_buckets, max(least, spread(chars, bucket_chars)))
    name = f"texts_{uuid.uuid4().hex}"
    _once(texts, buckets).write.bucketBy(buckets, "key").option("path", f"{path}/texts").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    sharded = groups.select((F.col("key") % shards).cast("int").alias("shard"), "key")
    sharded.groupBy("shard").applyInArrow(_built(shards, buckets), FILTERS).write.parquet(f"{path}/filters")


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """The paths of the complete snapshots of an index, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/s=*/filters/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(s.getPath().getParent().getParent().toString() for s in found)


def _screened(key: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
    own, known = keys["key"].to_numpy(), np.zeros(len(keys), bool)
    for f in filters.to_pylist():
        known |= passes(own, f["n_keys"], f["seed"], f["fingerprints"])
    return pa.table({"digest": keys["digest"].filter(pa.array(known)), "key": own[known]})


def screen(groups: DataFrame, path: str) -> DataFrame:
    """digest and key of the groups that the filters of a snapshot let through."""
    filters = groups.sparkSession.read.schema(FILTERS).parquet(f"{path}/filters")
    shards = (filters.agg(F.max("shards")).first()[0]) or 1
    keys = groups.select((F.col("key") % shards).cast("int").alias("shard"), "digest", "key")
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screened, "digest binary, key long")


def equal_texts(texts: DataFrame, path: str) -> DataFrame:
    """digest of the texts (digest, key, norm) that a snapshot holds, and stored_digest of its text. Stored texts aren't shuffled."""
    spark = texts.sparkSession
    buckets = spark.read.schema(FILTERS).parquet(f"{path}/filters").agg(F.max("buckets")).first()[0]
    if buckets is None:
        return spark.createDataFrame([], "digest binary, stored_digest binary")
    name = _bucketed(spark, f"{path}/texts", buckets)
    try:
        exact = spark.table(name).select("key", F.col("digest").alias("stored_digest"), F.col("norm").alias("stored"))
        both = exact.join(_once(texts, buckets).hint("shuffle_hash"), "key")
        # two inequalities: as an equality it would become a key of the join, and move the stored texts
        same = (F.col("norm") <= F.col("stored")) & (F.col("norm") >= F.col("stored"))
        return stored(both.where(same).select("digest", "stored_digest").distinct(), "equal")
    finally:
        spark.sql(f"DROP TABLE {name}")


def ingest(docs: DataFrame, keyed: DataFrame, folder: str, keep: bool = True, key_bits: int = KEY_BITS, hot_rows: int = 1000, **shape: int) -> DataFrame:
    """Takes a delivery into the index at folder: a row for each of its groups, with root, the digest of the equal text that
    came first (its own one for a new text), known (whether a snapshot has it), size and best; stored.

    keyed: digested(docs), stored. keep: write the new texts as a snapshot; shape: parameters of write_snapshot.
    """
    spark, groups = docs.sparkSession, stored(grouped(keyed), "groups")
    texts, equal = texts_of(docs, groups, hot_rows, key_bits=key_bits), []
    if paths := snapshots(spark, folder):
        maybe = stored(reduce(DataFrame.unionByName, [screen(groups, path) for path in paths]).select("digest").distinct(), "screened")
        # texts are shuffled once, for any number of snapshots; at every size, as deliveries of a large index need it
        candidates = stored(texts.join(maybe.hint("shuffle_hash"), "digest", "left_semi"), "candidates")
        equal = [equal_texts(candidates, path) for path in paths]
    known = reduce(DataFrame.unionByName, equal) if equal else spark.createDataFrame([], "digest binary, stored_digest binary")
    out = stored(groups.join(known, "digest", "left").select("digest", "key", F.coalesce("stored_digest", "digest").alias("root"), F.col("stored_digest").isNotNull().alias("known"), "size", "best"), "ingested")
    if keep:
        fresh = texts if not equal else texts.join(known.select("digest"), "digest", "left_anti")
        write_snapshot(fresh, out.where("NOT known"), f"{folder}/s={len(snapshots(spark, folder)):06d}", **shape)
    return out


def deduplicated(deliveries: list[tuple[DataFrame, DataFrame]], folder: str, hot_rows: int = 1000, **more: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of each document of some deliveries (docs, keyed), in their order.

    The last one is screened like the others, but nothing comes after it, so it leaves no snapshot.
    """
    last = len(deliveries) - 1
    entries = [ingest(docs, keyed, folder, i < last, hot_rows=hot_rows, **more) for i, (docs, keyed) in enumerate(deliveries)]
    groups = stored(reduce(DataFrame.unionByName, entries).groupBy(F.col("root").alias("digest")).agg(F.sum("size").alias("group_size"), F.max("best").alias("best")), "groups")
    # a text that is equal to a stored one has the digest of its root
    rows = join_groups(reduce(DataFrame.unionByName, [keyed.select("doc_id", "n_chars", "digest") for _, keyed in deliveries]), groups, "digest", "group_size", hot_rows)
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == F.col("best.n_chars"))
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two deliveries, which together are the whole table: the second one meets the snapshot of the
    first. All digests are taken in one pass."""
    delivery = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    docs = table(spark, sf_dir, "documents")
    keyed = stored(digested(docs, delivery.alias("delivery")), "digests")
    parts = [(docs.where(delivery == k), keyed.where(F.col("delivery") == k)) for k in (0, 1)]
    rows = deduplicated(parts, new_path(spark, "snapshots"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, arg_max(doc_id, (n_chars, -doc_id)) AS keep_id FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
