"""Token counts through a digest cache.

The digest of the normalised content (here: null as empty, nothing else changed, as the counts must be those of the
exact text) and the digest of the tokenizer's file are the key of a stored count. A call

1. takes the digests of the documents, and counts the documents of each,
2. joins them with the cache; a digest without a stored count is a miss, for which one document is chosen,
3. encodes the chosen documents only, and appends their counts to the cache,
4. joins every document with the cache.

Texts are shuffled for step 3 only, by digest and document, so copies of a text don't meet in a task; when the cache
knows nearly all, the planner sends the few misses to the texts instead. In step 4 digests of very many documents are
few by definition (`hot_share`), and are joined by broadcast; all others have bounded numbers of documents.

Cases: a null text counts as empty (0 bytes, 0 tokens). Repeated rows, and rows with equal or null doc_ids, give a row
each. Empty tables give no rows. Other columns of the input are ignored, whatever their names. Texts of any length are
encoded whole. Of copies the one with the smallest doc_id is encoded.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import tidied, whole_text
from tidewell.llm.tokenizers_io import load, public_path
from tidewell.session import new_path, stored, table

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def run(batches):
        counter = load("count", path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counter.counts(b.column("text")))], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, cache_path: str | None = None, over: int = 4096, hot_rows: int = 1000, hot_share: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and the digest of each document.

    cache_path: a Parquet folder that this call reads and appends to; without one, a new folder in the shared place.
    Two calls that append the same digest at once do no harm: the cache is read with its repeats removed.
    hot_rows: documents from which a digest may count as hot. hot_share: at most so many digests do.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(model_path)
    cache_path = cache_path or new_path(spark, "token-cache")
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), whole_text().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = stored(own.select("doc_id", "id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    digests = stored(keyed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n")), "digests")
    misses = stored(digests.join(stored_counts(spark, cache_path, version), "digest", "left_anti").select("digest", "id"), "misses")
    # rows that repeat the chosen document stand in one partition with it after the join
    chosen = own.select("digest", "id", "text").join(misses, ["digest", "id"], "left_semi").groupBy("digest", "id").agg(F.first("text").alias("text"))
    fresh = chosen.select("digest", "text").mapInArrow(tidied(_encode(model_path)), "digest binary, n_tokens long")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    # kept apart from the cache, which later calls change
    cached = stored(digests.select("digest", "n").join(stored_counts(spark, cache_path, version), "digest"), "counts")
    n_rows = digests.agg(F.sum("n")).first()[0] or 0
    most = max(hot_rows, n_rows // hot_share)
    hot = F.broadcast(cached.where(F.col("n") > most).select("digest", "n_tokens"))
    rest = keyed.join(hot.select("digest"), "digest", "left_anti").join(cached.where(F.col("n") <= most).select("digest", "n_tokens"), "digest")
    rows = keyed.join(hot, "digest").unionByName(rest)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))


def stored_counts(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest, n_tokens of a tokenizer version, each digest once; no rows where nothing is stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return known.where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two deliveries, which together are the whole table: the second one meets the counts that the
    first one has stored."""
    docs, cache = table(spark, sf_dir, "documents"), new_path(spark, "token-cache")
    delivery = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    first, second = (token_counts(docs.where(delivery == k), public_path("piece_bpe_32k.model"), cache) for k in (0, 1))
    return first.unionByName(second).select("doc_id", "n_bytes", "n_tokens", "over_limit")
