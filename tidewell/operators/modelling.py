"""Splits, batch inference, scoring with a cache, models on pyspark.ml, and their evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.documents import json_errors


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int = 7) -> DataFrame:
    """df with split: per label exactly floor(share * n) rows are test, those with the smallest hash of the key.

    Ranks are needed only where the boundary lies: hashes are counted in 4096 bins per label, bins below the boundary
    are test as a whole, and rows are ranked in the one bin that it cuts. So a label of any size is no single window.
    """
    h = F.xxhash64(F.lit(seed), key)
    binned = df.withColumns({"_h": h, "_bin": F.shiftrightunsigned(h, 52)})
    counts = binned.groupBy(label, "_bin").agg(F.count("*").alias("_n"))
    own = W.partitionBy(label)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = counts.withColumns({"_before": before, "_test": F.floor(F.sum("_n").over(own) * F.lit(share))})
    room = edges.select(F.col(label).alias("_l"), F.col("_bin").alias("_b"), F.greatest(F.lit(0), F.least("_n", F.col("_test") - F.col("_before"))).alias("_room"), "_n")
    out = binned.join(room, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_bin") == F.col("_b")))
    cut = out.where((F.col("_room") > 0) & (F.col("_room") < F.col("_n")))
    ranked = cut.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy("_bin", F.col("_h"), key)))
    whole = out.where((F.col("_room") == 0) | (F.col("_room") == F.col("_n"))).withColumn("split", F.when(F.col("_room") > 0, "test").otherwise("train"))
    part = ranked.withColumn("split", F.when(F.col("_r") <= F.col("_room"), "test").otherwise("train"))
    return whole.select(*df.columns, "split").unionByName(part.select(*df.columns, "split"))


def hashing_vectors(texts: Sequence[str | None], dims: int) -> list[list[float]]:
    """A stand-in for a text encoder: normalised counts of hashed words."""
    import zlib

    import numpy as np

    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            out[i, zlib.crc32(w.encode()) % dims] += 1
    return (out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))).tolist()


def embed(df: DataFrame, key: str, text: str, model: Callable[[Sequence[str | None], int], list[list[float]]] = hashing_vectors, dims: int = 32, batch: int = 256) -> DataFrame:
    """key and a vector of dims numbers: model is called on batches of texts on the executors."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, batch):  # no more than one call's texts and vectors at a time
                part = b.slice(at, batch)
                out = model(part.column(text).to_pylist(), dims)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.list_(pa.float64()))], [key, "vector"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, vector array<double>")


ANSWERS = "prompt_hash string, answer string"


def score_texts(prompts: DataFrame, cache_path: str, client: Callable[[str], str], rules: dict[str, dict], retries: int = 3) -> DataFrame:
    """prompt_hash, answer, errors for the distinct prompts (column prompt), by a cache of answers at cache_path.

    Only prompts without an answer in the cache reach the client, and their answers are stored there before anything is
    returned, so they are asked for once, however often the result is read. An answer that breaks the rules is asked for
    again, up to retries times, and the last one is kept with its errors.
    """
    spark = prompts.sparkSession
    own = prompts.select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").dropDuplicates(["prompt_hash"])
    fresh = own.join(answers(spark, cache_path).select("prompt_hash"), "prompt_hash", "left_anti")

    def ask(frames):
        import json

        import pandas as pd

        def good(answer: str) -> bool:
            try:
                doc = json.loads(answer)
            except ValueError:
                return False
            return all(not (r.get("required") and doc.get(k) is None) and not ("enum" in r and doc.get(k) not in r["enum"]) for k, r in rules.items())

        for f in frames:
            out = []
            for p in f["prompt"]:
                for _ in range(retries):
                    answer = client(p)
                    if good(answer):
                        break
                out.append(answer)
            yield pd.DataFrame({"prompt_hash": f["prompt_hash"], "answer": out})

    fresh.mapInPandas(ask, ANSWERS).write.mode("append").parquet(cache_path)
    return own.select("prompt_hash").join(answers(spark, cache_path), "prompt_hash").withColumn("errors", json_errors(F.col("answer"), rules))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers of a cache, one of each prompt; no rows where nothing is stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(path).groupBy("prompt_hash").agg(F.min("answer").alias("answer"))


def stub_client(prompt: str) -> str:
    """Answers like a model would, from the prompt's digest alone."""
    h = int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16)
    return '{"sentiment": "%s", "priority": %d}' % (("good", "bad", "mixed")[h % 3], h % 5)


def classifiers(seed: int = 7) -> dict:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    return {
        "logistic_regression": LogisticRegression(maxIter=30),
        "random_forest": RandomForestClassifier(numTrees=10, maxDepth=5, seed=seed),
        "gradient_boosting": GBTClassifier(maxIter=5, maxDepth=3, seed=seed),
    }


def fit_and_compare(data: DataFrame, features: Sequence[str], label: str, split: str = "split") -> tuple[DataFrame, dict]:
    """A row per model with its train and test accuracy, best first; and the models. data holds split (train or test)."""
    from pyspark.ml.feature import VectorAssembler

    from tidewell.session import stored

    rows = stored(data.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(label).cast("double").alias("label"), split), "features")
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    models, out = {}, []
    for name, c in classifiers().items():
        models[name] = c.fit(ready.where(F.col(split) == "train"))
        scored = models[name].transform(ready).groupBy(split).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        acc = {r[split]: r["accuracy"] for r in scored.collect()}
        out.append((name, acc.get("train"), acc.get("test")))
    result = data.sparkSession.createDataFrame(out, "model string, train_accuracy double, test_accuracy double")
    return result.orderBy(F.desc("test_accuracy"), "model"), models


def report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class: precision, recall, F1 (0 where undefined) and support; one aggregate over both roles of each row."""
    sides = F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("is_label")), F.struct(F.col(prediction).alias("c"), F.lit(0).alias("is_label"))))
    hit = F.col(label) == F.col(prediction)
    s = df.select(hit.alias("hit"), sides.alias("x")).groupBy(F.col("x.c").alias("class"))
    out = s.agg(F.count_if(F.col("hit") & (F.col("x.is_label") == 1)).alias("tp"), F.count_if(F.col("x.is_label") == 0).alias("predicted"), F.count_if(F.col("x.is_label") == 1).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return out.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), "support")


def confusion(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """Counts by label (rows) and prediction (columns) over a fixed list of classes, zeros included."""
    rows = df.sparkSession.createDataFrame([(c,) for c in classes], f"label {dict(df.dtypes)[label]}")
    counts = df.groupBy(F.col(label).alias("label")).pivot(prediction, list(classes)).count()
    return rows.join(counts, "label", "left").select("label", *[F.coalesce(f"`{c}`", F.lit(0)).cast("long").alias(f"p_{c}") for c in classes])
