"""Language identification by nearest centroids of hashed TF-IDF n-gram vectors.

A text is lower-cased, other code points than letters become a space, and its 1- to 3-grams are hashed to a fixed
number of dimensions; the vector is (1 + ln tf) idf, normalised. Document frequencies are counted over all training
documents. Per language a few centroids come from spherical k-means over a sample of the training documents
(`sample` per language on average, but no more than `most_rows` in all, which at 16 KB a row bounds what the driver holds).
Of a column with very many values, as dirty ones have, the `languages` most frequent ones are learned. A text gets
the language of the centroid with the largest cosine, which is also its score. It is rejected when that cosine is
below `reject_share` times the low percentile of the language's own training cosines.

Cases: a null text, or one without a letter, is `und` with score 0 and rejected. Without training documents all are.
Rows with a null doc_id aren't learned from and aren't held out. Repeated rows give a row each; empty tables none. Of
centroids with equal cosine the first one counts (languages in the order of their names). Texts of any length are read
whole. Other columns are ignored by identify() and kept as they are by accepted(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import tidied, worker_cache
from tidewell.session import table

DIMS = 4096


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def gram_counts(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams, null without a letter."""
    letters = worker_cache(("letters",), _letters)
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters[np.minimum(c, len(letters) - 1)]
    if not known.any():
        return None
    c = np.where(known, c, 32).astype(np.uint32)
    c = np.concatenate([[32], c[known | np.append(True, known[:-1])], [32, 32]]).astype(np.uint32)  # one space for a run
    a, b, d = c[:-2], c[1:-1], c[2:]
    two = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    three = two * np.uint32(0xC2B2AE3D) ^ d * np.uint32(0x27D4EB2F)
    one = a * np.uint32(0x165667B1)
    out = np.zeros(dims, np.int64)
    for h in (one, two, three):
        h = h ^ (h >> np.uint32(15))
        out += np.bincount((h * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(dims), minlength=dims)
    return out


def vectors(texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors, and which texts have one."""
    out, there = np.zeros((len(texts), len(idf)), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if (n := gram_counts(text, len(idf))) is not None:
            at = np.flatnonzero(n)
            v = (1 + np.log(n[at])) * idf[at]
            out[i, at], there[i] = v / np.linalg.norm(v), True
    return out, there


def _frequencies(dims: int):
    def run(batches):
        total, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for text in b.column("text"):
                if (c := gram_counts(text.as_py(), dims)) is not None:
                    total += c > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["dim", "n"])

    return run


def _vector_rows(idf: np.ndarray):
    def run(batches):
        for b in batches:
            v, there = vectors(b.column("text").to_pylist(), idf)
            keep = pa.array(there)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(keep), b.column("lang").filter(keep), pa.array([x.tobytes() for x in v[there]], pa.binary())], ["doc_id", "lang", "v"])

    return run


def k_means(v: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centroids; starts far apart (k-means++)."""
    rng = np.random.default_rng(seed)
    centres = v[rng.integers(len(v))][None]
    while len(centres) < min(k, len(v)):
        far = np.clip(1 - (v @ centres.T).max(1), 0, None).astype(np.float64)
        if far.sum() < 1e-6:
            break
        centres = np.vstack([centres, v[rng.choice(len(v), p=far / far.sum())]])
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(1)
        sums = np.stack([v[nearest == j].sum(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres.astype(np.float32)


def train(docs: DataFrame, k: int = 4, sample: int = 600, dims: int = DIMS, low: float = 0.01, languages: int = 1000, most_rows: int = 24_000) -> dict:
    """The model: idf, centroids, the language of each, and the low percentile of each language's cosines.

    docs: doc_id, text, lang; rows without a language are left out.
    """
    known = docs.where("lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    sample = min(sample, most_rows // max(1, len(sizes)))
    rows = known.select("text").mapInArrow(tidied(_frequencies(dims)), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(dims)
    df[rows.dim[rows.dim >= 0]] = rows.n[rows.dim >= 0]
    n_docs = int(rows.n[rows.dim == -1].sum())
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
    model = {"idf": idf, "centroids": np.zeros((0, dims), np.float32), "langs": [], "floor": {}}
    if not sizes:
        return model
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    chosen = known.where((F.xxhash64("doc_id") % 1_000_000 + 1_000_000) % 1_000_000 < share[F.col("lang")] * 1_000_000)
    got = chosen.mapInArrow(tidied(_vector_rows(idf)), "doc_id long, lang string, v binary").toPandas().sort_values(["lang", "doc_id"], kind="stable")
    for lang, group in got.groupby("lang"):
        v = np.frombuffer(b"".join(group["v"]), np.float32).reshape(len(group), dims)
        centres = k_means(v, k)
        model["floor"][lang] = float(np.quantile((v @ centres.T).max(1), low))
        model["centroids"] = np.vstack([model["centroids"], centres])
        model["langs"] += [lang] * len(centres)
    return model


def _predict(model: dict, reject_share: float, keep_text: bool):
    def run(batches):
        langs = np.array([*model["langs"], "und"], dtype=object)
        floors = np.array([model["floor"][x] * reject_share for x in model["langs"]] + [0.0])
        for b in batches:
            best, score = np.full(len(b), len(langs) - 1), np.zeros(len(b))
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                v, there = vectors(texts[at : at + 256], model["idf"])
                if len(model["langs"]) and there.any():
                    cos = v[there] @ model["centroids"].T
                    rows = at + np.flatnonzero(there)
                    best[rows], score[rows] = cos.argmax(1), np.clip(cos.max(1), 0, 1)
            none = best == len(langs) - 1
            names = [n for n in b.schema.names if n != "text" or keep_text]
            columns = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs[best], pa.string()), pa.array(score), pa.array(none | (score < floors[best]))], [*names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: dict, keep: dict[str, Column], reject_share: float = 0.5) -> DataFrame:
    """The columns keep (name to expression), lang_pred, score, rejected for every row of docs."""
    own = docs.select(*[c.alias(n) for n, c in keep.items() if n != "text"], F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{n}` {t}" for n, t in own.dtypes if n != "text" or "text" in keep)
    return own.mapInArrow(tidied(_predict(model, reject_share, "text" in keep)), f"{fields}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict, reject_share: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text isn't rejected."""
    names = {c: "text" if c == "text" else f"k{i}" for i, c in enumerate(docs.columns)}
    out = identify(docs, model, {n: F.col(f"`{c}`") for c, n in names.items()}, reject_share).where("NOT rejected")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(learning_rows(docs))
    return identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out()})
