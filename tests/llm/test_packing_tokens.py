"""Exact round trips of op2 and op3."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.llm import op2_packing, op3_token_counts
from tidewell.llm.tokenizers_io import IdEncoder, PieceCounter, public_path

ODD = ["", " ", "  ", "a", "a ", " a", "  a  b   ", "\n", "x\n  y\t z ", "▁", "▁▁a ▁b", "<s> </s> <unk>", "a\x00 b\x1cc", "<|startoftext|> hi <|endoftext|>x", "İ ΑΣ ς x y", "é ́", "日本語 テスト", "🙂🙂 a", "don't 12 b2b"]
ODD += ["<|ENDOFTEXT|>", "x<|StartOfText|>y <|endoftext|", "A<|endoftext|>B.<|ENDOFTEXT|>,c", "Été ÀÉÎ, fin.Bon;x", "J\u030c T\u0308. e\u0301, É\u0301", "I\u0307 K ß SS ﬁ", "a.b c,.d 'S 'TH x's."]


def test_by_word_equals_whole(spark, sf):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counter, encoder = PieceCounter(public_path("piece_bpe_32k.model")), IdEncoder(public_path("word_bpe_49k.json"))
    assert counter.counts(pa.array(texts)).tolist() == [len(counter.model.encode(t)) for t in texts]
    for t, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(counter.counts(pa.array([], pa.string()))) == 0


def test_random_strings_with_special_parts():
    rng = random.Random(3)
    parts = ["<|", "|>", "endoftext", "ENDOFTEXT", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", " ", "\n", "\t", ".", ",", "a", "É", "e\u0301", "'s", "12", "★", "<s>", "\u00a0", "word", "Word!", "é***", "$&", "_-", "\u0338", "=", "@x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    encoder = IdEncoder(public_path("word_bpe_49k.json"))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == want
    ended = [(flat.tolist(), size.tolist()) for flat, size in encoder.columns(pa.array(texts), 0)]
    assert [x for flat, _ in ended for x in flat] == [x for ids in want for x in [*ids, 0]]
    encoder._clear()  # a table that is emptied gives the same ids again
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts[:500]))] == want[:500]


def test_token_counts_and_cache(spark, tmp_path):
    rows = list(enumerate(ODD)) + [(90, None), (91, "a"), (91, "a"), (92, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    model = public_path("piece_bpe_32k.model")
    first = sorted(map(tuple, op3_token_counts.token_counts(df, model, cache).drop("digest").collect()))
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})
    again = sorted(map(tuple, op3_token_counts.token_counts(df, model, cache).drop("digest").collect()))
    assert again == first and spark.read.parquet(cache).count() == stored
    counter = PieceCounter(model)
    assert first == sorted((d, len((t or "").encode()), n := len(counter.model.encode(t or "")), n > 4096) for d, t in rows)
    assert op3_token_counts.token_counts(df.limit(0), model).count() == 0
    # a later version of the table: only what is new is encoded, and copies of one text may be most of the rows
    more = df.unionByName(spark.createDataFrame([(i, "hot text") for i in range(500)] + [(None, "a"), (None, "a")], "doc_id long, text string")).withColumns({"digest": F.lit(1), "id": F.lit(2), "n": F.lit(3), "n_tokens": F.lit("x")})
    got = op3_token_counts.token_counts(more, model, cache, hot_rows=50).collect()
    assert spark.read.parquet(cache).count() == stored + 1
    n = len(counter.model.encode("hot text"))
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in got) == sorted(map(str, first + [(i, 8, n, False) for i in range(500)] + [(None, 1, 1, False)] * 2))
    # another tokenizer's counts aren't taken
    spark.createDataFrame([(bytes(32), 7, "other")], "digest binary, n_tokens long, tokenizer string").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(map(tuple, op3_token_counts.token_counts(df, model, cache).drop("digest").collect())) == first


def test_token_counts_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    model = PieceCounter(public_path("piece_bpe_32k.model")).model
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in docs)
    assert sorted(map(tuple, op3_token_counts.op3_token_counts(spark, sf).collect())) == want


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 9000)], "doc_id long, text string"))
    pieces = op2_packing.document_pieces(docs, public_path("word_bpe_49k.json"))
    got = op2_packing.pack(pieces, per_task=40, fan_in=3).toPandas()
    encoder = IdEncoder(public_path("word_bpe_49k.json"))
    want = {}
    rows = docs.collect()
    for r, ids in zip(rows, encoder.encode(pa.array([x["text"] or "" for x in rows]))):
        ids = np.append(ids, 0).astype("<u4")
        for k in range(0, len(ids), 2048):
            want[r["doc_id"], k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(a, b): (c, d, e) for a, b, c, d, e in zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)} == want and len(got) == len(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 2048 + 1
    assert op2_packing.pack(pieces.limit(0)).count() == 0


def test_packing_repeated_rows_and_clashing_columns(spark):
    path = public_path("word_bpe_49k.json")
    rows = [(1, "a b c", 7, "x")] * 3 + [(2, None, 8, "y"), (None, "no id", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long, members string")
    got = sorted((str(r["doc_id"]), r["length"]) for r in op2_packing.pack(op2_packing.document_pieces(df, path)).collect())
    assert got == [("1", 4), ("1", 4), ("1", 4), ("2", 1), ("None", 3)]
    # many small pieces in a bin: the members of a task stay bounded, and no piece is lost
    pieces = spark.range(3000).selectExpr("id AS doc_id", "CAST(0 AS INT) AS piece", "0L AS start", "1L AS length", "id AS ids_crc32")
    packed = op2_packing.pack(pieces, capacity=100, per_task=200, fan_in=2, members_per_task=500).toPandas()
    assert sorted(packed.doc_id) == list(range(3000)) and packed.groupby("sequence_id").length.sum().max() <= 100


def test_best_fit():
    bins = op2_packing.best_fit([5, 5, 3, 7, 10], 10)
    assert sorted(map(sorted, bins)) == [[0, 1], [2, 3], [4]]
