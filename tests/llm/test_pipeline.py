"""The pipeline's stages against brute force, and ops 7 and 9 by themselves."""

import os
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import op5_minhash, op7_language, op8_secrets, op9_decontamination
from tidewell.llm.tokenizers_io import IdEncoder, public_path


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage over the small tables and some odd rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12345 !!"), (None, None)], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).alias("n_chars"))
    docs = docs.unionByName(odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).unionByName(docs.limit(3))
    out, root = [], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"file://{root}/{name}")
        after = spark.read.parquet(f"file://{root}/{name}")
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_7", "near_duplicates_5", "decontamination_9", "secrets_8", "packing_2"]
    for before, after, columns, more in stages[:-1]:
        assert columns == more and after


def test_language_stage(stages):
    before, after, *_ = stages[0]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone >= {10**6, 10**6 + 1, 10**6 + 2, None}
    assert len(after) >= 0.99 * (len(before) - 4)


def test_near_duplicates_stage(stages):
    from test_minhash import brute

    before, after, *_ = stages[1]
    keep = {c for _, _, c, kept in brute([(r["doc_id"], r["text"]) for r in before]) if kept}
    assert sorted(r["doc_id"] for r in after) == sorted(keep)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_decontamination_stage(spark, sf, stages):
    before, after, *_ = stages[2]
    items = [op9_decontamination.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    holds = {r["doc_id"] for r in before if any(i in op9_decontamination.normalise(r["text"]) for i in items)}
    part = {r["doc_id"] for r in before if any(i[k : k + 70] in op9_decontamination.normalise(r["text"]) for i in items for k in range(max(1, len(i) - 69)))}
    assert holds and holds <= gone <= part


def test_secrets_stage(stages):
    from test_quality_secrets import base_of

    before, after, *_ = stages[3]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(before) == len(after)
    for r in after:
        assert base_of(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not base_of(texts[r["doc_id"]]) and r["text"] != texts[r["doc_id"]]:
            assert "[secret]" in r["text"]


def test_packing_stage(stages):
    before, after, *_ = stages[4]
    encoder = IdEncoder(public_path("word_bpe_49k.json"))
    want = {}
    for r, ids in zip(before, encoder.encode(pa.array([r["text"] for r in before]))):
        ids = np.append(ids, 0).astype("<u4")
        want |= {(r["doc_id"], k // 2048): zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in after} == want


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op7_language.op7_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_against_brute_force(spark, sf):
    """Document frequencies, weights, cosines, the nearest centroid and the rejection, with a dict of grams for each text."""
    from collections import Counter
    from math import log, sqrt

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    odd = spark.createDataFrame([(10**6, "12 34", "en"), (10**6 + 1, None, "de"), (10**6 + 2, "ぁあ日本語", None)], docs.schema)
    docs = docs.unionByName(odd)
    rows = docs.collect()
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None]

    def bucket(gram):
        m = (1 << 32) - 1
        a, b, d = (*map(ord, gram), 0, 0)[:3]
        if len(gram) == 1:
            h = a * 0x165667B1 & m
        else:
            h = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m)
        if len(gram) == 3:
            h = (h * 0xC2B2AE3D & m) ^ (d * 0x27D4EB2F & m)
        h ^= h >> 15
        return ((h * 0x2C1B3C6D & m) >> 8) % op7_language.DIMS

    def grams(text):
        if not any(c.isalpha() for c in text or ""):
            return None
        words = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = " " + words
        while "  " in padded[1:]:
            padded = padded[0] + padded[1:].replace("  ", " ")
        padded += "  "
        out = Counter()
        for i in range(len(padded) - 2):
            out.update(bucket(padded[i : i + k]) for k in (1, 2, 3))
        return out

    counts = [g for g in (grams(r["text"]) for r in learn) if g is not None]
    df = Counter(x for c in counts for x in c)
    idf = [log((1 + len(counts)) / (1 + df[d])) + 1 for d in range(op7_language.DIMS)]
    model = op7_language.train(op7_language.learning_rows(docs))
    assert np.allclose(model["idf"], idf, rtol=1e-5)
    got = {r["doc_id"]: r for r in op7_language.identify(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    for r in rows:
        c, told = grams(r["text"]), got[r["doc_id"]]
        if c is None:
            assert (told["lang_pred"], told["score"], told["rejected"]) == ("und", 0.0, True)
            continue
        v = {d: (1 + log(n)) * idf[d] for d, n in c.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(centre[d]) for d, x in v.items()) / norm for centre in model["centroids"]]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert told["score"] == pytest.approx(min(1.0, max(0.0, cosines[best])), abs=1e-4)
        if sorted(cosines)[-1] - sorted(cosines)[-2] > 1e-4:
            assert told["lang_pred"] == model["langs"][best]
        if abs(cosines[best] - 0.5 * model["floor"][told["lang_pred"]]) > 1e-4:
            assert told["rejected"] == (cosines[best] < 0.5 * model["floor"][told["lang_pred"]])


def test_centroids_are_means_of_the_nearest(spark):
    """k-means on separated clouds: each centroid is the normalised mean of its own vectors."""
    rng = np.random.default_rng(1)
    axes = np.eye(6, dtype=np.float32)[:3]
    v = np.vstack([a + 0.05 * rng.normal(size=(30, 6)) for a in axes]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centres = op7_language.k_means(v, 3)
    nearest = (v @ centres.T).argmax(1)
    assert sorted(np.bincount(nearest).tolist()) == [30, 30, 30]
    for j, c in enumerate(centres):
        mean = v[nearest == j].sum(0)
        assert np.allclose(c, mean / np.linalg.norm(mean), atol=1e-5)


def test_language_odd_rows(spark):
    rows = [(1, "the cat sat on the mat with the hat", "en"), (3, "der hund und die katze sind nicht hier", "de"), (4, None, "en"), (5, "123 !?", None), (None, "the dog and the cat", "en"), (6, "x" * 300_000, None), (6, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = op7_language.train(op7_language.learning_rows(df))
    got = {r["doc_id"]: r for r in op7_language.identify(df, model, {"doc_id": F.col("doc_id")}).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[4]["score"] == 0 and got[5]["rejected"]
    assert got[None]["lang_pred"] == "en"
    assert set(op7_language.accepted(df, model).columns) == set(df.columns)
    empty = op7_language.train(op7_language.learning_rows(df.limit(0)))
    assert {r["lang_pred"] for r in op7_language.identify(df, empty, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert op7_language.identify(df.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0


def test_regions(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([4, 12, 20, 40, 60])] + [(9, None), (10, "")]
    docs, want = [], set()
    for d in range(60):
        body = [word() for _ in range(80)]
        if d % 2:
            item, text = items[1 + d % 4]
            chars = list(text)
            for _ in range(len(chars) // 30 if d % 3 else 0):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([[], ["z"], [chars[k], "y"]])
            body[40:40] = ["".join(chars).upper() if d % 5 == 0 else "".join(chars)]
            want.add((d, item))
        docs.append((d, "  \n".join(body)))
    docs += [(100, None), (101, ""), (101, ""), (102, "z" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op9_decontamination.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    blocks = op9_decontamination.contaminated(df, bench, block_chars=200).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == want
    for r in got:
        text = op9_decontamination.normalise(dict(docs)[r["doc_id"]])[r["start"] : r["stop"]]
        item = op9_decontamination.normalise(dict(items)[r["item_id"]])
        assert abs(len(text) - len(item)) <= 0.2 * len(item) + 2
    kept = [r["doc_id"] for r in op9_decontamination.clean(df, bench).collect()]
    assert sorted(kept) == sorted(d for d, _ in docs if d not in {x for x, _ in want})
    assert op9_decontamination.contaminated(df, bench.limit(0)).count() == 0 and op9_decontamination.contaminated(df.limit(0), bench).count() == 0


def test_each_block_is_built_once(spark, monkeypatch):
    """By one Spark job; whoever searches loads blocks, however many pieces of text there are, and builds none."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(30)] + [(30, "tiny"), (31, items_text := "same words in two items"), (32, items_text)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    blocks = op9_decontamination.Blocks(bench, 10, 0.08, 80, 40, 2000)
    files = os.listdir(blocks.path.removeprefix("file:"))
    assert 5 < len(files) == blocks.built <= blocks.n and {int(f) for f in files} < set(range(blocks.n + 1))
    loaded = []
    monkeypatch.setattr(op9_decontamination.pickle, "load", lambda f, load=pickle.load: loaded.append(f) or load(f))
    monkeypatch.setattr(op9_decontamination.GramIndex, "__init__", lambda *_: pytest.fail("a task builds an index"))
    texts = [f"{word()} {t} {word()}" for _, t in items] * 3
    got = blocks.regions(texts)
    assert [sorted({r[0] for r in x}) for x in got] == [[31, 32] if i > 30 else [i] for i, _ in items] * 3
    assert len(loaded) == len(files)


def test_unchanged_and_edited_copy_in_a_document(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    for n in (12, 60):
        item = text(n)
        edited = item[:30] + "zz" + item[32:]
        docs = [(1, f"{text(50)} {item} {text(500)} {edited} {text(50)}"), (2, f"{text(50)} {edited} {text(500)} {item} {text(50)}")]
        want = sorted((d, t.index(x)) for d, t in docs for x in (item, edited))
        got = op9_decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
        assert len(got) == 4
        for r, (d, start) in zip(sorted(got, key=lambda r: (r["doc_id"], r["start"])), want):
            assert r["doc_id"] == d and abs(r["start"] - start) <= 6 and abs(r["stop"] - start - len(item)) <= 6


def distances(p, t):
    """Fewest edits between p and any part of t that ends at each place."""
    row = np.zeros(len(t) + 1, np.int64)
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    for i, x in enumerate(p):
        new = np.append(i + 1, np.minimum(row[:-1] + (codes != ord(x)), row[1:] + 1))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row


@pytest.mark.parametrize(("frequent", "tile"), [(64, 4_000_000), (2, 50), (0, 1)])
def test_regions_against_edit_distances(monkeypatch, frequent, tile):
    """All segments against all texts, with runs of one letter, shared phrases, short items and equal items."""
    monkeypatch.setattr(op9_decontamination, "FREQUENT", frequent)
    monkeypatch.setattr(op9_decontamination, "TILE_HITS", tile)
    rng = random.Random(6)
    text = lambda n, a="abcdefg": "".join(rng.choice(a) for _ in range(n))
    phrase = "question: which of these is "
    items = [(0, "short"), (1, "ab"), (2, "x"), (3, text(10)), (4, text(15)), (5, phrase + text(30)), (6, phrase + text(90)), (7, phrase + text(60)), (8, "a" * 90), (9, "a" * 50 + text(40)), (10, text(300)), (11, phrase), (12, phrase), (13, "日本")]
    items += [(20 + i, phrase + text(40)) for i in range(12)] + [(40 + n, text(n)) for n in (11, 12, 13, 16, 19, 20, 24, 25, 27, 29, 30, 38, 39)]
    docs = ["", "this is short ok", "shorter", "a short", "ab cd ab", "x", "日本語", "a" * 400, "b" + "a" * 85 + "c" + "a" * 30, phrase * 3]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            chars = list(rng.choice(items)[1])
            at = rng.randint(0, len(chars) // 3)
            chars = chars[at:] if rng.random() < 0.3 else chars
            for _ in range(rng.choice([0, 1, len(chars) // 20, len(chars) // 12, len(chars) // 8])):
                if chars:
                    k = rng.randrange(len(chars))
                    chars[k : k + 1] = rng.choice([[], ["z"], [chars[k], "y"]])
            parts += ["".join(chars), text(rng.choice([0, 5, 200]))]
        docs.append(op9_decontamination.normalise(" ".join(parts)))
    segs = op9_decontamination.segments(items, 80, 40)
    index = op9_decontamination.Index(segs, 10, 0.08)
    found = op9_decontamination.regions_of(index, docs)
    pairs = set()
    for item, seg in segs:
        budget = int(0.08 * len(seg)) if len(seg) >= 10 else 0
        for d, t in enumerate(docs):
            ends = np.flatnonzero(distances(seg, t) <= budget)
            if len(seg) < 10:  # whole words only
                cased = lambda a, b: a.lower() != a.upper() and b.lower() != b.upper()
                ends = [e for e in ends if not (e > len(seg) and cased(t[e - len(seg) - 1], t[e - len(seg)])) and not (e < len(t) and cased(t[e - 1], t[e]))]
            own = [r for r in found[d] if r[0] == item]
            for e in ends:
                pairs.add((d, item))
                assert any(start < e + budget and e <= stop + budget for _, start, stop, _, _ in own), (item, seg, t, e)
    assert {(d, r[0]) for d, regions in enumerate(found) for r in regions} == pairs
    assert {(1, 0), (3, 0), (4, 1), (5, 2), (6, 13), (7, 8), (9, 11), (9, 12)} <= pairs and (2, 0) not in pairs


def test_short_segments_have_all_their_edits():
    """Where an edit in the middle leaves no q-gram of full length."""
    found = lambda item, doc: op9_decontamination.regions_of(op9_decontamination.Index([(1, item)], 10, 0.08), [doc])[0]
    assert [r[3] for r in found("abcdefghijklmnopq", "so abcdefghijklmnopz it")] == [1] and [r[3] for r in found("abcdefghijklmnopq", "so abcdefghzjklmnopq it")] == [1]
    assert not found("abcdefghijklmnopq", "so abcdefghzjklmnopz it") and not found("abcdefghijkl", "so abcdefzhijkl it")
    assert [op9_decontamination.gram_length(n, 10, 0.08) for n in (5, 10, 13, 19, 20, 25, 29, 30, 38, 39, 40, 80)] == [10, 10, 6, 9, 10, 8, 9, 10, 9, 9, 10, 10]


def test_letters_of_all_planes_and_many_languages(spark):
    letters = "\U00030000\U00030001\U00031350 \U0002ebf0"
    assert op7_language.gram_counts(letters) is not None and op7_language.gram_counts("\U0001f600 12 \U000e0001") is None
    rows = [(i, f"word{i % 7} text of some letters {chr(97 + i % 26)}", f"dirty{i}") for i in range(3000)] + [(5000 + i, "der die das und nicht", "de") for i in range(60)] + [(6000 + i, "the and of to a", "en") for i in range(60)]
    model = op7_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=5, most_rows=100)
    assert {"de", "en"} <= set(model["langs"]) and len(set(model["langs"])) <= 5


def test_long_runs_and_texts_stay_bounded(monkeypatch):
    monkeypatch.setattr(op9_decontamination, "TILE_HITS", 200_000)
    index = op9_decontamination.Index([(1, "a" * 80), (2, "ab" * 40)], 10, 0.08)
    assert [[r[:4] for r in x] for x in op9_decontamination.regions_of(index, ["a" * 200_000, "z" * 300_000 + "ab" * 60])] == [[(1, 0, 200_000, 0)], [(2, 300_000, 300_120, 0)]]


def test_banded_alignment_is_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        p = [rng.randint(1, 3) for _ in range(rng.randint(3, 12))]
        t = [rng.randint(1, 3) for _ in range(rng.randint(8, 25))]
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p):
            new = [i + 1]
            for j, y in enumerate(t):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        edits, stop = op9_decontamination.banded_alignment(np.array([p], np.uint32), np.array([len(p)]), np.array(t, np.uint32), np.array([-len(p) - 1]), len(t) + 2 * len(p) + 2)
        assert edits[0] == min(row) and row[min(stop[0], len(t))] == edits[0]


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small folder with planted cases, against plain Python for every stage, and on empty tables."""
    from test_minhash import brute
    from test_quality_secrets import base_of

    rng = random.Random(12)
    words = {"en": "the and of to in that is was for with on as are this be".split(), "de": "der die und das ist nicht mit auf ein den von zu im sich".split()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) + (rng.choice(words[lang]) if rng.random() < 0.3 else "") for _ in range(n))
    items = [(i, prose("en", 40)) for i in range(3)]
    rows = [(i, prose(lang, rng.randint(40, 120)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    copied = rows[4][1].split()
    rows += [(200, rows[4][1], "en"), (201, " ".join(copied[:-1]), "en"), (202, prose("en", 20) + " " + items[1][1] + " " + prose("en", 20), "en")]
    rows += [(203, prose("en", 50) + " password = hunter2222 end", "en"), (204, None, "en"), (205, "12 34", "en"), (206, "long " + prose("de", 4000), "de"), (200, rows[4][1], "en")]
    tables = {"documents": [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "benchmark": items}
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string"}
    for empty in (False, True):
        folder = f"file://{tmp_path}/{'empty' if empty else 'full'}"
        for name, data in tables.items():
            spark.createDataFrame([] if empty and name == "documents" else data, schemas[name]).write.parquet(f"{folder}/{name}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        if empty:
            assert got == []
            continue
        texts = {d: t for d, t, _ in rows if d not in (204, 205)}
        kept = {c for _, _, c, k in brute(list(texts.items())) if k}
        assert kept == set(texts) - {200, 201}
        norm = op9_decontamination.normalise
        kept -= {d for d in kept if any(norm(t) in norm(texts[d]) for _, t in items)}
        assert 202 not in kept
        texts[203] = texts[203].replace("password = hunter2222", "[secret]")
        assert not any(base_of(texts[d]) for d in kept)
        encoder, want = IdEncoder(public_path("word_bpe_49k.json")).tokenizer, {}
        for d in kept:
            ids = np.array([*encoder.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
            want |= {(d, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
        bins = {}
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == bins.get(r["sequence_id"], 0)
            bins[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_one_of_each_keeps_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in op5_minhash.one_of_each(df).collect()))) == ["1", "3", "None"]


def test_secrets_native():
    import inspect

    source = inspect.getsource(op8_secrets)
    assert "mapIn" not in source and "udf" not in source
