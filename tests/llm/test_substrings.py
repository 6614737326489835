"""op4 against brute force over all 50-byte strings."""

import hashlib
import os
import random
from urllib.parse import unquote, urlparse

import numpy as np

from tidewell.llm import op4_substrings


def brute(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                s = b[i : i + 50]
                least[s] = min(d, least.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_small(spark):
    rng = random.Random(5)
    text = lambda n, a="abcdefgh ": "".join(rng.choice(a) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 60, 75, 76, 77, 120, 300)]
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 200), (6, "y" + "x" * 60 + "z"), (7, "ü" * 40), (8, "a" + "ü" * 40), (None, shared[-1])]
    for i in range(10, 90):
        parts = []
        for _ in range(rng.randint(1, 5)):
            s = rng.choice(shared)
            if rng.random() < 0.5:
                s = s[rng.randint(0, 20) : len(s) - rng.randint(0, 20)]
            if rng.random() < 0.3 and s:
                k = rng.randrange(len(s))
                s = s[:k] + "#" + s[k + 1 :]
            parts += [s, text(rng.choice([0, 1, 10, 80]))]
        rows.append((i, "".join(parts)))
    rows += [(95, text(400, "ab")), (96, text(400, "ab")), (97, "ab" * 150), (98, "ab" * 150), (99, rows[40][1]), (99, rows[40][1]), (12, "other " + shared[-1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(op4_substrings.remove_repeats(df.repartition(3))) == want
    assert got(op4_substrings.remove_repeats(df.coalesce(1), bucket_bytes=2000)) == want
    # many batches, in groups that are settled first
    assert got(op4_substrings.remove_repeats(df.repartition(3), bucket_bytes=4000, batch_bytes=1500, group_batches=4)) == want


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op4_substrings.op4_substrings(spark, sf)) == brute(rows)


def test_clashing_columns_and_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(5, long), (3, "x" + long[1000:2000] + "y"), (4, long[250_000:]), (4, long[250_000:]), (9, "z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.selectExpr("*", "1 AS copy", "'a' AS states", "2 AS windows", "3 AS batch", "4 AS bucket", "true AS open")
    assert got(op4_substrings.remove_repeats(clash)) == brute(rows)


def test_empty(spark):
    assert op4_substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_more_surroundings_than_a_batch_sends(spark):
    """Many surroundings of a string, in many batches, that agree in single windows only."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = text(30)
    left, right = [text(20) for _ in range(12)], [text(20) for _ in range(12)]
    rows = [(i, text(rng.randint(5, 40)) + rng.choice(left)[-rng.randint(5, 20) :] + core + rng.choice(right)[: rng.randint(5, 20)] + text(rng.randint(5, 40))) for i in range(300)]
    rng.shuffle(rows)
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for per_batch in (1, 4):
        assert got(op4_substrings.remove_repeats(df, batch_bytes=3000, per_batch=per_batch)) == want
        assert got(op4_substrings.remove_repeats(df, batch_bytes=1500, per_batch=per_batch, group_batches=3)) == want


def _random_rows(n, length=4000):
    rng = random.Random(3)
    return [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(length))) for i in range(n)]


def test_many_batches_store_no_entries(spark, monkeypatch):
    """Entries are shuffled once, however many batches there are: what is stored between steps is small beside the text."""
    rows, sizes, store = _random_rows(200), [], op4_substrings.stored

    def counted(*args, **kwargs):
        out = store(*args, **kwargs)
        sizes.append(sum(os.path.getsize(unquote(urlparse(f).path)) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(op4_substrings, "stored", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = op4_substrings.remove_repeats(df, batch_bytes=20_000, group_batches=4)
    assert out.where("n_removed > 0").count() == 0
    assert len(sizes) == 2 and sum(sizes) < sum(len(t) for _, t in rows) / 20


def _asks(rng, batches, strings, per_batch):
    """Rows (batch, packed entries), with documents that ascend within a batch."""
    for b in range(batches):
        e = np.zeros(per_batch, op4_substrings.ENTRY)
        e["a"] = (rng.integers(1, strings + 1, per_batch) << 16).astype(np.uint64)
        e["c"] = (rng.integers(1, 30, per_batch) << 24).astype(np.uint64)
        e["tests"] = (e["c"] >> np.uint64(24)).astype(np.uint8)[:, None] % 7 + 1
        e["doc"], e["e"] = np.sort(rng.integers(0, 500, per_batch)), np.arange(per_batch)
        yield b, op4_substrings.pack(e)


def test_pieces_of_a_bucket(monkeypatch):
    """A bucket settled in pieces gives what it gives at once, whether its rows wait in memory or in a file."""
    rows = list(_asks(np.random.default_rng(1), 60, 40, 25))

    def settled(piece, most=1000):
        bucket = op4_substrings.Bucket("surroundings", most, piece)
        bucket.cuts = np.array([5 << 16 | 77], "<u8")  # marks have all bits of the hash
        for b, d in rows:
            bucket.add(b, d)
        return [(b, state.tolist()) for run in bucket.answers() for b, _, state in run], bucket

    want, _ = settled(10**9)
    states = {x for _, s in want for x in s}
    assert {op4_substrings.STAY, op4_substrings.REMOVE} <= states and max(states) > op4_substrings.OPEN
    assert settled(100)[0] == want
    monkeypatch.setattr(op4_substrings, "WAITING_BYTES", 1000)
    assert settled(26)[0] == want
    # strings of more surroundings than are kept are open
    got, bucket = settled(100, most=20)
    assert len(bucket.over) and len(bucket.known) <= 40 * 20
    for (b, data), (_, own), (_, whole) in zip(rows, got, want):
        over = np.isin(op4_substrings.unpack(data, op4_substrings.ENTRY)["a"], bucket.over)
        assert all(x == op4_substrings.OPEN + op4_substrings.ALL_GROUPS if o else x == y for o, x, y in zip(over, own, whole))


def test_common_string_takes_bounded_memory():
    """A string with other surroundings in each batch: a bucket holds a piece and `most` of them, not all."""
    bucket = op4_substrings.Bucket("surroundings", 200, 500)
    for b in range(300):
        e = np.zeros(50, op4_substrings.ENTRY)
        e["a"], e["c"], e["doc"], e["e"] = 1 << 16, np.arange(b * 50 + 1, b * 50 + 51, dtype=np.uint64) << 24, b, np.arange(50)
        bucket.add(b, op4_substrings.pack(e))
        assert len(bucket.known) <= 200 and bucket.held < 500
    answered = [(b, state) for run in bucket.answers() for b, _, state in run]
    assert [b for b, _ in answered] == list(range(300)) and all((s == op4_substrings.OPEN + op4_substrings.ALL_GROUPS).all() for _, s in answered)


def test_pieces_of_all_buckets(spark, monkeypatch):
    """Both rounds in pieces, with strings that are given up, against brute force."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, parts = text(26), [text(90) for _ in range(6)]
    rows = []
    for i in range(200):
        p = rng.choice(parts)
        cut = rng.randint(0, 30)
        rows.append((i, text(rng.randint(0, 30)) + core + text(rng.randint(0, 40)) + p[cut : cut + 60] + text(rng.randint(0, 20))))
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(op4_substrings, "PIECE", 2)
    for per_batch, group_batches in ((1, 2), (3, 4)):
        assert got(op4_substrings.remove_repeats(df, batch_bytes=800, per_batch=per_batch, group_batches=group_batches)) == want
