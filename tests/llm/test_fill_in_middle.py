"""op13 against a brute-force version, text by text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import op13_fill_in_middle as fim

ODD = ["", "a", "é", "日本", "🙂🙂🙂", "x<P>y", "<S>", "a<M", "<P", "P>", "<p>", "<<M>>", "a <b> c", "<P<S", ">M<", "\x00\n\t", "é ‍"]


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("window", [1, 2, 3, 7, 1 << 20])
def test_kernel_in_windows_of_any_size(window):
    rng = random.Random(window)
    parts = ["a", "é", "日", "🙂", "<", ">", "P", "S", "M", "<P", "M>", " "]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    column = pa.array(["pad", *texts])[1:]  # a slice, whose bytes begin later
    flat, begins = fim.batch_bytes(column)
    digests = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in range(len(texts))]
    hashes = np.array([[int(d[8 * k : 8 * k + 8], 16) for d in digests] for k in range(4)])
    form, prefix, middle, out, out_begins = fim.fill(flat, begins, np.array([len(t) for t in texts]), hashes, window)
    got = fim.strings(out, out_begins).to_pylist()
    want = [brute(i, t) for i, t in enumerate(texts)]
    assert got == [w[4] for w in want]
    assert [fim.FORMS[f] for f in form] == [w[1] for w in want]
    assert [(None, None) if f == fim.PLAIN else (p, m) for f, p, m in zip(form, prefix, middle)] == [w[2:4] for w in want]
    assert {w[1] for w in want} == set(fim.FORMS)
    back = fim.strings(*fim.restore(*fim.batch_bytes(fim.strings(out, out_begins)), form, window)).to_pylist()
    assert back == texts


def test_rows(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(ODD)] + [(None, "null id", 0, "x"), (None, None, 0, None), (7, None, 1, "x"), (8, "twice", 1, "x"), (8, "twice", 1, "x"), (-5, "minus five", 1, "x")]
    rows += [(1000, "wörd " * 200_000, 0, "x"), (1001, "long 🙂" * 150_000 + "<M>", 0, "x"), (1003, "x" * 2_500_000, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    got = fim.restored(fim.fill_in_middle(docs)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(repr((d, *brute(d, t))) for d, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in got) == sorted((str(d), t or "") for d, t, *_ in rows)
    assert fim.restored(fim.fill_in_middle(docs.limit(0))).count() == 0
