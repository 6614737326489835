"""op5 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import op5_minhash
from tidewell.llm.components import connected_components
from tidewell.llm.shingles import circulant_minhash, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(i, j) for v in where.values() for i in v for j in v if i < j}
    for i, j in pairs:
        n = len(sets[i] & sets[j])
        if rows[i][0] is not None and rows[j][0] is not None and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(root(i), []).append(d)
    return sorted((str(d), len(sets[i]), m := (d if d is None else min(comp[root(i)])), d == m) for i, (d, _) in enumerate(rows))


def test_shingles_and_signatures():
    texts = ["", "a", " a b ", "A b", "a\x0bb c d e f", "a b c d e", "x" * 3_000_000 + " y z w v u"] + [" ".join(random.Random(i).choices("abcdefg", k=60)) for i in range(40)]
    sets, want = shingle_sets(texts), [brute_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
    assert shingle_sets(["a"])[0].tolist() == sets[1].tolist()
    big = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    marks = circulant_minhash([np.sort(big[:1600]), np.sort(big[400:])], 160)
    assert abs((marks[0] == marks[1]).mean() - 0.6) < 0.12
    assert len(set(marks[0].tolist())) > 100


@pytest.mark.parametrize(("chunk", "in_one_task"), [(512, 50_000), (5, 0)])
def test_small(spark, monkeypatch, chunk, in_one_task):
    monkeypatch.setattr(op5_minhash, "connected_components", lambda links: connected_components(links, in_one_task=in_one_task))
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, " \n")]
    for g in range(6):
        base = rng.choices(words, k=rng.choice([30, 80, 200]))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [rows[-1], (None, rows[-1][1]), (10**9, "long " + " ".join(words) * 20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("n", "node", "component", "a", "b", "order", "row")})
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in op5_minhash.near_duplicates(df, chunk=chunk).collect())
    assert got == brute(rows)


def test_leftovers_meet_members_of_their_buckets_only(spark):
    """The component grows, and so do the strangers that share small buckets with it: work grows in proportion."""
    work = []
    for n in (50, 100, 200):
        # a component of 10 n nodes in buckets of 10; each of its buckets of number i holds stranger i, too
        rows = [(0, i, 100_000 + 10 * i + k, 100_000 + 10 * i) for i in range(n) for k in range(10)] + [(0, i, i + 1, i + 1) for i in range(n)]
        # a bucket of strangers of three components, and one shared as a whole by the same nodes
        rows += [(1, 0, 1_000 + k, 1_000) for k in range(3)] + [(b, 7, 2_000 + k, 2_000) for b in (2, 3) for k in range(20)]
        members = spark.createDataFrame(rows, "band int, bucket long, doc long, leader long")
        docs = sorted({r[2] for r in rows})
        labels = spark.createDataFrame([(d, 100_000) for d in docs if d >= 100_000] + [(d, 2_000) for d in range(2_000, 2_019)], "node long, component long")
        sets = spark.createDataFrame([(d, b"") for d in docs], "doc long, items binary")
        top, place, others = (x.collect() for x in op5_minhash._sides(members, labels, sets, 4))
        pairs = lambda rows, group: {(a["doc"], b["doc"]) for cell in cells(rows, group) for a in cell for b in cell if a["left"] and b["right"] and a["component"] != b["component"]}
        got = pairs(top, "top") | pairs(place, "place") | pairs(others, "place")
        want = {(r[2], s[2]) for r in rows for s in rows if r[:2] == s[:2]}
        of = {r["node"]: r["component"] for r in labels.collect()}
        want = {(a, b) for a, b in want if of.get(a, a) != of.get(b, b)}
        assert got <= want and {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want}
        assert {r["top"] for r in top} >= {2_000} and 100_000 not in {r["top"] for r in top}
        work.append(len(place))
    assert work[1] == 2 * work[0] and work[2] == 2 * work[1]


def cells(rows, group):
    out = {}
    for r in rows:
        out.setdefault((r[group], r["ci"], r["cj"]), []).append(r)
    return list(out.values())


def test_doc_id_with_several_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (5, text(2) + " end"), (6, text(1) + " end"), (7, text(3)), (8, text(3) + " end"), (8, text(4)), (9, text(4)), (None, text(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in op5_minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 7), (None, None)}
    clash = df.withColumns({"row": F.lit("r"), "order": F.lit(1), "_row": F.lit(2), "_kept": F.lit(3)})
    left = op5_minhash.one_of_each(clash)
    assert left.columns == clash.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "7", "None"]


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in op5_minhash.op5_minhash(spark, sf).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert op5_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1, 120)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {x: x for e in chain for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for most in (0, 50_000):
        rows = connected_components(spark.createDataFrame(chain, "a long, b long"), in_one_task=most).collect()
        assert len(rows) == len({r["node"] for r in rows})
        assert {r["node"]: r["component"] for r in rows} == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in chain)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
