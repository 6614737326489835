"""Near-duplicate documents by circulant MinHash, banding, and verification on the full shingle sets.

1. Each text becomes its set of word shingles and a circulant MinHash signature (one permutation scatters the set once,
   a second one is shifted circularly for each coordinate).
2. Documents with equal sets are one node (the smallest doc_id). Nodes that agree in all rows of a band share a bucket,
   whose smallest member is its leader.
3. Every node is verified against the smallest of its leaders, and components follow; then against those of its other
   leaders that are still in another component. Both are linear in the members of the buckets.
4. In a bucket whose members are still in several components, the nodes outside the component with most of them are
   verified against those inside, and against each other. Those inside are only the members of such buckets, never the
   rest of the component. For each such component the cheaper of two ways is taken, by exact counts of the sets moved and
   of the comparisons: bucket by bucket, or once for all of its buckets together. All sides are dealt to chunks, so a
   task holds two chunks of sets at a time, counts intersections there, and gives links, never pairs.
5. Components of all links.

With 40 bands of 4 rows a pair at the threshold shares a bucket with probability 1 - 2.5e-7; links themselves are exact.

Cases: a null text, or one without words, has an empty set and is linked with nothing. Rows with the same doc_id are
one node: their components are joined. A null doc_id is linked with nothing and kept. Ties don't matter: components are
named by the smallest doc_id. Empty tables give no rows. Texts of any length give their whole set. Other columns are
ignored by near_duplicates() and kept by one_of_each(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import tidied, whole_text
from tidewell.llm.components import connected_components
from tidewell.llm.op9_decontamination import pieces_of
from tidewell.llm.shingles import circulant_minhash, mix64, shingle_sets
from tidewell.session import stored, table

BANDS, ROWS = 40, 4
#: Bytes of a shingle's hash that are compared; two sets of n shingles meet by chance with probability n * n / 2^48.
WIDTH = 6


def pack_set(s: np.ndarray) -> bytes:
    """The upper bytes of each hash, ascending."""
    return np.ascontiguousarray((s >> np.uint64(64 - 8 * WIDTH)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :WIDTH] = b
    return out.view("<u8").ravel()


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, for sorted sets without repeats."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _signatures(size: int):
    def run(batches):
        for b in batches:
            ids, n, keys, marks = b.column("doc_id"), [], [], []
            for part in pieces_of(b.column("text").to_pylist()):
                sets = shingle_sets(part, size)
                n += [len(s) for s in sets]
                # two sums over independent mixes stand for the whole set
                keys += [(int(s.sum(dtype=np.uint64).view(np.int64)), int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
                marks += [x.tobytes() for x in circulant_minhash(sets, BANDS * ROWS)]
            k1, k2 = zip(*keys) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(marks, pa.binary())], ["doc_id", "n", "k1", "k2", "mark"])

    return run


def _bands(batches):
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        m = np.frombuffer(b"".join(b.column("mark").to_pylist()), np.uint32).reshape(len(b), BANDS, ROWS).astype(np.uint64)
        h = np.full((len(b), BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(b))), pa.array(h.view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS))], ["band", "bucket", "doc"])


def _sets(size: int):
    def run(batches):
        for b in batches:
            out = [pack_set(s) for part in pieces_of(b.column("text").to_pylist()) for s in shingle_sets(part, size)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, pa.binary())], ["doc", "items"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = [linked(unpack_set(x.as_py()), unpack_set(y.as_py()), percent) for x, y in zip(b.column("x"), b.column("y"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int):
    """Links between the rows of the two sides of a group (left, right) that are in different components."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc", ignore_index=True)
        left, right = np.flatnonzero(frame["left"]), np.flatnonzero(frame["right"])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [unpack_set(x) for x in frame["items"]]
        size = np.array([len(x) for x in sets])
        _, places = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(size) - size
        flat = np.concatenate([places[begin[r] : begin[r] + size[r]] for r in right])
        starts = np.cumsum(size[right]) - size[right]
        docs, component = frame["doc"].to_numpy(), frame["component"].to_numpy()
        held = np.zeros(int(places.max()) + 1, np.int32)
        a, b = [], []
        for i in left:
            own = places[begin[i] : begin[i] + size[i]]
            held[own] = 1
            both = np.add.reduceat(held[flat], starts)
            held[own] = 0
            hit = right[(100 * both >= percent * (size[i] + size[right] - both)) & (component[right] != component[i])]
            a.append(np.full(len(hit), docs[i]))
            b.append(docs[hit])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _stars(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 1000) -> DataFrame:
    """The pairs (leader a, node b) that are linked. A leader of many nodes stands in several groups of about `most`."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").withColumn("group", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")).select("a", "b", "group")
    leaders = groups.join(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    both = dealt.join(sets.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b").join(leaders, ["a", "group"])
    return stored(both.mapInArrow(tidied(_verify(percent)), "a long, b long"), "stars")


def _dealt(side: DataFrame, group: str, left: bool, chunk: int) -> DataFrame:
    """Rows of one side of each group (n: rows of this side, m: of the other one), dealt to chunks of about `chunk` and
    copied to each chunk of the other side."""
    chunks = lambda c: F.ceil(F.col(c) / chunk).cast("int")
    rows = side.withColumn("mine", F.pmod(F.xxhash64("doc"), chunks("n")).cast("int")).withColumn("its", F.explode(F.sequence(F.lit(0), chunks("m") - 1)))
    first, second = ("mine", "its") if left else ("its", "mine")
    return rows.select(group, F.col(first).alias("ci"), F.col(second).alias("cj"), "doc", "component", F.lit(left).alias("left"), F.lit(not left).alias("right"))


def _work(n: str, m: str, chunk: int) -> Column:
    """What it costs to compare n sets with m: a set that moves to a chunk costs about as much as half a chunk of comparisons."""
    rows, others = F.col(n).cast("double"), F.col(m).cast("double")
    return rows * others + chunk / 2 * (rows * F.ceil(others / chunk) + others * F.ceil(rows / chunk))


def _left_over(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Step 4: the links between components that share a bucket."""
    by_top, by_place, others = _sides(members, labels, sets, chunk)
    compared = lambda rows, group: rows.join(sets, "doc").groupBy(group, "ci", "cj").applyInPandas(_across(percent), "a long, b long")
    return stored(compared(by_top, "top").unionByName(compared(by_place, "place")).unionByName(compared(others, "place")), "across")


def _sides(members: DataFrame, labels: DataFrame, sets: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What step 4 compares: the members of shared buckets outside and inside the component with most of them, by component
    (top) or by bucket (place), whichever is cheaper; and those outside against each other."""
    nodes = sets.select("doc").distinct().join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"))
    known = stored(members.select("band", "bucket", "doc").join(nodes, "doc"), "known")
    share = known.groupBy("band", "bucket", "component").agg(F.count("*").alias("n"))
    tops = share.groupBy("band", "bucket").agg(F.max(F.struct("n", F.col("component").alias("c"))).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("all")).where("parts > 1")
    tops = stored(tops.select("band", "bucket", F.col("top.c").alias("top"), "parts", (F.col("all") - F.col("top.n")).alias("outer"), F.col("top.n").alias("inner")), "tops")
    rows = stored(known.join(tops, ["band", "bucket"]).select(F.struct("band", "bucket").alias("place"), "doc", "component", "top", "parts", "outer", "inner"), "shared")
    outside, inside = rows.where("component <> top"), rows.where("component = top")

    # a node stands once for all buckets that it shares with a component
    asks, answers = (stored(x.select("top", "doc", "component").distinct(), "once") for x in (outside, inside))
    sizes = asks.groupBy("top").agg(F.count("*").alias("asks")).join(answers.groupBy("top").agg(F.count("*").alias("answers")), "top")
    apart = tops.groupBy("top").agg(F.sum(_work("outer", "inner", chunk)).alias("apart"))
    sizes = stored(sizes.join(apart, "top").withColumn("together", F.col("apart") >= _work("asks", "answers", chunk)), "sizes")
    counted = lambda side, n, m: side.join(sizes.where("together"), "top").withColumns({"n": F.col(n), "m": F.col(m)})
    by_top = _dealt(counted(asks, "asks", "answers"), "top", True, chunk).unionByName(_dealt(counted(answers, "answers", "asks"), "top", False, chunk))
    # bucket by bucket, where that is less
    placed = lambda side, n, m: side.join(sizes.where("NOT together").select("top"), "top", "left_semi").withColumns({"n": F.col(n), "m": F.col(m)})
    by_place = _dealt(placed(outside, "outer", "inner"), "place", True, chunk).unionByName(_dealt(placed(inside, "inner", "outer"), "place", False, chunk))
    # against each other, where the others are of several components
    rest = outside.where("parts > 2").withColumns({"n": F.col("outer"), "m": F.col("outer")})
    others = _dealt(rest, "place", True, chunk).unionByName(_dealt(rest, "place", False, chunk))
    return by_top, by_place, others


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, chunk: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs. chunk: sets of one side that a task compares at once."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    marked = stored(own.mapInArrow(tidied(_signatures(size)), "doc_id long, n long, k1 long, k2 long, mark binary"), "signatures")
    # nodes: the smallest doc_id of each set
    nodes = marked.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node"))
    nodes = stored(nodes, "nodes")
    marks = marked.join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "n", "k1", "k2"], "left_semi")
    # a doc_id may stand for several texts
    bands = marks.dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "mark").mapInArrow(tidied(_bands), "band int, bucket long, doc long").distinct()
    bands = stored(bands, "bands")
    shared = bands.groupBy("band", "bucket").agg(F.min("doc").alias("leader"), F.count("*").alias("members")).where("members > 1")
    members = stored(bands.join(shared, ["band", "bucket"]).select("band", "bucket", "doc", "leader"), "members")

    texts = own.withColumnRenamed("doc_id", "doc").join(members.select("doc").distinct(), "doc", "left_semi")
    sets = stored(texts.mapInArrow(tidied(_sets(size)), "doc long, items binary").groupBy("doc", F.xxhash64("items").alias("h")).agg(F.first("items").alias("items")).drop("h"), "sets")

    # links to the leaders: the smallest leader of each node first, then those of other components
    pairs = members.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    stars = _stars(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent)
    labels = connected_components(stars)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    apart = pairs.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    stars = stars.unionByName(_stars(apart, sets, percent))
    across = _left_over(members, connected_components(stars), sets, percent, chunk)
    labels = connected_components(across.unionByName(stars).unionByName(_same_id(nodes, marked)))

    out = marked.select("doc_id", "n", "k1", "k2").join(nodes, ["n", "k1", "k2"], "left").join(labels, "node", "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, without all but one of each class of near-duplicates.

    Rows with a null doc_id stay. Of rows with one doc_id the one with the smallest hash of the text stays, of repeated
    rows any.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # the row travels as one column, so its names can't clash with those of the work
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = rows.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "order").alias("row"))
    return first.unionByName(rows.where("doc_id IS NULL").select("doc_id", "row")).select("row.*")


def _same_id(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """Links between the nodes of rows that share a doc_id but not a text."""
    own = marked.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("n", "k1", "k2").alias("texts")).where("texts > 1").select("doc_id")
    rows = marked.select("doc_id", "n", "k1", "k2").join(own, "doc_id", "left_semi").where("n > 0").join(nodes, ["n", "k1", "k2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, and everything that links lead to.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(to_id) AS component_id, d.doc_id = min(to_id) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
