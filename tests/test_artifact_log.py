"""The artifact store's numbered commits, checkpoints, bulk commits and the sweeping of payloads."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewell.sources import artifacts as A
from tidewell.sources.commit_log import CommitLog


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/my store"


def test_two_writers_lose_nothing(spark, root):
    """Both take the next version of one id 200 times: each number is given once."""
    got, problems = [], []

    def writer(k):
        try:
            s = A.ArtifactStore(spark, root, every=1000)
            got.extend((s.begin(f"{k}-{i}", id_="shared")[1], k) for i in range(200))
        except Exception as e:
            problems.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems and sorted(v for v, _ in got) == list(range(1, 401))
    s = A.ArtifactStore(spark, root)
    assert s.log.last() == 400
    rows = s.versions().collect()
    assert sorted((r["version"], r["provenance_hash"].split("-")[0]) for r in rows) == sorted((v, str(k)) for v, k in got)
    assert sorted(r["n"] for r in rows) == list(range(1, 401))


def test_commits_that_dont_touch_are_renumbered(spark, root):
    """A commit in between is met under its number; only one that touches what was read makes the decision anew."""
    log, other, asked = CommitLog(spark, root), CommitLog(spark, root), []

    class At:
        def __init__(self):
            self.number = log.last()

        def touched(self, events):
            return any(e["k"] == "mine" for e in events)

    def decide(state):
        asked.append(state.number)
        if len(asked) == 1:
            for k in ("a", "b"):
                other.commit(lambda s, k=k: ([{"k": k}], None), At)
        if len(asked) == 2:
            other.commit(lambda s: ([{"k": "mine"}], None), At)
        return [{"k": "x"}], len(asked)

    assert log.commit(decide, At) == (3, 1) and asked == [0]
    assert log.commit(decide, At) == (5, 3) and asked == [0, 3, 4]
    assert [[e["k"] for e in log.read(n)] for n in range(1, 6)] == [["a"], ["b"], ["x"], ["mine"], ["x"]]
    assert not log.files.create("commits/00000000000000000005.json", b"{}") and log.read(5)[0]["k"] == "x"


def test_a_clock_set_back_changes_nothing(spark, root, monkeypatch):
    s, df, now = A.ArtifactStore(spark, root), spark.range(3), time.time()
    id_, version = s.begin("h")
    df.write.parquet(s.payload(id_, version))
    monkeypatch.setattr(A.time, "time", lambda: now - 5000)
    assert s.finalize(id_, version, 3, "n") == (id_, version)
    monkeypatch.setattr(A.time, "time", lambda: now - 9000)
    again = s.put(spark.range(4), "k", name="n")
    assert s.version(id_, version)["state"] == "ready" and s.fetch("n").count() == 4 and s.resolve("n")["id"] == again.id


def test_readers_outlive_compaction(spark, root):
    s, other = A.ArtifactStore(spark, root), A.ArtifactStore(spark, root)
    df = spark.range(3)
    first = s.put(df, "a" * 64, name="one")
    before, early = s.versions(), s.log.last()
    s.compact()
    middle = s.versions()
    other.put(df, "b" * 64, name="two")  # a writer beside it
    s.compact()
    assert s.log.expire(3600) == 0  # all of it is younger than the grace time
    assert before.count() == 1 and middle.count() == 1 and s.versions().count() == 2
    other.set_name("three", first.id, first.version)
    assert s.log.expire(0) == s.log.last() - 1 > early
    assert sorted(r["name"] for r in s.names().collect()) == ["one", "three", "two"]
    late = A.ArtifactStore(spark, root)
    assert late.log.last() == s.log.last() and late.fetch("one").count() == 3
    late.put(df, "c" * 64)
    assert other.versions().count() == 3  # a store whose newest known commits are gone finds its way


def test_lookups_after_checkpoints(spark, root):
    s, df = A.ArtifactStore(spark, root, every=4), spark.range(3)
    a = s.put(df, "a" * 64, name="n", id_="x:y@iter=0")
    b = s.put(df, "b" * 64, id_="x:y@iter=0", tenant="t")
    assert len(s.log.checkpoints()) == 1 and (a.version, b.version) == (1, 2)
    assert s.find("a" * 64) == (a.id, 1) and s.find("b" * 64) is None and s.find("b" * 64, "t") == (a.id, 2)
    assert not s.delete(b.id, 2, "other") and s.delete(b.id, 2, "t")
    assert s.find("b" * 64, "t") is None and s.version(b.id, 2) is None
    s.compact()
    assert s.find("b" * 64, "t") is None and s.put(df, "c" * 64, id_=a.id).version == 3  # numbers aren't given twice
    s.delete_name("n")
    s.compact()
    with pytest.raises(KeyError):
        s.fetch("n")
    assert s.fetch(a.uri).count() == 3


def test_a_tenant_deletes_its_own_only(spark, root):
    s, df = A.ArtifactStore(spark, root), spark.range(1)
    shared, own = s.put(df, "a" * 64), s.put(df, "b" * 64, tenant="t1")
    assert s.fetch(shared.uri, "t1").count() == 1 and not s.delete(shared.id, 1, "t1")
    assert s.delete(own.id, 1, "t1") and s.delete(shared.id, 1)


def test_garbage_is_marked_and_swept(spark, root):
    s, df = A.ArtifactStore(spark, root), spark.range(5)
    named, loose, young = s.put(df, "a" * 64, name="n"), s.put(df, "b" * 64), s.put(df, "c" * 64)
    failed, building = s.begin("d"), s.begin("e")
    for at in (failed, building, ("orphan: 100%/x", 7)):
        df.write.parquet(s.payload(*at))
    s.fail(*failed)
    limit = s.version(*((young.id, 1)))["at"]
    before = {(r["id"], r["version"]): r["bytes"] for r in s.payloads().collect()}
    assert len(before) == 6 and min(before.values()) > 0
    marked = s.collect_garbage(limit).collect()
    assert [(r["id"], r["version"]) for r in marked] == [(loose.id, 1)]
    assert s.sweep(3600).count() == 0 and len(s.payloads().collect()) == 6  # all are younger than the grace time
    swept = {(r["id"], r["version"]): (r["reason"], r["bytes"]) for r in s.sweep(0, time.time() + 5).collect()}
    assert swept == {(loose.id, 1): ("deleted", before[loose.id, 1]), failed: ("failed", before[failed]), ("orphan: 100%/x", 7): ("orphan", before["orphan: 100%/x", 7])}
    assert {(r["id"], r["version"]) for r in s.payloads().collect()} == {(named.id, 1), (young.id, 1), building}
    assert s.finalize(*building, 5) == building and s.fetch(f"artifact://{building[0]}@v=1").count() == 5
    assert s.sweep(0, time.time() + 5).count() == 0
    with pytest.raises(KeyError):
        s.fetch(loose.uri)


def test_a_name_that_comes_while_garbage_is_looked_for(spark, root):
    s, other, df = A.ArtifactStore(spark, root), A.ArtifactStore(spark, root), spark.range(5)
    one, two = s.put(df, "a" * 64), s.put(df, "b" * 64)
    create, done = s.log.files.create, []

    def late(name, data):
        if name.startswith("commits") and not done:
            done.append(other.set_name("saved", one.id, 1))
        return create(name, data)

    s.log.files.create = late
    assert [r["id"] for r in s.collect_garbage(time.time() + 5).collect()] == [two.id]
    assert s.fetch("saved").count() == 5 and s.version(two.id, 1) is None


def test_bulk(spark, root):
    s, df = A.ArtifactStore(spark, root), spark.range(2)
    rows = spark.range(1000).select(F.format_string("i%d", "id").alias("id"), F.lit(1).cast("long").alias("version"), F.lit("ready").alias("state"), F.format_string("h%d", F.col("id") % 500).alias("provenance_hash"))
    names = rows.where("id < 'i2'").select(F.lit("").alias("tenant"), F.concat(F.lit("n"), "id").alias("name"), "id", "version")
    a = s.put(df, "h7")
    assert s.load(rows, names) == 3 and s.versions().count() == 1001 and s.names().count() == names.count()
    assert s.find("h7")[0] in ("i7", "i507") and s.find("h499") is not None and s.find("h500") is None
    assert s.begin("x", id_="i5") == ("i5", 2) and s.version(a.id, 1)["state"] == "ready"
    b = s.put(df, "h7", tenant="t", name="own")
    assert s.find("h7", "t") == (b.id, b.version) and s.state().target("ni1", None) == ("i1", 1)
    assert s.collect_garbage(0).count() == 0  # no time is before 0: rows without a time stay


def test_half_a_checkpoint_doesnt_count(spark, root):
    s = A.ArtifactStore(spark, root)
    s.put(spark.range(1), "a" * 64)
    os.makedirs(f"{s.log.files.local}/checkpoints/00000000000000000002-dead/versions")
    assert s.versions().count() == 1 and s.log.checkpoints() == []
    s.compact()
    assert len(s.log.checkpoints()) == 1 and s.versions().count() == 1


def test_a_folder_that_isnt_mounted(spark, root):
    """The way through Hadoop's file systems, as other stores take it, here over the same folder."""
    s = A.ArtifactStore(spark, root)
    s.log.files.local = None
    a = s.put(spark.range(3), "a" * 64, name="n")
    assert s.log.last() == 2 and s.fetch("n").count() == 3 and s.log.read(2)[0]["state"] == "ready"
    assert s.log.files.create("commits/00000000000000000007.json", b'{"x": 1}') and not s.log.files.create("commits/00000000000000000007.json", b"{}")
    assert s.log.files.read("commits/00000000000000000007.json") == b'{"x": 1}' and not [f for f in s.log.files.names("commits") if f.startswith(".0") and not f.endswith(".crc")]
    s.compact()
    assert s.versions().count() == 1 and s.delete(a.id, a.version)
