"""Materialization: results identified by what made them, stored once, as immutable versions.

An artifact store is a folder with a log of numbered commits (`sources/commit_log.py`). The events of a commit tell states
of versions and targets of names; what belongs together (a version that is ready, and its name) is one event. The state of
a version, and the target of a name, is what the commit with the largest number says; times are kept, but decide nothing.
Several writers may share a store. A payload is a Parquet folder that is written before its version is declared ready, and
never changed. Looking something up reads the newest checkpoint with a filter on it, and the few commits after it, so a
call's work doesn't grow with the number of artifacts. Deleted payloads, and those that no version tells of, are swept away
in two phases.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewell.session import stored
from tidewell.sources.commit_log import CommitLog

#: A version at its newest event; n is the number of the commit.
VERSIONS = "id string, version long, state string, provenance_hash string, row_count long, at double, transform string, inputs map<string,string>, tenant string, n long"
TARGETS = "tenant string, name string, id string, version long, n long"
#: The tables of a checkpoint; a bulk commit names a table of one or both kinds instead of telling events one by one.
TABLES = {"versions": VERSIONS, "targets": TARGETS}
#: Payloads lie in so many folders, which tasks list side by side.
SHARDS = 256
SWEPT = "id string, version long, files long, bytes long, reason string"

TRANSFORMS: dict[str, tuple[Callable, dict[str, type]]] = {}


def register_transform(name: str, **params: type):
    """Registers f(list of DataFrames, params) -> DataFrame under name@vN with typed parameters."""
    if not re.fullmatch(r"[\w.-]+@v\d+", name):
        raise ValueError(f"{name} is not of the form name@vN")

    def wrap(f: Callable) -> Callable:
        TRANSFORMS[name] = (f, params)
        return f

    return wrap


def list_transforms() -> list[str]:
    return sorted(TRANSFORMS)


def run_transform(name: str, inputs: Sequence[DataFrame], params: dict) -> DataFrame:
    if name not in TRANSFORMS:
        raise KeyError(f"unknown transform {name}")
    f, types = TRANSFORMS[name]
    if set(params) != set(types):
        raise ValueError(f"{name} takes {sorted(types)}, not {sorted(params)}")
    for k, t in types.items():
        if not isinstance(params[k], t):
            raise TypeError(f"{name}: {k} must be {t.__name__}")
    return f(list(inputs), params)


def sql_transform(spark: SparkSession, sql: str, inputs: Sequence[DataFrame]) -> DataFrame:
    """SQL over input0, input1, ...; string literals are left alone and other braces are kept."""
    if not sql.strip():
        raise ValueError("empty SQL")
    parts = re.split(r"('(?:[^']|'')*')", sql)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\binput(\d+)\b", r"{input\1}", parts[i].replace("{", "{{").replace("}", "}}"))
    parts[1::2] = [p.replace("{", "{{").replace("}", "}}") for p in parts[1::2]]
    used = {int(n) for n in re.findall(r"\{input(\d+)\}", "".join(parts))}
    if used and max(used) >= len(inputs):
        raise ValueError(f"input{max(used)} isn't given")
    return spark.sql("".join(parts), **{f"input{i}": inputs[i] for i in used})


@register_transform("sql@v1", sql=str)
def _sql(inputs: list[DataFrame], params: dict) -> DataFrame:
    return sql_transform(inputs[0].sparkSession, params["sql"], inputs)


@register_transform("scan@v1", columns=list, filters=list)
def _scan(inputs: list[DataFrame], params: dict) -> DataFrame:
    from tidewell.sources.scan import scan

    return scan(inputs[0], params["columns"] or None, [tuple(f) for f in params["filters"]])


def provenance_hash(inputs: Sequence[tuple[str, str]], transform: str, params: dict, salt: str = "") -> str:
    """SHA-256 over the input versions in their order, the transform and its parameters."""
    text = json.dumps({"inputs": [f"{u}:{v}" for u, v in inputs], "transform": transform, "params": params, "salt": salt}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Artifact:
    df: DataFrame
    id: str
    version: int
    hit: bool

    @property
    def uri(self) -> str:
        return f"artifact://{self.id}@v={self.version}"

    @property
    def input(self) -> tuple[str, str, DataFrame]:
        """As an input of the next materialization."""
        return f"artifact://{self.id}", f"{self.id}@v={self.version}", self.df


def payload_path(id_: str, version: int) -> str:
    """Where a payload lies below the store."""
    return f"payload/{int(hashlib.sha256(id_.encode()).hexdigest()[:8], 16) % SHARDS:02x}/{quote(id_, safe='')}/v={version}"


def _filesystem(uri: str):
    """A file system of pyarrow for tasks, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path, recursive=True, allow_not_found=True)


class State:
    """The store at a commit. What was looked up is remembered, so that later commits can be held against it.

    Its parts: the checkpoint, the events of the commits after it, and the tables that bulk commits among them name.
    """

    def __init__(self, store: ArtifactStore, number: int):
        self.store, self.number, self.seen = store, number, set()
        self.base, folder = max(((n, c) for n, c in store.log.checkpoints() if n <= number), default=(0, None))
        self.latest, self.named = {}, {}
        self.tables = {k: [(f"{store.root}/{folder}/{k}", None, ())] if folder else [] for k in TABLES}
        for e in store.log.between(self.base, number):
            if e.get("state"):
                self.latest[e["id"], e["version"]] = e
            if e.get("name"):
                self.named[e.get("tenant") or "", e["name"]] = e
            for k in TABLES:
                if e.get(k):
                    self.tables[k].append((f"{store.root}/{e[k]}", e["n"], e.get("but") or ()))

    def touched(self, events: list[dict]) -> bool:
        keys = {k for e in events for k in (("id", e.get("id")), ("hash", e.get("provenance_hash"), e.get("tenant") or ""))}
        return bool(keys & self.seen) or "all" in self.seen or any(e.get(k) for e in events for k in TABLES)

    # ---- as tables
    def _rows(self, rows: list[dict], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return self.store.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)

    def _stored(self, kind: str) -> DataFrame | None:
        """The rows of the checkpoint and of bulk commits; of one key there may be several, the one with the largest n counts."""
        out = None
        for path, n, but in self.tables[kind]:
            own = self.store.spark.read.schema(TABLES[kind]).parquet(path)
            own = own if n is None else own.withColumn("n", F.lit(n).cast("long"))
            own = own.join(self._rows([{"id": i, "version": v} for i, v in but], "id string, version long"), ["id", "version"], "left_anti") if but else own
            out = own if out is None else out.unionByName(own)
        return out

    def _newest(self, kind: str, fresh: list[dict], keys: list[str]) -> DataFrame:
        names = [c.split()[0] for c in TABLES[kind].split(", ")]
        rows, old = self._rows(fresh, TABLES[kind]), self._stored(kind)
        if old is None:
            return rows
        if len(self.tables[kind]) == 1 and self.tables[kind][0][1] is None:  # a checkpoint alone: what is newer replaces it
            return old.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
        newest = old.unionByName(rows).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in names if c not in keys]), "n").alias("e"))
        return newest.select(*keys, "e.*").select(*names)

    def all_versions(self) -> DataFrame:
        """The newest state of each version, deleted ones among them."""
        return self._newest("versions", list(self.latest.values()), ["id", "version"])

    def targets(self) -> DataFrame:
        """tenant, name, id, version, n: where each name points; without an id it is gone."""
        return self._newest("targets", [e | {"tenant": e.get("tenant") or ""} for e in self.named.values()], ["tenant", "name"])

    # ---- lookups: the events of commits, and a filter that the stored tables' files get
    def _found(self, kind: str, condition: Column, fresh: dict | None) -> dict | None:
        """The newest row of one key. After a checkpoint alone, an event is newer than what is stored."""
        bulk = any(n for _, n, _ in self.tables[kind])
        if self.tables[kind] and (fresh is None or bulk):
            old = [r.asDict() for r in self._stored(kind).where(condition).collect()]  # at most one for each table
            return max([*old, *([fresh] if fresh else [])], key=lambda r: r["n"], default=None)
        return fresh

    def version(self, id_: str, version: int) -> dict | None:
        """The newest state of a version that isn't deleted."""
        self.seen.add(("id", id_))
        found = self._found("versions", (F.col("id") == id_) & (F.col("version") == version), self.latest.get((id_, version)))
        return found if found and found["state"] != "deleted" else None

    def top(self, id_: str) -> int:
        """The largest version number that an id ever had."""
        self.seen.add(("id", id_))
        old = self._stored("versions")
        stored = old.where(F.col("id") == id_).agg(F.max("version")).first()[0] if old is not None else None
        return max([stored or 0, *(v for i, v in self.latest if i == id_)])

    def find(self, digest: str, tenant: str | None) -> tuple[str, int] | None:
        """The ready version with this hash that was declared last."""
        self.seen.add(("hash", digest, tenant or ""))
        mine = lambda e: e["provenance_hash"] == digest and (e.get("tenant") or "") == (tenant or "")
        own = [e for e in self.latest.values() if e["state"] == "ready" and mine(e)]
        if own and not any(n for _, n, _ in self.tables["versions"]):
            e = max(own, key=lambda e: e["n"])
            return e["id"], e["version"]
        old = self._stored("versions")
        if old is None:
            return None
        same = old.where((F.col("provenance_hash") == digest) & (F.coalesce("tenant", F.lit("")) == (tenant or ""))).select("id", "version", "state", "n")
        both = same.unionByName(self._rows([e for e in self.latest.values() if mine(e)], "id string, version long, state string, n long"))
        newest = both.groupBy("id", "version").agg(F.max_by("state", "n").alias("state"), F.max("n").alias("n")).where("state = 'ready'")
        row = newest.orderBy(F.desc("n"), "id", "version").first()
        return (row["id"], row["version"]) if row else None

    def target(self, name: str, tenant: str | None) -> tuple[str, int] | None:
        found = self._found("targets", (F.col("name") == name) & (F.col("tenant") == (tenant or "")), self.named.get((tenant or "", name)))
        return (found["id"], found["version"]) if found and found.get("id") else None


class ArtifactStore:
    """every: commits between two checkpoints."""

    def __init__(self, spark: SparkSession, root: str, every: int = 100):
        self.spark, self.root, self.every = spark, root.rstrip("/"), every
        self.log = CommitLog(spark, self.root)

    # ---- the log
    def state(self) -> State:
        return State(self, self.log.last())

    def _commit(self, decide: Callable):
        """decide(state) -> (events, result), as one commit; returns result. It is asked again if its state has changed."""

        def timed(state: State):
            events, result = decide(state)
            return [e | {"at": time.time()} for e in events], result

        number, result = self.log.commit(timed, self.state)
        if number and number % self.every == 0:
            self.compact(number)
        return result

    def compact(self, number: int | None = None) -> None:
        """Writes a checkpoint (of a commit; the newest one without). Readers of older ones aren't disturbed."""
        state = State(self, self.log.last() if number is None else number)

        def write(folder: str) -> None:
            # sorted by id, with a Bloom filter of the hashes: a lookup of either reads little
            out = state.all_versions().repartitionByRange("id").sortWithinPartitions("id", "version")
            out.write.option("parquet.bloom.filter.enabled#provenance_hash", "true").parquet(f"{folder}/versions")
            state.targets().repartitionByRange("name").sortWithinPartitions("name").write.parquet(f"{folder}/targets")

        if state.number > state.base:
            self.log.checkpoint(state.number, write)

    def versions(self) -> DataFrame:
        """The newest state of each version, and in n the commit that told it; deleted ones are left out."""
        return self.state().all_versions().where("state <> 'deleted'")

    def names(self) -> DataFrame:
        """Names of versions that are ready."""
        state = self.state()
        ready = state.all_versions().where("state = 'ready'").select("id", "version")
        return state.targets().where("id IS NOT NULL").join(ready, ["id", "version"], "left_semi")

    def version(self, id_: str, version: int) -> Row | None:
        found = self.state().version(id_, version)
        return Row(**{c.split()[0]: found.get(c.split()[0]) for c in VERSIONS.split(", ")}) if found else None

    # ---- writing
    def find(self, digest: str, tenant: str | None = None) -> tuple[str, int] | None:
        """The newest ready version with this hash."""
        return self.state().find(digest, tenant)

    def payload(self, id_: str, version: int) -> str:
        return f"{self.root}/{payload_path(id_, version)}"

    def begin(self, digest: str, transform: str = "put@v1", inputs: Sequence[tuple[str, str]] = (), tenant: str | None = None, id_: str | None = None) -> tuple[str, int]:
        """Declares the next version of id_ (a new id without one) as building."""
        id_ = id_ or digest[:16]

        def decide(state: State):
            version = state.top(id_) + 1
            return [{"id": id_, "version": version, "state": "building", "provenance_hash": digest, "transform": transform, "inputs": dict(inputs), "tenant": tenant}], (id_, version)

        return self._commit(decide)

    def finalize(self, id_: str, version: int, row_count: int | None = None, name: str | None = None) -> tuple[str, int]:
        """Declares a version ready, and names it, in one commit; returns the version that holds the result.

        A version that is ready already stays as it is. If another version of the same hash and tenant got ready meanwhile,
        this one is marked as failed and the other one is returned (and named).
        """

        def decide(state: State):
            v = state.version(id_, version)
            if v is None or v["state"] == "failed":
                raise ValueError(f"{id_}@v={version} isn't being built")
            own = {k: v.get(k) for k in ("id", "version", "provenance_hash", "transform", "inputs", "tenant")}
            other = None if v["state"] == "ready" else state.find(v["provenance_hash"], v.get("tenant"))
            if v["state"] == "building" and not other:
                return [own | {"state": "ready", "row_count": row_count, "name": name}], (id_, version)
            kept = other or (id_, version)
            events = [own | {"state": "failed"}] if other else []
            if name:
                events.append({"id": kept[0], "version": kept[1], "tenant": v.get("tenant"), "name": name})
            return events, kept

        return self._commit(decide)

    def fail(self, id_: str, version: int) -> None:
        """Marks a version as failed; one that is ready stays ready."""

        def decide(state: State):
            v = state.version(id_, version)
            if v is None or v["state"] != "building":
                return [], None
            return [{k: v.get(k) for k in ("id", "version", "provenance_hash", "transform", "inputs", "tenant")} | {"state": "failed"}], None

        self._commit(decide)

    def delete(self, id_: str, version: int, tenant: str | None = None) -> bool:
        """Deletes a version and with it its names, in one commit, and then the payload; False if there is none.

        Only its tenant may, or a caller without one: a version without a tenant is read by all, but not deleted by them.
        """

        def decide(state: State):
            v = state.version(id_, version)
            if v is None or not (tenant is None or v.get("tenant") == tenant):
                return [], False
            return [{k: v.get(k) for k in ("id", "version", "provenance_hash", "tenant")} | {"state": "deleted"}], True

        gone = self._commit(decide)
        if gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.payload(id_, version))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone

    def put(self, df: DataFrame, digest: str, transform: str = "put@v1", inputs: Sequence[tuple[str, str]] = (), name: str | None = None, tenant: str | None = None, id_: str | None = None) -> Artifact:
        """Stores df as the next version of id_ (a new id without one): the payload, then ready and the name in one commit.

        If another version of the same hash is ready by then, that one is returned."""
        id_, version = self.begin(digest, transform, inputs, tenant, id_)
        path = self.payload(id_, version)
        try:
            df.write.parquet(path)
            rows = self.spark.read.schema(df.schema).parquet(path).count()
        except Exception:
            self.fail(id_, version)
            raise
        kept = self.finalize(id_, version, rows, name)
        return Artifact(self.spark.read.schema(df.schema).parquet(self.payload(*kept)), *kept, kept != (id_, version))

    def materialize(self, inputs: Sequence[tuple[str, str, DataFrame]], transform: str, params: dict, name: str | None = None, tenant: str | None = None, refresh: bool = False) -> Artifact:
        """The stored result of the same inputs, transform and parameters, or a new one. inputs: (uri, version, frame)."""
        pairs = [(u, v) for u, v, _ in inputs]
        digest = provenance_hash(pairs, transform, params, uuid.uuid4().hex if refresh else "")
        found = None if refresh else self.find(digest, tenant)
        if found:
            out = Artifact(self.spark.read.parquet(self.payload(*found)), *found, True)
            if name:
                self.set_name(name, out.id, out.version, tenant)
            return out
        return self.put(run_transform(transform, [df for *_, df in inputs], params), digest, transform, pairs, name, tenant)

    def set_name(self, name: str, id_: str, version: int, tenant: str | None = None) -> None:
        def decide(state: State):
            v = state.version(id_, version)
            if v is None or v["state"] != "ready" or (v.get("tenant") or "") != (tenant or ""):
                raise ValueError(f"{id_}@v={version} is not a ready version of this tenant")
            return [{"id": id_, "version": version, "tenant": tenant, "name": name}], None

        self._commit(decide)

    def delete_name(self, name: str, tenant: str | None = None) -> None:
        self._commit(lambda state: ([{"tenant": tenant, "name": name}], None))

    # ---- in bulk
    def load(self, versions: DataFrame, targets: DataFrame | None = None) -> int:
        """Takes rows of VERSIONS (and TARGETS) into the store as one commit, whatever their number; columns that they lack
        are null. The payloads are the caller's. Returns the commit's number."""
        event = {}
        for kind, df in (("versions", versions), ("targets", targets)):
            if df is not None:
                event[kind] = f"bulk/{uuid.uuid4().hex}"
                names = [c.split()[0] for c in TABLES[kind].split(", ") if c != "n long"]
                missing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in TABLES[kind].split(", ") if c.split()[0] not in df.columns}
                df.withColumns(missing).select(*names).write.parquet(f"{self.root}/{event[kind]}")
        return self._commit_all(lambda state: ([event], None))

    def _commit_all(self, decide: Callable) -> int:
        """A bulk commit, and a checkpoint after it, so that lookups needn't fold its table."""
        number, _ = self.log.commit(decide, self.state)
        if number:
            self.compact(number)
        return number or self.log.last()

    def collect_garbage(self, before: float, tenant: str | None = None, states: Sequence[str] = ("ready", "failed")) -> DataFrame:
        """Marks as deleted, in one commit, the versions in these states that no name points to and whose time is before a
        time in seconds; of a tenant those without a tenant too. Returns them; sweep() deletes their payloads.

        Versions that get a name, or another state, while the garbage is looked for stay.
        """
        began, path = None, f"bulk/{uuid.uuid4().hex}"

        def decide(state: State):
            nonlocal began
            if began is None:
                began = state.number
                old = state.all_versions().where(F.col("state").isin(*states) & (F.col("at") < before))
                old = old if tenant is None else old.where(F.col("tenant").isNull() | (F.col("tenant") == tenant))
                named = state.targets().where("id IS NOT NULL").select("id", "version")
                old.join(named, ["id", "version"], "left_anti").withColumn("state", F.lit("deleted")).drop("n").write.parquet(f"{self.root}/{path}")
            state.seen.add("all")
            since = self.log.between(began, state.number)
            if any(e.get(k) for e in since for k in TABLES):
                raise RuntimeError("a bulk commit came between; call again")
            return [{"versions": path, "but": sorted({(e["id"], e["version"]) for e in since if e.get("id")})}], None

        self._commit_all(decide)
        own = self.spark.read.schema(VERSIONS).parquet(f"{self.root}/{path}").drop("n")
        return own.join(self.state().all_versions().where("state <> 'deleted'").select("id", "version"), ["id", "version"], "left_anti")

    def payloads(self) -> DataFrame:
        """id, version, files, bytes and newest (the time of the last change, in seconds) of the payloads that are there, listed
        by tasks, a shard each; whatever the log says of them."""
        root = self.log.files.fs.makeQualified(self.log.files.path("payload")).toUri().toString()

        def listed(frames):
            fs, top = _filesystem(root)
            for frame in frames:
                for shard in frame["id"]:
                    found: dict = {}
                    for f in fs.get_file_info(_selector(f"{top}/{shard:02x}")):
                        m = re.fullmatch(rf"{re.escape(top)}/[0-9a-f]+/([^/]+)/v=(\d+)(/.*)?", f.path)
                        if m:
                            row = found.setdefault((unquote(m[1]), int(m[2])), [0, 0, 0.0])
                            row[0] += f.is_file
                            row[1] += f.size or 0
                            row[2] = max(row[2], f.mtime.timestamp() if f.mtime else 0.0)
                    if found:
                        yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["id", "version", "files", "bytes", "newest"])

        tasks = min(SHARDS, 2 * self.spark.sparkContext.defaultParallelism)
        return self.spark.range(0, SHARDS, 1, tasks).mapInPandas(listed, "id string, version long, files long, bytes long, newest double")

    def sweep(self, grace_seconds: float, now: float | None = None) -> DataFrame:
        """Deletes the payloads that belong to no version that is ready or being built and haven't changed for a grace time:
        those of deleted and failed versions, and orphans, of which no commit tells. A row for each, with the reason.

        Payloads are listed before the state is read, and a version is declared before its payload is written, so one that
        is being written is known to the state, or younger than the grace time. Tasks that run again find nothing to do.
        """
        there = stored(self.payloads(), "payloads")
        known = self.state().all_versions().select("id", "version", "state")
        old = F.col("newest") <= (time.time() if now is None else now) - grace_seconds
        doomed = there.where(old).join(known, ["id", "version"], "left").where(F.coalesce("state", F.lit("orphan")).isin("deleted", "failed", "orphan"))
        rows = stored(doomed.select("id", "version", "files", "bytes", F.coalesce("state", F.lit("orphan")).alias("reason")), "doomed")
        root = self.log.files.fs.makeQualified(self.log.files.path("")).toUri().toString()

        def deleted(frames):
            fs, top = _filesystem(root)
            for frame in frames:
                for id_, version in zip(frame["id"], frame["version"]):
                    folder = f"{top}/{payload_path(id_, version)}"
                    if fs.get_file_info(folder).type.name == "Directory":
                        fs.delete_dir(folder)
                yield frame

        return stored(rows.repartition("id").mapInPandas(deleted, SWEPT), "swept")

    # ---- reading
    def resolve(self, ref: str, tenant: str | None = None) -> Row:
        """The version that artifact://id@v=N or a name stands for. It must be ready, and of this tenant or of none;
        without a tenant every version may be read."""
        m, state = re.fullmatch(r"artifact://(.+)@v=(\d+)", ref), self.state()
        at = (m[1], int(m[2])) if m else state.target(ref, tenant)
        v = at and state.version(*at)
        if v is None or v["state"] != "ready":
            raise KeyError(f"no artifact that is ready: {ref}")
        if not _may_read(v.get("tenant"), tenant):
            raise PermissionError(f"{ref} belongs to another tenant")
        return Row(**{c.split()[0]: v.get(c.split()[0]) for c in VERSIONS.split(", ")})

    def fetch(self, ref: str, tenant: str | None = None) -> DataFrame:
        """By artifact://id@v=N or by name."""
        v = self.resolve(ref, tenant)
        return self.spark.read.parquet(self.payload(v["id"], v["version"]))

    def preview(self, ref: str, tenant: str | None = None, n: int = 5) -> DataFrame:
        """One row: id, version, row_count, n_bytes of the payload, its schema, and its first n rows as JSON."""
        v = self.resolve(ref, tenant)
        df = self.spark.read.parquet(self.payload(v["id"], v["version"]))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.payload(v["id"], v["version"]))
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        head = df.limit(n).agg(F.array_sort(F.collect_list(F.to_json(F.struct("*")))).alias("preview"))
        fixed = [F.lit(x).alias(k) for k, x in (("id", v["id"]), ("version", v["version"]), ("row_count", v["row_count"]), ("n_bytes", size), ("schema", df.schema.simpleString()))]
        return head.select(*fixed, "preview")

    def of_cell(self, cell: str) -> DataFrame:
        """The ready versions of the variables of a cell: ids are cell:variable, and cell:variable@iter=K in loops."""
        own = self.versions().where((F.col("state") == "ready") & F.startswith("id", F.lit(f"{cell}:")))
        rest = F.substring("id", len(cell) + 2, 1 << 30)
        parts = [F.regexp_extract(rest, r"^(.*?)(?:@iter=(\d+))?$", i) for i in (1, 2)]
        return own.select(parts[0].alias("variable"), F.when(parts[1] != "", parts[1].cast("long")).alias("iteration"), "id", "version", "row_count")

    # ---- loops
    def iterations(self, cell: str, variable: str) -> DataFrame:
        """iteration, version: the newest ready version of each stored iteration."""
        own = self.of_cell(cell).where((F.col("variable") == variable) & F.col("iteration").isNotNull())
        return own.groupBy("iteration").agg(F.max("version").alias("version"))

    def iterate(self, cell: str, variable: str, carry: DataFrame, step: Callable, until: Callable, max_iter: int, tenant: str | None = None, start_from: int | None = None) -> tuple[DataFrame, int]:
        """carry, step(carry), ... until until(before, after) or max_iter. Each carry is a version of cell:variable@iter=K,
        which also cuts the plan. start_from: goes on from a stored iteration (-1: the last one) instead of carry."""
        name = lambda k: f"{cell}:{variable}@iter={k}"
        digest = lambda k: provenance_hash([(name(k), uuid.uuid4().hex)], "loop@v1", {})
        first = 0
        if start_from is None:
            carry = self.put(carry, digest(0), "loop@v1", tenant=tenant, id_=name(0)).df
        else:
            known = {r["iteration"]: r["version"] for r in self.iterations(cell, variable).collect()}
            first = max(known, default=None) if start_from == -1 else start_from
            if first not in known:
                raise KeyError(f"iteration {start_from} of {cell}:{variable} isn't stored")
            carry = self.spark.read.parquet(self.payload(name(first), known[first]))
        for k in range(first + 1, max_iter + 1):
            after = self.put(step(carry), digest(k), "loop@v1", tenant=tenant, id_=name(k)).df
            if until(carry, after):
                return after, k
            carry = after
        return carry, max(first, max_iter)


def _may_read(owner: str | None, tenant: str | None) -> bool:
    return tenant is None or owner is None or owner == tenant


def run_script(spark: SparkSession, statements: Sequence[str]) -> DataFrame:
    """Runs write statements in order; a row each: stmt, kind, rows_affected (null for DDL)."""
    out = []
    for i, sql in enumerate(statements):
        kind = re.match(r"\s*(\w+)", sql)[1].upper()
        rows = None
        target = re.match(r"\s*INSERT\s+INTO\s+(?:TABLE\s+)?(\S+)", sql, re.I)
        if target:  # one writer: what the table has more than before; Parquet counts come from the footers
            before = spark.table(target[1]).count()
            spark.sql(sql)
            rows = spark.table(target[1]).count() - before
        else:
            spark.sql(sql)
        out.append((i, kind, rows))
    return spark.createDataFrame(out, "stmt int, kind string, rows_affected long")


def put_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON string column, data."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("data"))


def get_json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("data", schema).alias("d")).select("d.*")
