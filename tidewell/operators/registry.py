"""Questions about versioned artifacts, as queries over the metadata tables.

versions: id, version, state, provenance_hash, row_count, byte_size, created_at, tenant, principal, executor
names: name, artifact_id, version, updated_at, tenant ('' for none)
edges: id, version, input_uri, input_version (a row for each input of a version)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OWN = "artifact://"


def tenant_key(c: str = "tenant") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def uri(id_: Column, version: Column) -> Column:
    return F.concat(F.lit(OWN), id_, F.lit("@v="), version.cast("string"))


def latest(versions: DataFrame) -> DataFrame:
    """The latest version of each id."""
    return versions.groupBy("id").agg(F.max_by(F.struct("version", "state", "created_at"), "version").alias("l")).select("id", "l.*")


def next_versions(versions: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """A new version number for each row of batch (column id): those of an id follow its largest one in order."""
    top = versions.groupBy("id").agg(F.max("version").alias("top"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(order))
    return batch.withColumn("_rank", rank).join(top, "id", "left").withColumn("version", (F.coalesce("top", F.lit(0)) + F.col("_rank")).cast("long")).drop("_rank", "top")


def usage(versions: DataFrame, names: DataFrame) -> DataFrame:
    """Store totals in one row: the versions are read once, the names joined once."""
    named = names.select(F.col("artifact_id").alias("id"), "version").distinct().withColumn("named", F.lit(True))
    v = versions.join(named, ["id", "version"], "left")
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = v.agg(
        F.count_distinct("id").alias("ids"), F.count("*").alias("versions"), state("ready"), state("building"), state("failed"),
        F.sum("byte_size").alias("bytes"), F.sum("row_count").alias("rows"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
        F.count_if(F.col("named").isNull() & (F.col("state") == "ready")).alias("unreferenced"),
    )
    return out.crossJoin(names.agg(F.count("*").alias("names")))


def current_inputs(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """input_uri, current: the newest ready version of an artifact, the newest version known of a table."""
    ready = versions.where("state = 'ready'").groupBy("id").agg(F.max("version").alias("top"))
    arts = ready.select(F.concat(F.lit(OWN), "id").alias("input_uri"), F.concat("id", F.lit("@v="), F.col("top").cast("string")).alias("current"))
    tables = edges.where(~F.col("input_uri").startswith(OWN)).groupBy("input_uri").agg(F.max(F.col("input_version").cast("long")).cast("string").alias("current"))
    return arts.unionByName(tables)


def find_by_provenance(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (request_id, provenance_hash, tenant) the newest ready artifact, null where there is none."""
    ready = versions.where("state = 'ready'").groupBy("provenance_hash", tenant_key().alias("tk"))
    best = ready.agg(F.max_by(F.struct("id", "version"), F.struct("created_at", "id", "version")).alias("b"))
    out = requests.withColumn("tk", tenant_key()).join(best, ["provenance_hash", "tk"], "left")
    return out.select("request_id", F.col("b.id").alias("id"), F.col("b.version").alias("version"))


def settle_duplicates(versions: DataFrame) -> DataFrame:
    """id, version, state: of ready versions with the same hash and tenant the first stays, the others fail."""
    own = W.partitionBy("provenance_hash", tenant_key(), "state").orderBy("created_at", "id", "version")
    rank = F.row_number().over(own)
    return versions.select("id", "version", F.when((F.col("state") == "ready") & (rank > 1), "failed").otherwise(F.col("state")).alias("state"))


def upsert_names(names: DataFrame, changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Names after changes (same columns): the latest row of each (tenant, name) whose target is a ready version of that tenant."""
    ready = versions.where("state = 'ready'").select(F.col("id").alias("artifact_id"), "version", tenant_key().alias("tenant"))
    valid = changes.join(ready, ["artifact_id", "version", "tenant"], "left_semi")
    both = names.unionByName(valid.select(*names.columns))
    row = F.max_by(F.struct("artifact_id", "version", "updated_at"), F.struct("updated_at", "version")).alias("r")
    return both.groupBy("tenant", "name").agg(row).select("name", "r.*", "tenant")


def name_status(names: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """Staleness of every name: inputs whose version changed, with the reason as text."""
    ins = names.join(edges.withColumnRenamed("id", "artifact_id"), ["artifact_id", "version"], "left")
    now = F.coalesce("current", F.lit("<unavailable>"))
    changed = F.col("input_uri").isNotNull() & (now != F.col("input_version"))
    text = F.when(changed, F.concat("input_uri", F.lit(": "), "input_version", F.lit(" -> "), now))
    out = ins.join(current_inputs(edges, versions), "input_uri", "left").groupBy("tenant", "name").agg(F.count_if(changed).alias("changed"), F.array_sort(F.collect_list(text)).alias("texts"))
    return out.select("tenant", "name", (F.col("changed") > 0).alias("is_stale"), "changed", F.when(F.col("changed") > 0, F.concat(F.lit("Rebuild needed: "), F.array_join("texts", ", "))).alias("reason"))


def explain(requests: DataFrame, versions: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """What each request (request_id, provenance_hash, tenant, name) would do: hit, build, and whether its name is stale."""
    hits = find_by_provenance(versions, requests)
    status = name_status(names, edges, versions).select("tenant", "name", "is_stale", "reason")
    r = requests.select("request_id", "name", tenant_key().alias("tenant")).join(hits, "request_id").join(status, ["tenant", "name"], "left")
    hit = F.col("id").isNotNull()
    return r.select("request_id", hit.alias("would_hit"), (~hit).alias("would_build"), F.when(hit, uri(F.col("id"), F.col("version"))).alias("uri"), (~hit & F.coalesce("is_stale", F.lit(False))).alias("is_stale"), F.when(~hit, F.col("reason")).alias("reason"))


def unnamed(versions: DataFrame, names: DataFrame) -> DataFrame:
    return versions.join(names.select(F.col("artifact_id").alias("id"), "version"), ["id", "version"], "left_anti")


def garbage(versions: DataFrame, names: DataFrame, before: Column) -> DataFrame:
    """Ready or failed versions without a name that were made before the given time."""
    return unnamed(versions.where(F.col("state").isin("ready", "failed") & (F.col("created_at") < before)), names)


def page(versions: DataFrame, limit: int, offset: int) -> DataFrame:
    return versions.orderBy(F.desc("created_at"), "id", "version").offset(offset).limit(limit)


def artifact_reference(version: Column) -> Column:
    """struct(id, version) of a text id@v=N, null for anything else."""
    id_, n = F.regexp_extract(version, r"^(.+)@v=(\d+)$", 1), F.regexp_extract(version, r"^(.+)@v=(\d+)$", 2)
    return F.when(id_ != "", F.struct(id_.alias("id"), n.cast("long").alias("version")))


def visible(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of a tenant and rows without one."""
    return df.where((F.col("tenant") == tenant) | F.col("tenant").isNull())


def acl_verdicts(requests: DataFrame, rules: DataFrame, default: str = "deny") -> DataFrame:
    """allow or deny for each request (request_id, principal, tenant, table_name): a deny rule wins, then an allow rule.

    rules: effect, principal (or * for any), tenant (null for any), glob. Requests that ask the same are judged once; they
    meet the rules on the principal, and the globs decide within it.
    """
    from tidewell.functions.columns import glob_regex

    asked = requests.select("principal", "tenant", "table_name").distinct()
    both = asked.withColumn("p", F.explode(F.array_distinct(F.array(F.coalesce("principal", F.lit("*")), F.lit("*")))))
    r = rules.select("effect", F.col("principal").alias("p"), F.col("tenant").alias("t"), glob_regex(F.col("glob")).alias("re"))
    hits = both.join(r, "p").where((F.col("t").isNull() | (F.col("t") == F.col("tenant"))) & F.regexp_like("table_name", F.col("re")))
    found = hits.groupBy("principal", "tenant", "table_name").agg(F.min(F.when(F.col("effect") == "deny", 0).when(F.col("effect") == "allow", 1)).alias("first"))
    named = found.select(F.col("principal").alias("p"), F.col("tenant").alias("t"), F.col("table_name").alias("n"), "first")
    same = F.col("principal").eqNullSafe(F.col("p")) & F.col("tenant").eqNullSafe(F.col("t")) & F.col("table_name").eqNullSafe(F.col("n"))
    verdict = F.when(F.col("first") == 0, "deny").when(F.col("first") == 1, "allow").otherwise(default)
    return requests.join(named, same, "left").select("request_id", verdict.alias("verdict"))


def allow_listed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """For each request (request_id, transform) the limit of the first rule (position, glob, max_rows) that matches.

    The globs are tried on the distinct transforms; requests join them by name."""
    from tidewell.functions.columns import glob_regex

    r = rules.select("position", "max_rows", glob_regex(F.col("glob")).alias("re"))
    names = requests.select(F.col("transform").alias("name")).distinct()
    first = names.join(r, F.regexp_like("name", F.col("re"))).groupBy("name").agg(F.min_by("max_rows", "position").alias("max_rows"), F.lit(True).alias("known"))
    out = requests.join(first, F.col("transform") == F.col("name"), "left")
    return out.select("request_id", "max_rows", F.coalesce("known", F.lit(False)).alias("allowed"))


def running_total(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """df with before: the sum of value over all rows earlier in a global order, without a single-task window."""
    from tidewell.operators import ordered

    return ordered.running_total(df, [], order, value)


def evictions(entries: DataFrame, budget: int, share: float = 0.8) -> DataFrame:
    """The oldest entries (id, version, created_at, byte_size) to delete until share of the budget is left, if it is exceeded."""
    total = entries.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total"))
    run = running_total(entries, ["created_at", "id", "version"], "byte_size").crossJoin(total)
    return run.where((F.col("total") > budget) & (F.col("total") - F.col("before") > int(budget * share))).select("id", "version", "byte_size")
