"""Secret scan with multipart credential linking, on DataFrame functions alone.

Base findings are regular-expression matches of three kinds (assign, access, hex). Beside them stand weak candidates,
which alone mean little: other key identifiers, bare base64 strings of the length of secrets, account names and
endpoints. Each finding has a role (identifier, secret, endpoint). An interval join over scopes reports a weak
candidate only when a part of another role begins or ends within `reach` code points of it in the same document; an
endpoint needs an identifier or a secret, an identifier or a secret needs the other one or an endpoint with it.

The join is an equi-join on document and scope (spans are dealt to scopes of `reach` code points, and to the
neighbouring scopes on one side), so no pairs beyond the neighbourhood of a span are made.

Cases: null texts are empty: no findings, the digest of the empty string. Rows with the same doc_id and text share
their findings and give a row each; rows with the same doc_id and other texts are apart, and null doc_ids are alike.
Findings with equal starts are listed in the order of the kinds. Empty tables give no rows. Texts of any length are
scanned whole, in time that grows with the length and the number of findings. Other columns are ignored by
find_secrets() and kept by redact(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import bind, whole_text
from tidewell.session import stored, table

# The patterns of the kinds, in the order in which equal starts are listed.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{16,}"), ("hex", r"[0-9a-f]{24,}"))
WEAK = (
    ("weak_access", r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}"),
    ("weak_account", r"(?i:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"),
    ("weak_secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/_-])"),
    ("weak_endpoint", r"(?i:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9][^\x20\x09-\x0D\"'<>]*"),
)
ROLES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "identifier", "weak_access": "identifier", "weak_account": "identifier", "weak_endpoint": "endpoint"}
KINDS = [k for k, _ in BASE + WEAK]
SPAN = "array<struct<start:int,kind:int,stop:int>>"
#: Steps of a fold that append to one list; a fold that appends to a single list copies it at each step.
CHUNK = 256


def _spans(text: Column, kind: int, pattern: str) -> Column:
    """array<struct<start, kind, stop>> of the leftmost non-overlapping matches, in code points.

    The positions follow from the lengths of the matches and of the pieces between them.
    """
    none = F.array().cast(SPAN)

    def placed(found: Column, between: Column) -> Column:
        def step(acc, i):
            match = F.element_at(found, i)
            begin = acc["at"] + F.length(F.element_at(between, i))
            stop = begin + F.length(match)
            span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))).cast(SPAN)
            if pattern == ASSIGN:  # its second group must be long enough
                span = F.when(F.length(F.regexp_extract(match, pattern, 2)) >= 6, span).otherwise(none)
            return F.struct(stop.alias("at"), F.concat(acc["spans"], span).alias("spans"))

        def some(acc, first):
            own = F.sequence(first, F.least(first + CHUNK - 1, F.size(found)))
            done = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
            return bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["lists"], F.array(d["spans"])).alias("lists")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("lists"))
        return F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(CHUNK)), start, some, lambda acc: F.flatten(acc["lists"]))

    return bind(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda found: F.when(F.size(found) == 0, none).otherwise(bind(F.split(text, pattern, -1), lambda between: placed(found, between))),
    )


def _listed(spans: Column) -> Column:
    """kind:start:stop by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _parts(found: DataFrame, column: str, reach: int, wide: bool) -> DataFrame:
    """A row for each span and scope that it touches; wide: the scopes beside it too."""
    s = F.col("s")
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    rows = found.select("key", F.explode(column).alias("s"))
    first, last = F.floor(s["start"] / reach).cast("int"), F.floor(s["stop"] / reach).cast("int")
    scopes = F.sequence(first - 1, last + 1) if wide else F.sequence(first, last)
    return rows.select("key", "s", F.element_at(roles, s["kind"] + 1).alias("role"), F.explode(scopes).alias("scope"))


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, base (array of spans), linked (array of the weak spans that have a complement), text_key."""
    text = whole_text()
    own = docs.select("doc_id", text.alias("text"))
    base = F.concat(*[_spans(F.col("text"), i, p) for i, (_, p) in enumerate(BASE)])
    weak = F.concat(*[_spans(F.col("text"), len(BASE) + i, p) for i, (_, p) in enumerate(WEAK)])
    found = stored(own.select("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h1"), F.crc32(F.encode("text", "utf-8")).alias("h2")).alias("key"), base.alias("base"), weak.alias("weak")), "secrets")
    # rows with the same key hold the same spans: one of them is joined
    with_weak = found.where(F.size("weak") > 0).select("key", "base", "weak").dropDuplicates(["key"])
    # a base finding that a weak one overlaps is the same string, not its complement
    left = _parts(with_weak, "weak", reach, wide=True).select(F.col("key").alias("k"), "scope", F.col("s").alias("w"), F.col("role").alias("weak_role"))
    both = with_weak.select("key", F.concat("base", "weak").alias("all"))
    right = _parts(both, "all", reach, wide=False)
    gap = F.greatest(F.col("w")["start"] - F.col("s")["stop"], F.col("s")["start"] - F.col("w")["stop"])
    hits = left.join(right, F.col("k").eqNullSafe(F.col("key")) & (left["scope"] == right["scope"]) & (F.col("weak_role") != F.col("role")) & (gap >= 0) & (gap <= reach))
    linked = hits.groupBy("k").agg(F.collect_set("w").alias("linked"))
    out = found.join(linked, F.col("key").eqNullSafe(F.col("k")), "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"), F.col("key")["h1"].alias("text_key"))


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of the spans, which are sorted by start; overlapping spans become one mark.

    A chunk of spans cuts its own part of the text, so the text isn't walked from its start for each span.
    """
    none = F.array().cast("array<string>")

    def some(acc, first):
        own = F.slice(spans, first, CHUNK)
        base, end = acc["at"], F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["stop"])))

        def cut(region: Column) -> Column:
            def step(inner, s):
                piece = F.substring(region, inner["at"] - base + 1, s["start"] - inner["at"])
                fresh = F.struct(s["stop"].alias("at"), F.concat(inner["out"], F.array(piece, F.lit(mark))).alias("out"))
                return F.when(s["start"] >= inner["at"], fresh).otherwise(F.struct(F.greatest(inner["at"], s["stop"]).alias("at"), inner["out"].alias("out")))

            return F.aggregate(own, F.struct(base.alias("at"), none.alias("out")), step)

        done = bind(F.substring(text, base + 1, end - base), cut)
        return bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["lists"], F.array(d["out"])).alias("lists")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("lists"))
    return F.aggregate(F.sequence(F.lit(1), F.size(spans), F.lit(CHUNK)), start, some, lambda acc: F.concat(F.array_join(F.flatten(acc["lists"]), ""), F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, reach: int = 200, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of the text replaced by mark; overlapping spans become one mark.

    Null texts stay null. Rows without findings stay as they are.
    """
    found = find_secrets(docs, reach).select("doc_id", F.col("text_key").alias("key"), F.sort_array(F.concat("base", "linked")).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"])
    # the row travels as one column, so its names can't clash with those of the work
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(whole_text()).alias("its_key"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("its_key") == F.col("key")), "left")
    text = F.col("row.text")
    clean = F.when(F.col("spans").isNull() | text.isNull(), text).otherwise(_replaced(text, F.col("spans"), mark))
    return joined.select(F.col("row").withField("text", clean).alias("row")).select("row.*")


def without_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """redact() for a table of documents: n_chars, where there is one, follows the text."""
    out = redact(docs, reach)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"))
