"""Column functions. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the latency histograms, in milliseconds.
BOUNDS_LE = [10, 25, 50, 100, 250, 500, 1000, 2500, 5000]
BOUNDS_LT = [10, 50, 100, 250, 500, 1000, 5000]
LABELS_LT = ["0-10ms", "10-50ms", "50-100ms", "100-250ms", "250-500ms", "500ms-1s", "1s-5s", "5s+"]
MIDPOINTS = [5, 30, 75, 175, 375, 750, 3000, 7500]


def safe_ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole rounded, 0 where whole is 0 or null."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), places), F.lit(0.0))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by a colon."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def approximate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def ttl_bucket(ts: Column, seconds: int) -> Column:
    """floor(epoch seconds / ttl)."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


def glob_regex(glob: Column) -> Column:
    """A glob (*, ?, [...]) as an anchored regular expression, computed from the pattern column."""
    quoted = F.regexp_replace(glob, r"([.^$+(){}|\\])", r"\\$1")
    opened = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(opened, r"\[!", "[^"), F.lit(")$"))


def glob_match(name: Column, glob: str) -> Column:
    out = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]" else re.escape(c)) for c in glob).replace("[\\!", "[^").replace("[!", "[^")
    return name.rlike(f"^(?s:{out})$")


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern is found, ignoring case."""
    lower = F.lower(text)
    out = None
    for label, pattern in rules:
        hit = lower.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def bucket_le(value: Column, bounds: Sequence[int] = BOUNDS_LE) -> Column:
    """le_<bound>ms of the first bound that is not below value, else le_inf."""
    out = F.when(value <= bounds[0], f"le_{bounds[0]}ms")
    for b in bounds[1:]:
        out = out.when(value <= b, f"le_{b}ms")
    return out.otherwise("le_inf")


def bucket_lt(value: Column, bounds: Sequence[int] = BOUNDS_LT) -> Column:
    """The index of the first bound above value, else their number."""
    out = F.when(value < bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(value < b, i)
    return out.otherwise(len(bounds))


def signed_quantity(side: Column, qty: Column) -> Column:
    return F.when(side == "buy", qty).otherwise(-qty)


def trade_cost(side: Column, qty: Column, price: Column, bps: float = 5.0, fee: float = 0.000166, cap: float = 8.3) -> Column:
    """Slippage in basis points of the notional, and a fee for each unit sold up to a cap."""
    return qty * price * (bps / 10_000) + F.when(side == "sell", F.least(qty * fee, F.lit(cap))).otherwise(0.0)


def canonical_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def tagged(value: Column, kind: str) -> Column:
    """kind:value, so that a number and the string of its digits differ."""
    return F.concat(F.lit(kind + ":"), value.cast("string"))


def provenance(inputs: Sequence[Column], spec: Column) -> Column:
    """SHA-256 over input versions in their order and the transform's canonical text."""
    return F.sha2(F.concat_ws("\n", *inputs, spec), 256)


def conjunction(filters: Sequence[tuple[str, str, object]]) -> Column:
    """(column, op, value) filters joined by AND; op is one of = != < <= > >=."""
    ops = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    return reduce(Column.__and__, [ops[op](F.col(c), F.lit(v)) for c, op, v in filters], F.lit(True))


def filter_fingerprint(filters: Sequence[tuple[str, str, object]]) -> str:
    """A digest that doesn't depend on the order of the filters."""
    import hashlib

    if not filters:
        return "nofilter"
    return hashlib.md5("|".join(sorted(f"{c} {op} {type(v).__name__}:{v!r}" for c, op, v in filters)).encode()).hexdigest()[:16]


def render(template: str, values: dict[str, Column]) -> Column:
    """{{ name }} replaced by the row's value; a name without a value is left as it is."""
    parts = re.split(r"(\{\{\s*\w+\s*\}\})", template)
    out = []
    for p in parts:
        name = p.strip("{} \t")
        out.append(F.coalesce(values[name].cast("string"), F.lit("")) if p.startswith("{{") and name in values else F.lit(p))
    return F.concat(*out)
