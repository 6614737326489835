"""Validation of JSON documents held in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_errors(doc: Column, rules: dict[str, dict]) -> Column:
    """The list of errors of each document, addressed by field; empty where it satisfies the rules.

    rules: field -> type (Spark type name), and any of required, enum, minimum, maximum.
    """
    schema = ", ".join(f"`{k}` {r['type']}" for k, r in rules.items())
    parsed = F.from_json(doc, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    checks = [F.when(parsed["_bad"].isNotNull() | doc.isNull(), F.lit("$: not a document of these types"))]
    for k, r in rules.items():
        v = parsed[k]
        if r.get("required"):
            checks.append(F.when(v.isNull(), F.lit(f"{k}: required")))
        if "minimum" in r:
            checks.append(F.when(v < r["minimum"], F.lit(f"{k}: below {r['minimum']}")))
        if "maximum" in r:
            checks.append(F.when(v > r["maximum"], F.lit(f"{k}: above {r['maximum']}")))
        if "enum" in r:
            checks.append(F.when(~v.isin(*r["enum"]), F.lit(f"{k}: not allowed")))
    return F.filter(F.array(*checks), lambda e: e.isNotNull())
