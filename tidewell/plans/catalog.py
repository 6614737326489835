"""All registered queries of the library proper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import base, materialize, modelling, registry, relational, rollups  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of orders and customer, materialized twice on one store; the second call is a hit."""
    return materialize.flagship(spark, sf_dir)
