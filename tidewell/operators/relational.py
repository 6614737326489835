"""Relational operators that are more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import columns as C
from tidewell.operators import ordered


def drop_null_counts(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """How many rows dropna(subset) keeps and drops, in one pass."""
    whole = F.lit(True)
    for c in subset:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(~whole).alias("dropped"), F.count_if(whole).alias("kept"))


def mapped(value: Column, mapping: dict) -> Column:
    """The mapped value, null where there is none."""
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order as strings, nulls as a dash, with the table's number of rows and columns."""
    size = df.agg(F.count("*").alias("rows"))
    head = df.orderBy(*order).limit(n).select(*[F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in df.columns])
    return head.crossJoin(size).withColumn("columns", F.lit(len(df.columns)))


def fingerprint(df: DataFrame, label: str) -> DataFrame:
    """A digest of all rows that doesn't depend on their order: count, XOR and sum of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.lit(label).alias("label"), F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))


def within_budget(df: DataFrame, group: str, order: str, cost: Column, budget: int, most: int | None = None) -> DataFrame:
    """Per group, how many rows fit the budget in order, how many don't, and what is used."""
    if ordered.fits(df, most):
        run = df.select(group, F.sum(cost).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)).alias("run"))
    else:
        priced = df.select(group, order, cost.alias("cost"))
        run = ordered.running_total(priced, [group], [order], "cost").select(group, (F.col("before") + F.col("cost")).alias("run"))
    fits = F.col("run") <= budget
    return run.groupBy(group).agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"), F.coalesce(F.max(F.when(fits, F.col("run"))), F.lit(0)).cast("long").alias("used"))


def unmatched(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of left without a partner in right; null keys never match."""
    small = right.select(*[F.col(r).alias(f"_{r}") for r in keys.values()])
    on = F.lit(True)
    for a, b in keys.items():
        on = on & (F.col(a) == F.col(f"_{b}"))
    return left.join(small, on, "left_anti")


def mean_and_std(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_samp(c), 6)))])


PERCENTILES = {"p50": 50, "p95": 95, "p99": 99}
_SHARES = [p / 100 for p in PERCENTILES.values()]


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, places: int = 2, **at) -> DataFrame:
    """p50, p95, p99 as the value at rank ceil(n p), nulls left out. at: settings of `ordered.at_ranks`."""
    found = ordered.at_ranks(df, by, value, {name: lambda n, p=p: F.ceil(n * p / 100) for name, p in PERCENTILES.items()}, _SHARES, **at)
    return found.select(*by, *[F.round(n, places).alias(n) for n in PERCENTILES])


def nearest_rank_of_few(df: DataFrame, by: Sequence[str], value: str, places: int = 2) -> DataFrame:
    """The same for groups that hold a bounded number of rows each: a task holds a group."""
    return df.groupBy(*by).agg(*[F.round(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})"), places).alias(n) for n, p in PERCENTILES.items()])


def _floor_place(n: Column, p: int) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(p / 100)))


def floor_rank(df: DataFrame, by: Sequence[str], value: str, places: int = 2, **at) -> DataFrame:
    """p50, p95, p99 as the value at rank max(1, floor(n p)), nulls left out."""
    found = ordered.at_ranks(df, by, value, {name: lambda n, p=p: _floor_place(n, p) for name, p in PERCENTILES.items()}, _SHARES, **at)
    return found.select(*by, *[F.round(n, places).alias(n) for n in PERCENTILES])


def floor_rank_of_few(df: DataFrame, by: Sequence[str], value: str, places: int = 2) -> DataFrame:
    """The same for groups that hold a bounded number of rows each: a task holds a group."""
    own = W.partitionBy(*by)
    ranked = df.select(*by, F.col(value).alias("_v"), F.row_number().over(own.orderBy(F.col(value).asc_nulls_last())).alias("_r"), F.count(value).over(own).alias("_n"))
    return ranked.groupBy(*by).agg(*[F.round(F.max(F.when(F.col("_r") == _floor_place(F.col("_n"), p), F.col("_v"))), places).alias(n) for n, p in PERCENTILES.items()])


def medians(df: DataFrame, by: Sequence[str], value: str, places: int = 6, **at) -> DataFrame:
    return ordered.quantiles(df, by, value, {"median": 0.5}, **at).withColumn("median", F.round("median", places))


def histogram_le(df: DataFrame, value: str) -> DataFrame:
    """Counts by upper bound, with zeros for empty buckets."""
    names = [f"le_{b}ms" for b in C.BOUNDS_LE] + ["le_inf"]
    buckets = df.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    counts = df.groupBy(C.bucket_le(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_lt(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: counts of the eight latency buckets, then count, sum, average and maximum."""
    i, v = C.bucket_lt(F.col(value)), F.col(value)
    counts = [F.count_if(i == k).alias(f"b{k}") for k in range(len(C.LABELS_LT))]
    return df.groupBy(by).agg(*counts, F.count("*").alias("n"), F.round(F.sum(v), 2).alias("sum_ms"), F.round(F.sum(v) / F.count("*"), 2).alias("avg_ms"), F.round(F.max(v), 2).alias("max_ms"))


def bucket_percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Estimates from bucket midpoints: the first bucket whose running count reaches floor(n p)."""
    counts = df.groupBy(by, C.bucket_lt(F.col(value)).alias("i")).agg(F.count("*").alias("n"))
    own = W.partitionBy(by)
    run = counts.withColumns({"run": F.sum("n").over(own.orderBy("i")), "total": F.sum("n").over(own)})
    mid = F.array(*[F.lit(m) for m in C.MIDPOINTS])
    first = lambda p: F.min(F.when(F.col("run") >= F.floor(F.col("total") * F.lit(p)), F.col("i")))
    return run.groupBy(by).agg(*[F.get(mid, first(p)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def null_counts(df: DataFrame) -> DataFrame:
    """A row for each column that has nulls."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls").where("nulls > 0")


def describe(df: DataFrame, column: str, **at) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of a column, in one row."""
    quarters = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    plain = [F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.round(F.stddev_samp(column), 4).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")]
    out = df.agg(*plain).join(ordered.quantiles(df, [], column, quarters, **at), how="left")
    return out.select("n", "mean", "std", "min", *[F.round(q, 4).alias(q) for q in quarters], "max")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    """Counts per group and their percentage; the window runs over the groups, not the rows."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4).cast("double"))


def concatenate(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """UNION ALL of segments whose schemas must be equal."""
    for df in rest:
        if df.dtypes != first.dtypes:
            raise ValueError(f"segments differ: {first.dtypes} and {df.dtypes}")
        first = first.union(df)
    return first


def as_of_position(references: DataFrame, producers: DataFrame, variable: str = "variable", most: int | None = None) -> DataFrame:
    """For each reference (variable, pos), the last producer strictly before it; references without one are left out.

    One order over the union of both sides: the join on the variable alone would make all pairs of a variable.
    """
    # at one position the reference comes first, so its own definition isn't seen
    both = producers.select(variable, "pos", F.lit(1).alias("side")).unionByName(references.select(variable, "pos", F.lit(0).alias("side")))
    made_by = F.when(F.col("side") == 1, F.col("pos"))
    found = ordered.last_before(both, variable, ["pos", "side"], made_by, most)
    return found.where("side = 0 AND earlier IS NOT NULL").select("pos", variable, F.col("earlier").alias("producer"))


# ---------------------------------------------------------------- portfolio formulas
def _signed() -> Column:
    return C.signed_quantity(F.col("side"), F.col("qty"))


def positions(orders: DataFrame) -> DataFrame:
    """Open quantity and buy-weighted average cost by portfolio and ticker; closed positions are left out."""
    buy = F.col("side") == "buy"
    cost = F.try_divide(F.sum(F.when(buy, F.col("qty") * F.col("price"))), F.sum(F.when(buy, F.col("qty"))))
    out = orders.groupBy("portfolio", "ticker").agg(F.sum(_signed()).alias("qty"), F.round(F.coalesce(cost, F.lit(0.0)), 8).alias("avg_cost"))
    return out.where("qty <> 0")


def realized(orders: DataFrame) -> DataFrame:
    return orders.groupBy("ticker").agg(F.round(F.sum(-_signed() * F.col("price")), 2).alias("realized"))


def _marked(orders: DataFrame) -> DataFrame:
    mark = F.max_by("price", F.struct("ts", "l_orderkey", "l_linenumber"))
    return orders.groupBy("ticker").agg(F.sum(_signed()).alias("qty"), mark.alias("mark"))


def marked(orders: DataFrame) -> DataFrame:
    """Open quantity at the price of the ticker's last trade, in whole cents below."""
    return _marked(orders).select("ticker", "qty", (F.floor(F.col("qty") * F.col("mark") * 100) / 100).alias("value"))


def adjusted_total(orders: DataFrame) -> DataFrame:
    """Realized plus unrealized minus costs."""
    u = _marked(orders).agg(F.sum(F.col("qty") * F.col("mark")).alias("u"))
    r = orders.agg(F.sum(-_signed() * F.col("price")).alias("r"), F.sum(C.trade_cost(F.col("side"), F.col("qty"), F.col("price"))).alias("c"))
    return u.crossJoin(r).select(F.round(F.col("r") + F.col("u") - F.col("c"), 0).alias("total"))


def token_cost(turns: DataFrame, prices: DataFrame, fallback: float) -> DataFrame:
    """Cost of each turn at its role's rate for a million tokens, or at the fallback rate."""
    rate = F.coalesce("rate", F.lit(fallback))
    out = turns.select("conv_id", "turn", "role", C.approximate_tokens(F.col("text")).alias("tokens")).join(prices, "role", "left")
    return out.select("conv_id", "turn", F.round(F.col("tokens") * rate / 1_000_000, 8).alias("cost"))
