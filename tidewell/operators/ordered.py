"""Running values and exact ranks over groups of any size.

Ranks are found by multi-selection, one way for all sizes (`at_ranks`). A running value by a window holds a whole group in one
task. That is the fast way for inputs that the planner estimates at no more than `IN_ONE_TASK` bytes (its estimate comes
from file sizes and takes no job; what it doesn't know counts as large). Beyond that the rows are dealt to ranges of the
order, a task works on its range, and a row for each range and group carries what the ranges before it hold. Both ways
give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.session import stored

#: Bytes of an input that may stand in one task.
IN_ONE_TASK = 256 << 20


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether the planner's estimate of df is at most so many bytes. df isn't run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= (IN_ONE_TASK if most is None else most)


def _ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df in ranges of the order, numbered by range_no and stored, so that the numbers stay."""
    return stored(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with before: the sum of value over the rows of its group (by) that are earlier in order."""
    by, order = list(by), list(order)
    dealt = _ranges(df, [*by, *order])
    totals = dealt.groupBy(*by, "range_no").agg(F.sum(value).alias("part"))
    earlier = F.sum("part").over(W.partitionBy(*by).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1))
    carried = totals.select(*[F.col(c).alias(f"{c}_of_range") for c in by], F.col("range_no").alias("its_range"), F.coalesce(earlier, F.lit(0)).alias("carried"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("range_no", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = F.col("range_no") == F.col("its_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_range"))
    return dealt.withColumn("own", own).join(carried, same).withColumn("before", F.col("own") + F.col("carried")).select(*df.columns, "before")


def last_before(df: DataFrame, by: str, order: Sequence[str], value: Column, most: int | None = None) -> DataFrame:
    """df with earlier: the last value that isn't null among the rows of its group that are earlier in order."""
    order, rows = list(order), df.withColumn("seen", value)
    if fits(df, most):
        own = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn("earlier", F.last("seen", ignorenulls=True).over(own)).drop("seen")
    dealt = _ranges(rows, [by, *order])
    last = dealt.groupBy(by, "range_no").agg(F.max_by("seen", F.when(F.col("seen").isNotNull(), F.struct(*order))).alias("last"))
    carry = F.last("last", ignorenulls=True).over(W.partitionBy(by).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1))
    carried = last.select(F.col(by).alias("group"), F.col("range_no").alias("its_range"), carry.alias("carry"))
    own = F.last("seen", ignorenulls=True).over(W.partitionBy("range_no", by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    joined = dealt.withColumn("own", own).join(carried, (F.col("range_no") == F.col("its_range")) & F.col(by).eqNullSafe(F.col("group")))
    return joined.withColumn("earlier", F.coalesce("own", "carry")).select(*df.columns, "earlier")


#: Rows of a range between pivots that one task may sort.
RANGE_ROWS = 1_000_000
#: Pivots within a range that is still larger than that, evenly by rank.
GRID = [i / 32 for i in range(1, 32)]


def _cell(value: Column, pivots: Column, n: int) -> Column:
    """The number of the range of value: below, at, between and above the pivots, in order."""
    out = F.lit(0)
    for i in range(n):
        out = out + (value > pivots[i]).cast("int") + (value >= pivots[i]).cast("int")
    return out


def at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], shares: Sequence[float],
             accuracy: int = 10_000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per group n, the number of its values (nulls left out), and the values at the given ranks (1 is the smallest; a rank
    follows from n), null where the rank is outside 1 to n.

    Multi-selection. A range that holds a rank is split as long as it has more than range_rows rows; the first ranges are the
    groups. A mergeable sketch gives pivots, on both sides of each share in a group and evenly within later ranges; one pass
    counts the rows between pivots, and only ranges that hold a rank and more than one value are read again. In the ranges
    that are left equal values are counted before the shuffle. The pivots only decide how little is read: the counts are
    exact, so a rank outside its bracket is found in the range where it is.
    """
    keys = [f"_k{i}" for i in range(len(by) or 1)]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias(keys[0])]
    rows = df.select(*named, F.col(value).alias("_v"))
    near = sorted({min(1.0, max(0.0, p + e / accuracy)) for p in shares for e in (-2, 2)})
    groups = stored(rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", near, accuracy).alias("_pivots")).withColumn("_base", F.lit(0).cast("long")), "groups")
    held, ranges, cells, spans, n_pivots = rows.where("_v IS NOT NULL"), groups, list(keys), [], len(near)
    hit = lambda rank: (F.col("_before") < rank(F.col("_n"))) & (rank(F.col("_n")) <= F.col("_before") + F.col("_times"))
    some = F.lit(False)
    for rank in ranks.values():
        some = some | hit(rank)
    largest, last = groups.agg(F.max("_n")).first()[0] or 0, None
    # a range that pivots don't split holds values that share a double, so its distinct values are few
    while largest > range_rows and largest != last:
        level, last = f"_c{len(cells)}", largest
        dealt = _same(held, ranges, cells).withColumn(level, _cell(F.col("_v"), F.col("_pivots"), n_pivots))
        counted = dealt.groupBy(*cells, level).agg(F.count("*").alias("_times"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_n").alias("_n"), F.first("_base").alias("_base"))
        own = F.sum("_times").over(W.partitionBy(*cells).orderBy(level).rowsBetween(W.unboundedPreceding, -1))
        wanted = stored(counted.withColumn("_before", F.col("_base") + F.coalesce(own, F.lit(0))).where(some).drop("_base"), "wanted")
        cells = [*cells, level]
        spans.append(wanted.where("_low = _high").select(*keys, "_n", "_before", "_times", F.col("_low").alias("_v")))
        wide = wanted.where("_low < _high")
        largest, ranges = wide.agg(F.max("_times")).first()[0] or 0, wide.select(*cells, "_n", F.col("_before").alias("_base"))
        held = _same(dealt.drop("_n", "_base", "_pivots"), ranges.select(*cells), cells)
        if largest > range_rows:
            ranges = stored(_same(held.groupBy(*cells).agg(F.percentile_approx("_v", GRID, 1000).alias("_pivots")), ranges, cells), "ranges")
            n_pivots = len(GRID)
    counts = _same(held.groupBy(*cells, "_v").agg(F.count("*").alias("_times")), ranges.drop("_pivots"), cells)
    run = F.sum("_times").over(W.partitionBy(*cells).orderBy("_v").rowsBetween(W.unboundedPreceding, -1))
    spans.append(counts.withColumn("_before", F.col("_base") + F.coalesce(run, F.lit(0))).select(*keys, "_n", "_before", "_times", "_v"))
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    found = found.where(some).groupBy(*keys).agg(*[F.max(F.when(hit(rank), F.col("_v"))).alias(f"_r{i}") for i, rank in enumerate(ranks.values())])
    out = _same(groups.select(*keys, "_n"), found, keys, "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("_n").alias("n"), *[F.col(f"_r{i}").alias(name) for i, name in enumerate(ranks)])


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, a null being equal to a null; each key once."""
    other = right.select(*[F.col(k).alias(f"_of{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    return left.join(other, on, how).drop(*[f"_of{k}" for k in keys])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], **at) -> DataFrame:
    """Per group the interpolated quantiles at the shares, null for a group without values."""
    place = lambda p: lambda n: (n - 1) * F.lit(p)
    ranks = {}
    for name, p in shares.items():
        ranks[f"{name}_low"] = lambda n, at=place(p): F.floor(at(n)) + 1
        ranks[f"{name}_high"] = lambda n, at=place(p): F.ceil(at(n)) + 1
    found = at_ranks(df, by, value, ranks, list(shares.values()), **at)
    part = lambda p: place(p)(F.col("n")) - F.floor(place(p)(F.col("n")))
    return found.select(*by, *[(F.col(f"{name}_low") + part(p) * (F.col(f"{name}_high") - F.col(f"{name}_low"))).alias(name) for name, p in shares.items()])
