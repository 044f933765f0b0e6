"""Order-dependent transforms: cumulative, shifted, filled, rolling, expanding, exponentially weighted.

Every function takes the partition columns and the order explicitly. Without partition columns Spark puts all rows in one
task: `cumulative_global` gives running sums of a whole table by range partitions and offsets instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def upto(by: list[str], order: list[str]) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


# --- cumulative ---


def cumsum(c: str, by: list[str], order: list[str]) -> Column:
    """Running sum; NULL stays NULL and is skipped."""
    return F.when(F.col(c).isNotNull(), F.sum(c).over(upto(by, order)))


def cumprod(c: str, by: list[str], order: list[str]) -> Column:
    return F.when(F.col(c).isNotNull(), F.product(F.col(c)).over(upto(by, order)))


def cummax(c: str, by: list[str], order: list[str]) -> Column:
    return F.when(F.col(c).isNotNull(), F.max(c).over(upto(by, order)))


def cummin(c: str, by: list[str], order: list[str]) -> Column:
    return F.when(F.col(c).isNotNull(), F.min(c).over(upto(by, order)))


def slice_of(order: str, cuts: str, slices: int) -> Column:
    """How many of the ascending cuts (slices - 1) lie below the order: first among every step-th, then within a step."""
    step = max(1, math.isqrt(slices - 1))
    heads = F.filter(F.col(cuts), lambda x, i: (x < F.col(order)) & (i % step == step - 1))
    at = F.size(heads) * step
    return at + F.size(F.filter(F.slice(F.col(cuts), at + 1, F.lit(step)), lambda x: x < F.col(order)))


def cumulative_global(df: DataFrame, c: str, order: str, out: str, slices: int | None = None) -> DataFrame:
    """Running sum of c over the whole table in the order of one column, distributed.

    Rows are cut into slices at approximate quantiles of the order; sums of slices give each slice its offset. Rows of equal
    order are summed together (as by a RANGE window). There are as many slices as shuffle partitions, 64 at least.
    """
    slices = slices or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(k / slices) for k in range(1, slices)]), 20 * slices).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_slice", slice_of(order, "_cuts", slices)).drop("_cuts")
    sums = placed.groupBy("_slice").agg(F.sum(c).alias("_sum"))
    offsets = sums.select(F.col("_slice").alias("_s"), F.coalesce(F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inner = F.sum(c).over(Window.partitionBy("_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_inner", inner).join(F.broadcast(offsets), F.col("_slice") == F.col("_s")).withColumn(out, F.col("_inner") + F.col("_offset")).drop("_slice", "_s", "_inner", "_offset")


# --- shifted ---


def shift(c: str, n: int, by: list[str], order: list[str]) -> Column:
    w = ordered(by, order)
    return F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)


def diff(c: str, n: int, by: list[str], order: list[str]) -> Column:
    return F.col(c) - shift(c, n, by, order)


def pct_change(c: str, n: int, by: list[str], order: list[str]) -> Column:
    """NULL where the earlier value is NULL or 0."""
    before = shift(c, n, by, order)
    return F.try_divide(F.col(c) - before, before)


# --- filled ---


def ffill(c: str, by: list[str], order: list[str]) -> Column:
    return F.last(c, True).over(upto(by, order))


def bfill(c: str, by: list[str], order: list[str]) -> Column:
    return F.first(c, True).over(ordered(by, order).rowsBetween(0, Window.unboundedFollowing))


def interpolate(df: DataFrame, c: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """Linear by row number between the values around; NULL before the first and after the last."""
    df = df.withColumn("_i", F.row_number().over(ordered(by, order)).cast("double"))
    known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).cast("double").alias("v")))
    before = F.last(known, True).over(upto(by, order))
    after = F.first(known, True).over(ordered(by, order).rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_b", before).withColumn("_a", after)
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_i") - F.col("_b.i")) / F.nullif(F.col("_a.i") - F.col("_b.i"), F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.col(c).cast("double"), line)).drop("_i", "_a", "_b")


# --- rolling and expanding ---

AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def framed(c: str, how: str, w: WindowSpec, min_periods: int, q: float | None = None) -> Column:
    """An aggregate over a frame, NULL with fewer values than min_periods."""
    agg = F.percentile(c, F.lit(q)) if how == "quantile" else AGGREGATES[how](c)
    return F.when(F.count(c).over(w) >= min_periods, agg.over(w))


def rolling(c: str, how: str, window: int, by: list[str], order: list[str], min_periods: int | None = None, center: bool = False, q: float | None = None) -> Column:
    half = window // 2
    w = ordered(by, order).rowsBetween(-half, window - half - 1) if center else ordered(by, order).rowsBetween(1 - window, 0)
    return framed(c, how, w, window if min_periods is None else min_periods, q)


def expanding(c: str, how: str, by: list[str], order: list[str], min_periods: int = 1) -> Column:
    return framed(c, how, upto(by, order), min_periods)


def rolling_time(c: str, how: str, seconds: int, by: list[str], ts: str, min_periods: int = 1) -> Column:
    """Over the rows of the last so many seconds, the present one included: (t - seconds, t]."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return framed(c, how, w, min_periods)


def rolling_pair(a: str, b: str, how: str, window: int, by: list[str], order: list[str]) -> Column:
    """Rolling correlation or covariance of two columns."""
    w = ordered(by, order).rowsBetween(1 - window, 0)
    return F.when(F.count(a).over(w) >= window, (F.corr if how == "corr" else F.covar_samp)(a, b).over(w))


# --- exponentially weighted ---


def ewm(df: DataFrame, c: str, by: list[str], order: list[str], out: str, alpha: float | None = None, span: float | None = None, halflife: float | None = None, how: str = "mean") -> DataFrame:
    """The recursion y = alpha * x + (1 - alpha) * y, begun at the first value; NULL keeps the last y.

    A recursion has no Spark operator: each group is taken in order by pandas (groups of one key must fit a task).
    std and var weigh squared distances from the mean before in the same way.
    """
    if alpha is None:
        alpha = 2 / (span + 1) if span is not None else 1 - 0.5 ** (1 / halflife)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out}` double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        values = group[c].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True)
        result = values.mean() if how == "mean" else values.var(bias=True)
        # the first value has a variance of 0, and a gap keeps what was there before
        result = (result**0.5 if how == "std" else result).ffill()
        return group.assign(**{out: result.astype("Float64")})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield run(pd.concat(list(batches)))

    if by:
        return df.groupBy(*by).applyInPandas(run, schema)
    return df.coalesce(1).sortWithinPartitions(*order).mapInPandas(whole, schema)
