"""Forecasts and features of many series: a key names a series, an order its time.

What is an average or a line is aggregated natively. Smoothing is a recursion: each series is taken by pandas, so a
series must fit a task, while any number of series are independent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moving_average(df: DataFrame, by: list[str], order: list[str], c: str, window: int, steps: int) -> DataFrame:
    """by, step (from 1), forecast: the mean of the last `window` values, for each step."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(o).desc() for o in order]))
    mean = df.where(F.col(c).isNotNull()).withColumn("_k", last).where(F.col("_k") <= window).groupBy(*by).agg(F.avg(c).alias("forecast"))
    return mean.select(*by, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "forecast")


def linear_trend(df: DataFrame, by: list[str], order: list[str], c: str, steps: int) -> DataFrame:
    """by, step, forecast: the least-squares line over positions, carried on."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    line = df.where(F.col(c).isNotNull()).withColumn("_t", at.cast("double")).groupBy(*by).agg(F.regr_slope(c, "_t").alias("_a"), F.regr_intercept(c, "_t").alias("_b"), F.count("*").alias("_n"), F.avg(c).alias("_m"))
    out = line.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    # a series of one value has no slope: it goes on level
    return out.select(*by, "step", F.coalesce(F.col("_a") * (F.col("_n") + F.col("step")) + F.col("_b"), F.col("_m")).alias("forecast"))


def exponential_smoothing(df: DataFrame, by: list[str], order: list[str], c: str, steps: int, alpha: float, beta: float | None = None, gamma: float | None = None, period: int = 0) -> DataFrame:
    """by, step, forecast. Simple with alpha; with beta a trend; with gamma and period an additive season too.

    Begun at the first value (level), the first difference (trend), and the distances of the first period from its mean (season).
    A series shorter than two values has a level only, one shorter than a period no season.
    """
    types = dict(df.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in by) + "step int, forecast double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order, kind="stable")[c].dropna().astype(float).to_list()
        if not x:
            return pd.DataFrame([], columns=[*by, "step", "forecast"])
        seasonal = gamma is not None and 0 < period <= len(x)
        mean = sum(x[:period]) / period if seasonal else 0.0
        season = [v - mean for v in x[:period]] if seasonal else [0.0]
        level = x[0] - season[0]
        trend = x[1] - x[0] if beta is not None and len(x) > 1 else 0.0
        for i, v in enumerate(x[1:], 1):
            k, before = i % len(season), level
            level = alpha * (v - season[k]) + (1 - alpha) * (level + trend)
            if beta is not None:
                trend = beta * (level - before) + (1 - beta) * trend
            if seasonal:
                season[k] = gamma * (v - level) + (1 - gamma) * season[k]
        out = [(*key, h, level + h * trend + season[(len(x) - 1 + h) % len(season)]) for h in range(1, steps + 1)]
        return pd.DataFrame(out, columns=[*by, "step", "forecast"])

    return df.groupBy(*by).applyInPandas(run, schema)


def autoregressive(df: DataFrame, by: list[str], order: list[str], c: str, steps: int, p: int = 1, d: int = 0) -> DataFrame:
    """by, step, forecast: least squares of the d-th differences on their p predecessors and a constant, carried on and summed up again.

    A series with fewer than p + 2 differences beyond the first p goes on by their mean; one of d values or fewer by its last value.
    """
    types = dict(df.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in by) + "step int, forecast double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order, kind="stable")[c].dropna().to_numpy(float)
        if not len(x):
            return pd.DataFrame([], columns=[*by, "step", "forecast"])
        if len(x) <= d:
            return pd.DataFrame([(*key, h, x[-1]) for h in range(1, steps + 1)], columns=[*by, "step", "forecast"])
        y = np.diff(x, d)
        weights = np.array([y.mean(), *[0.0] * p])
        if len(y) >= 2 * p + 2:
            past = np.column_stack([np.ones(len(y) - p), *[y[p - k : len(y) - k] for k in range(1, p + 1)]])
            weights = np.linalg.lstsq(past, y[p:], rcond=None)[0]
        tail = [*np.zeros(max(0, p - len(y))), *y]
        for _ in range(steps):
            tail.append(weights[0] + sum(w * tail[-k] for k, w in enumerate(weights[1:], 1)))
        ahead = np.array(tail[len(tail) - steps :])
        for k in range(d - 1, -1, -1):
            ahead = np.diff(x, k)[-1] + np.cumsum(ahead)
        return pd.DataFrame([(*key, h, v) for h, v in enumerate(ahead.tolist(), 1)], columns=[*by, "step", "forecast"])

    return df.groupBy(*by).applyInPandas(run, schema)


def features(df: DataFrame, by: list[str], order: list[str], c: str) -> DataFrame:
    """by and n, mean, std, min, max, slope, mean_change, mean_abs_change, above_mean, crossings of the series' mean."""
    w = Window.partitionBy(*by).orderBy(*order)
    mean = F.avg(c).over(Window.partitionBy(*by))
    known = df.where(F.col(c).isNotNull()).withColumns({"_t": F.row_number().over(w).cast("double"), "_d": F.col(c) - F.lag(c).over(w), "_up": F.col(c) > mean})
    known = known.withColumn("_cross", (F.col("_up") != F.lag("_up").over(w)).cast("int"))
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.regr_slope(c, "_t").alias("slope"),
        F.avg("_d").alias("mean_change"), F.avg(F.abs("_d")).alias("mean_abs_change"), F.count_if("_up").alias("above_mean"), F.coalesce(F.sum("_cross"), F.lit(0)).cast("long").alias("crossings"),
    )
