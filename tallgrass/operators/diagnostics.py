"""Diagnostics of series: stationarity, autocorrelation, normality, outliers, changes of the mean; a row for each series.

Values that are NULL are left out. Lags are windows within a series (streamed in order, not held); all else is aggregation.
Statistics of a series without spread are 0, or what the docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as P

# fixed values: critical values at 1, 5 and 10 percent
DRIFT_CRITICAL = (-3.43, -2.86, -2.57)
KPSS_CRITICAL = {"constant": (0.739, 0.463, 0.347), "linear": (0.216, 0.146, 0.119)}
#: Shortest series of the stationarity tests.
LEAST = 10


def _series(df: DataFrame, by: list[str], order: list[str], c: str) -> tuple[DataFrame, Window]:
    kept = df.where(F.col(c).isNotNull()).select(*by, *order, F.col(c).cast("double").alias("_x"))
    return kept, Window.partitionBy(*by).orderBy(*order)


def _over(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def drift_test(df: DataFrame, by: list[str], order: list[str], c: str, scale: float = 1.0) -> DataFrame:
    """by, statistic, n_lags, p (0.01, 0.05, 0.1 or 0.2) and is_stationary, of the mean step over its standard error.

    Without lagged terms. Series of fewer than 10 values are left out. `scale` multiplies the statistic:
    0.95 gives the Phillips-Perron variant, whose p is that of the unscaled one.
    """
    kept, w = _series(df, by, order, c)
    steps = kept.withColumn("_d", F.col("_x") - F.lag("_x").over(w))
    s = steps.groupBy(*by).agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"), F.count("*").alias("_n")).where(F.col("_n") >= LEAST)
    plain = _over(F.col("_m"), F.col("_s") / F.sqrt(F.col("_n") - 1))
    one, five, ten = DRIFT_CRITICAL
    p = F.when(F.col("_t") < one, 0.01).when(F.col("_t") < five, 0.05).when(F.col("_t") < ten, 0.1).otherwise(0.2)
    lags = F.floor(F.cbrt(F.col("_n")) * 0.12).cast("long")
    return s.withColumn("_t", plain).select(*by, (F.col("_t") * scale).alias("statistic"), lags.alias("n_lags"), p.alias("p"), (F.col("_t") * scale < five).alias("is_stationary"))


def kpss(df: DataFrame, by: list[str], order: list[str], c: str, trend: str = "constant") -> DataFrame:
    """by, statistic, p (0.01, 0.05, 0.1 or 0.15) and is_stationary: squared running sums of residuals over n^2 times their variance.

    Residuals are of the mean, or of the least-squares line over positions. Series of fewer than 10 values are left out;
    without spread the statistic is 0.
    """
    kept, w = _series(df, by, order, c)
    placed = kept.withColumn("_t", (F.row_number().over(w) - 1).cast("double"))
    line = placed.groupBy(*by).agg(F.avg("_x").alias("_m"), F.regr_slope("_x", "_t").alias("_a"), F.regr_intercept("_x", "_t").alias("_b"), F.count("*").alias("_n")).where(F.col("_n") >= LEAST)
    fitted = F.col("_m") if trend == "constant" else F.col("_a") * F.col("_t") + F.col("_b")
    rest = placed.join(line, by).withColumn("_e", F.col("_x") - fitted)
    sums = rest.withColumn("_sum", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = sums.groupBy(*by).agg(F.sum(F.col("_sum") * F.col("_sum")).alias("_q"), F.sum(F.col("_e") * F.col("_e")).alias("_v"), F.count("*").alias("_n"))
    one, five, ten = KPSS_CRITICAL[trend]
    # rounding leaves a constant series residuals of about 1e-16
    s = s.withColumn("statistic", F.when(F.col("_v") > 1e-18, F.col("_q") / (F.col("_n") * F.col("_v"))).otherwise(0.0))
    p = F.when(F.col("statistic") > one, 0.01).when(F.col("statistic") > five, 0.05).when(F.col("statistic") > ten, 0.1).otherwise(0.15)
    return s.select(*by, "statistic", p.alias("p"), (F.col("statistic") < five).alias("is_stationary"))


def portmanteau(df: DataFrame, by: list[str], order: list[str], c: str, lags: int) -> DataFrame:
    """by, ljung_box, box_pierce, p and autocorrelated (p < 0.05), of the first `lags` autocorrelations together.

    box_pierce is n times the sum of squared autocorrelations; p is of ljung_box, by chi-square with `lags` degrees of freedom.
    Lags beyond the series count as 0.
    """
    kept, w = _series(df, by, order, c)
    means = kept.groupBy(*by).agg(F.avg("_x").alias("_m"))
    d = kept.join(means, by).withColumn("_e", F.col("_x") - F.col("_m"))
    pairs = d.withColumns({f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    s = pairs.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.col("_e") * F.col("_e")).alias("_v"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(1, lags + 1)])
    squares = {k: F.pow(_over(F.col(f"_p{k}"), F.col("_v")), F.lit(2.0)) for k in range(1, lags + 1)}
    lb = sum((F.when(F.col("_n") > k, squares[k] / (F.col("_n") - k)).otherwise(0.0) for k in squares), F.lit(0.0)) * F.col("_n") * (F.col("_n") + 2)
    bp = sum(squares.values(), F.lit(0.0)) * F.col("_n")
    out = s.select(*by, lb.alias("ljung_box"), bp.alias("box_pierce")).withColumn("p", P.p_chi2(F.col("ljung_box"), F.lit(float(lags))))
    return out.withColumn("autocorrelated", F.col("p") < 0.05)


def durbin_watson(df: DataFrame, by: list[str], order: list[str], c: str) -> DataFrame:
    """by and statistic: squared steps over squared deviations from the mean; 2 without spread. At least 3 values."""
    kept, w = _series(df, by, order, c)
    s = kept.withColumn("_d", F.col("_x") - F.lag("_x").over(w)).groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_q"), F.var_pop("_x").alias("_v"), F.count("*").alias("_n"))
    return s.where("_n >= 3").select(*by, _over(F.col("_q"), F.col("_v") * F.col("_n"), 2.0).alias("statistic"))


def jarque_bera(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """by, skewness, excess kurtosis, statistic and p (chi-square of 2 degrees of freedom): one aggregation."""
    spread = F.var_pop(c) > 0
    s = df.groupBy(*by).agg(F.count(c).alias("_n"), F.when(spread, F.skewness(c)).otherwise(0.0).alias("skewness"), F.when(spread, F.kurtosis(c)).otherwise(0.0).alias("kurtosis"))
    stat = F.col("_n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return s.where("_n > 0").select(*by, "skewness", "kurtosis", stat.alias("statistic")).withColumn("p", F.exp(-F.col("statistic") / 2))


def grubbs(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """by, statistic (the greatest |z|, by the population's deviation), critical and has_outlier.

    The greatest |z| is at an end, so minimum and maximum suffice. Below 3 values nothing is an outlier.
    """
    s = df.groupBy(*by).agg(F.count(c).alias("_n"), F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"), F.min(c).alias("_a"), F.max(c).alias("_b")).where("_n > 0")
    z = F.when(F.col("_n") < 3, 0.0).otherwise(_over(F.greatest(F.col("_b") - F.col("_m"), F.col("_m") - F.col("_a")), F.col("_s")))
    critical = F.when(F.col("_n") < 3, 0.0).when(F.col("_n") <= 10, 2.2).when(F.col("_n") <= 20, 2.5).when(F.col("_n") <= 50, 2.8).otherwise(3.0)
    return s.select(*by, z.alias("statistic"), critical.alias("critical")).withColumn("has_outlier", F.col("statistic") > F.col("critical"))


def modified_zscores(df: DataFrame, by: list[str], c: str, threshold: float = 3.5, out: str = "modified_z") -> DataFrame:
    """df's rows with a value, their 0.6745 * (x - median) / median deviation (0 without any) and is_outlier."""
    kept = df.where(F.col(c).isNotNull())
    middle = kept.groupBy(*by).agg(F.median(c).alias("_median"))
    apart = kept.join(middle, by)
    mad = apart.groupBy(*by).agg(F.median(F.abs(F.col(c) - F.col("_median"))).alias("_mad"))
    z = _over(0.6745 * (F.col(c) - F.col("_median")), F.col("_mad"))
    return apart.join(mad, by).select(*df.columns, z.alias(out), (F.abs(z) > threshold).alias("is_outlier"))


def variance_ratio(df: DataFrame, by: list[str], order: list[str], c: str) -> DataFrame:
    """by, variance_ratio of steps of two to twice that of single steps, and is_random_walk (between 0.8 and 1.2).

    Without spread, or below 10 values, the ratio is 1.
    """
    kept, w = _series(df, by, order, c)
    steps = kept.withColumns({"_d1": F.col("_x") - F.lag("_x").over(w), "_d2": F.col("_x") - F.lag("_x", 2).over(w)})
    s = steps.groupBy(*by).agg(F.var_pop("_d1").alias("_v1"), F.var_pop("_d2").alias("_v2"), F.count("*").alias("_n"))
    ratio = F.when(F.col("_n") >= LEAST, _over(F.col("_v2"), 2 * F.col("_v1"), 1.0)).otherwise(1.0)
    return s.select(*by, ratio.alias("variance_ratio")).withColumn("is_random_walk", (F.col("variance_ratio") > 0.8) & (F.col("variance_ratio") < 1.2))


def _parts(df: DataFrame) -> DataFrame:
    """df with _high and _low, which add up to _x: _high is a multiple of a power of two, so large that sums of _high are exact.

    _bound is at least the sum of |_x| over the rows to be summed. Out of the range of such powers _high is _x itself.
    """
    fits = (F.col("_bound") > 1e-270) & (F.col("_bound") < 1e300)
    unit = F.when(fits, F.pow(F.lit(2.0), F.ceil(F.log2("_bound")) - 51))
    high = F.coalesce(F.rint(F.col("_x") / F.col("_unit")) * F.col("_unit"), F.col("_x"))
    split = df.withColumn("_unit", unit).withColumn("_high", high)
    return split.withColumn("_low", F.when(F.col("_unit").isNull(), 0.0).otherwise(F.col("_x") - F.col("_high"))).drop("_unit")


def mean_shifts(df: DataFrame, by: list[str], order: list[str], c: str, prior_scale: float = 0.01) -> DataFrame:
    """by, order, score and is_change: at each row, how far the mean before it is from the mean from it on.

    A change is a score above ten times the prior's scale. The first two and last two rows of a series have score 0.
    Sums do not gather rounding errors along a series: they are taken of parts that add up exactly.
    """
    kept, w = _series(df, by, order, c)
    every, past = Window.partitionBy(*by), w.rowsBetween(Window.unboundedPreceding, -1)
    # the ordered window comes first, so that its sort serves them all
    placed = kept.withColumn("_i", F.row_number().over(w) - 1).withColumns({"_n": F.count("*").over(every), "_bound": F.max(F.abs("_x")).over(every) * F.count("*").over(every)})
    summed = _parts(placed).withColumns({"_all_high": F.sum("_high").over(every), "_all_low": F.sum("_low").over(every)})
    before = summed.withColumns({"_upto_high": F.sum("_high").over(past), "_upto_low": F.sum("_low").over(past)})
    i, n = F.col("_i"), F.col("_n")
    upto = F.col("_upto_high") + F.col("_upto_low")
    rest = (F.col("_all_high") - F.col("_upto_high")) + (F.col("_all_low") - F.col("_upto_low"))
    score = F.when((i >= 2) & (i < n - 2), F.abs(upto / i - rest / (n - i))).otherwise(0.0)
    return before.select(*by, *order, score.alias("score")).withColumn("is_change", F.col("score") > 10 * prior_scale)


def permutation_test(df: DataFrame, c: str, group: str, a: object, b: object, key: str, permutations: int = 200, seed: int = 0, alternative: str = "two-sided") -> DataFrame:
    """One row: difference of the means of groups a and b, permutations and p.

    Each permutation gives the labels of a to the rows that a hash of (key, permutation) puts first; key must be distinct.
    Rows are repeated once a permutation and ranked within it.
    """
    two = df.where(F.col(c).isNotNull() & F.col(group).isin(a, b)).select(F.col(key).alias("_k"), F.col(c).cast("double").alias("_x"), (F.col(group) == a).alias("_a"))
    size = two.agg(F.count_if("_a").alias("_na"), (F.avg(F.when(F.col("_a"), F.col("_x"))) - F.avg(F.when(~F.col("_a"), F.col("_x")))).alias("difference"))
    many = two.withColumn("_p", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    placed = many.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(F.xxhash64("_k", "_p", F.lit(seed)), "_k"))).crossJoin(F.broadcast(size.select("_na")))
    first = F.col("_i") <= F.col("_na")
    drawn = placed.groupBy("_p").agg((F.avg(F.when(first, F.col("_x"))) - F.avg(F.when(~first, F.col("_x")))).alias("_d"))
    d, t = F.col("_d"), F.col("difference")
    # sums of doubles in another order differ in the last digits
    beyond = {"two-sided": F.abs(d) >= F.abs(t) - 1e-12, "greater": d >= t - 1e-12, "less": d <= t + 1e-12}[alternative]
    hits = drawn.crossJoin(F.broadcast(size)).agg(F.first("difference").alias("difference"), F.count("*").alias("permutations"), F.count_if(beyond).alias("_hits"))
    return hits.select("difference", "permutations", F.try_divide(F.col("_hits"), F.col("permutations")).alias("p"))
