"""Aggregates: descriptive statistics, grouped aggregation, hierarchies."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .windows import cumulative_global

# --- of one column; each is an aggregate expression ---


def skew_adjusted(c: str) -> Column:
    """Sample skewness; NULL for fewer than 3 values or no spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_adjusted(c: str) -> Column:
    """Sample excess kurtosis; NULL for fewer than 4 values or no spread."""
    n = F.count(c)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def sem(c: str) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def coefficient_of_variation(c: str) -> Column:
    return F.stddev_samp(c) / F.avg(c)


def value_range(c: str) -> Column:
    return F.max(c) - F.min(c)


def geometric_mean(c: str) -> Column:
    """NULL if a value is not positive."""
    return F.when(F.min(c) > 0, F.exp(F.avg(F.when(F.col(c) > 0, F.ln(c)))))


def harmonic_mean(c: str) -> Column:
    """NULL if a value is not positive."""
    return F.when(F.min(c) > 0, F.count(c) / F.sum(F.when(F.col(c) != 0, 1 / F.col(c))))


def quantile_linear(c: str, q: float | list[float]) -> Column:
    return F.percentile(c, F.lit(q) if isinstance(q, float) else F.array(*[F.lit(x) for x in q]))


def sorted_values(c: str) -> Column:
    """The values in order, as an array. For groups of bounded size; see percentile_floor for whole tables."""
    return F.sort_array(F.collect_list(c))


def pick(values: Column, index: Column) -> Column:
    return F.element_at(values, index.cast("int") + 1)


def percentile_floor(df: DataFrame, c: str, qs: list[float]) -> DataFrame:
    """One row: the value at rank floor((n - 1) * q) in ascending order, for each q, as columns p0, p1, ...

    Spark's percentile at exactly that rank needs no interpolation, and merges counts of values, not rows.
    """
    n = F.count(c)
    wanted = []
    for k, q in enumerate(qs):
        wanted.append((F.floor((n - 1) * F.lit(q)) / F.greatest(n - 1, F.lit(1))).alias(f"q{k}"))
    ranks = df.agg(*wanted).first()
    return df.agg(*[F.percentile(c, F.lit(float(ranks[k] or 0.0))).alias(f"p{k}") for k in range(len(qs))])


def mean_absolute_deviation(df: DataFrame, c: str, out: str = "mad") -> DataFrame:
    """Mean of |x - mean|: the mean is one row, broadcast."""
    mean = df.agg(F.avg(c).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col(c) - F.col("_mean"))).alias(out))


def trimmed_mean(df: DataFrame, c: str, part: float, out: str = "trimmed_mean") -> DataFrame:
    """Mean without the floor(n * part) least and greatest values.

    Distinct values with their counts are ranked by a running sum, so equal values at a cut count as often as they are kept.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("k"))
    placed = cumulative_global(counts, "k", c, "upto").crossJoin(F.broadcast(counts.agg(F.sum("k").alias("n"))))
    cut = F.floor(F.col("n") * part)
    kept = F.greatest(F.lit(0), F.least("upto", F.col("n") - cut) - F.greatest(F.col("upto") - F.col("k"), cut))
    return placed.agg((F.sum(F.col(c) * kept) / F.sum(kept)).alias(out))


def mode_all(df: DataFrame, c: str) -> DataFrame:
    """All most frequent values with their count."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("n"))), "n").select(c, "n")


def value_counts(df: DataFrame, c: str, normalize: bool = False) -> DataFrame:
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())) if normalize else counts


def value_count_bins(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Counts of equal-width bins from the least to the greatest value; bounds are one row."""
    bounds = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    at = F.least(F.floor((F.col(c) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def describe_long(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column_name, count, mean, std, min, q1, median, q3, max: one pass over the table, one row a column."""
    parts = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(F.col(c).cast("double")).alias("max")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def corr_long(df: DataFrame, columns: list[str], covariance: bool = False) -> DataFrame:
    """a, b and the correlation (or covariance) of each pair, in one pass."""
    f = F.covar_samp if covariance else F.corr
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), f(F.col(a).cast("double"), F.col(b).cast("double")).alias("value")) for a in columns for b in columns]
    return df.agg(F.array(*pairs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def idxmax(df: DataFrame, c: str, label: str) -> Column:
    """The least label of the greatest value."""
    return F.max_by(F.struct(label), F.struct(F.col(c), -F.col(label)))[label]


# --- by group ---


def std_zero_single(c: str) -> Column:
    """Sample standard deviation, 0 for a group of one."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def var_zero_single(c: str) -> Column:
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.var_samp(c))


def first_by(c: str, order: list[str]) -> Column:
    return F.min_by(c, F.struct(*order))


def last_by(c: str, order: list[str]) -> Column:
    return F.max_by(c, F.struct(*order))


def group_filter(df: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """Rows of the groups for which an aggregate condition holds; groups are pre-aggregated and joined back."""
    good = df.groupBy(*by).agg(condition.alias("_keep")).where("_keep").drop("_keep")
    return df.join(good, by, "left_semi")


def cumcount(by: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def crosstab(df: DataFrame, row: str, column: str, values: list, normalize: str | None = None) -> DataFrame:
    """Counts of each pair of values; the column values are given, so that no extra job finds them."""
    counts = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    if normalize == "index":
        total = sum((F.col(f"`{v}`") for v in map(str, values)), F.lit(0))
        return counts.select(row, *[(F.col(f"`{v}`") / total).alias(str(v)) for v in values])
    return counts


def cross_level(df: DataFrame, levels: list[str], source: int, target: int, **aggs: Column) -> DataFrame:
    """Aggregates over the raw rows of each target node (levels count from 0); with the source nearer the root, of the source
    node that each target node lies in, once for each target node."""
    keys, wide = levels[: target + 1], levels[: source + 1]
    if source >= target:
        return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    pooled = df.groupBy(*wide).agg(*[v.alias(k) for k, v in aggs.items()])
    nodes = df.select(*keys).distinct()
    same = [nodes[k].eqNullSafe(pooled[k]) for k in wide]
    return nodes.join(pooled, same).select(*[nodes[k] for k in keys], *aggs)


def nested_transform(df: DataFrame, levels: list[str], level: int, f: Callable[[WindowSpec], Column], out: str) -> DataFrame:
    """df with a column that f gives from the window of each node of a level."""
    return df.withColumn(out, f(Window.partitionBy(*levels[: level + 1])))


def hierarchical_filter(df: DataFrame, levels: list[str], level: int, condition: Column) -> DataFrame:
    """The rows of the nodes of a level for which an aggregate condition holds; NULL keys are nodes too."""
    keys = levels[: level + 1]
    good = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(condition.alias("_keep")).where("_keep")
    return df.join(good, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")


def cross_level_comparison(df: DataFrame, levels: list[str], c: str, base: int, compare: list[int]) -> DataFrame:
    """The sum of c of each node of the base level, and of the nodes of the compared levels (nearer the root) it lies in."""
    keys = levels[: base + 1]
    sums = df.groupBy(*keys).agg(F.sum(c).alias(f"{c}_base_level_{base}"))
    out = sums
    for k in compare:
        # the sums of nodes above come from the sums of nodes, not from the rows again
        out = out.withColumn(f"{c}_level_{k}", F.sum(f"{c}_base_level_{base}").over(Window.partitionBy(*levels[: min(k, base) + 1])))
    return out


def rollup_levels(df: DataFrame, levels: list[str], **aggs: Column) -> DataFrame:
    """Aggregates of every level of a hierarchy, without the grand total; rollup_level counts from 0."""
    out = df.rollup(*levels).agg(F.grouping_id().alias("_g"), *[v.alias(k) for k, v in aggs.items()])
    depth = F.lit(len(levels)) - F.bit_count(F.col("_g"))
    return out.withColumn("rollup_level", (depth - 1).cast("int")).where("rollup_level >= 0").drop("_g")


def share_of_parent(df: DataFrame, parent: list[str], child: list[str], c: str, out: str = "share") -> DataFrame:
    """Sum of c of each child group as a part of its parent group's sum."""
    sums = df.groupBy(*parent, *child).agg(F.sum(c).alias("total"))
    return sums.withColumn(out, F.col("total") / F.sum("total").over(Window.partitionBy(*parent)))
