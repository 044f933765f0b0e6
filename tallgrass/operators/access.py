"""Rows by position, first and last valid values, comparisons of whole frames and descriptions of them.

Positions count from 0 in an order of distinct values that the caller names; they are numbered by range slices,
never by a window in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import numbered


def with_position(df: DataFrame, order: str, out: str = "position") -> DataFrame:
    return numbered(df, order, out).withColumn(out, (F.col(out) - 1).cast("long"))


def take(df: DataFrame, order: str, positions: list[int]) -> DataFrame:
    """Rows at the positions, in their order, with the column `position`; a position beyond the end has no row."""
    return with_position(df, order).where(F.col("position").isin(positions))


def nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n-th row; a negative n counts from the end."""
    key = F.col(order)
    rows = df.where(key.isNotNull()).orderBy(key if n >= 0 else key.desc())
    return rows.offset(n if n >= 0 else -n - 1).limit(1)


def drop_rows(df: DataFrame, order: str, positions: list[int]) -> DataFrame:
    return with_position(df, order).where(~F.col("position").isin(positions)).drop("position")


def valid_ends(df: DataFrame, c: str, order: str) -> DataFrame:
    """One row: first_at, first_value, last_at, last_value of the values that are not missing."""
    known = F.when(F.col(c).isNotNull(), F.col(order))
    return df.agg(F.min(known).alias("first_at"), F.min_by(c, known).alias("first_value"), F.max(known).alias("last_at"), F.max_by(c, known).alias("last_value"))


def is_finite(c: Column) -> Column:
    """False for NULL, NaN and the infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def replace_inf(c: Column, value: float | None) -> Column:
    return F.when(F.abs(c) == float("inf"), F.lit(value)).otherwise(c)


def equals(left: DataFrame, right: DataFrame) -> bool:
    """Same columns in the same order, and the same rows as bags: NULL is NULL, NaN is NaN."""
    if left.dtypes != right.dtypes:
        return False
    count = lambda df, sign: df.groupBy(*df.columns).agg(F.count("*").alias("_n")).select("*", F.lit(sign).alias("_sign"))
    both = count(left, 1).union(count(right, -1)).groupBy(*left.columns).agg(F.sum(F.col("_n") * F.col("_sign")).alias("_left"))
    return both.where("_left != 0").isEmpty()


def info(df: DataFrame) -> DataFrame:
    """column, type, present and missing: one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(df.columns)], F.count("*").alias("_all"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_{i}").alias("present"), (F.col("_all") - F.col(f"_{i}")).alias("missing")) for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def schema_changes(old: DataFrame, new: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, column, old type, new type) of columns added, removed or retyped, in the order of columns."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    gone = [("removed", c, t, None) for c, t in a.items() if c not in b]
    return gone + [("added", c, None, t) if c not in a else ("retyped", c, a[c], t) for c, t in b.items() if a.get(c) != t]
