"""Row labels of one or more levels (plain columns), alignment by label, categories, periods and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- labels of several levels ---


def xs(df: DataFrame, level: str, key: object, drop: bool = True) -> DataFrame:
    """Rows with the key at a level."""
    got = df.where(F.col(level) == F.lit(key))
    return got.drop(level) if drop else got


def get_tuple(df: DataFrame, levels: list[str], key: tuple) -> DataFrame:
    condition = F.lit(True)
    for c, k in zip(levels, key, strict=True):
        condition = condition & F.col(c).eqNullSafe(F.lit(k))
    return df.where(condition)


def swap_levels(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(*[b if c == a else a if c == b else c for c in df.columns])


def level_values(df: DataFrame, level: str) -> DataFrame:
    return df.select(level).distinct()


def align(left: DataFrame, right: DataFrame, label: str, how: str = "outer") -> tuple[DataFrame, DataFrame]:
    """Both frames over the labels of how: outer, inner, left, right. Labels that a frame lacks have NULL columns."""
    a, b = left.select(label), right.select(label)
    wanted = {"outer": lambda: a.union(b).distinct(), "inner": lambda: a.intersect(b), "left": lambda: a.distinct(), "right": lambda: b.distinct()}[how]()
    return wanted.join(left, label, "left"), wanted.join(right, label, "left")


def reindex(df: DataFrame, label: str, wanted: DataFrame) -> DataFrame:
    """A row for each row of wanted (one column, the labels), NULL where df has no such label."""
    return wanted.select(F.col(wanted.columns[0]).alias(label)).join(df, label, "left")


def set_value(df: DataFrame, label: str, key: object, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.when(F.col(label) == F.lit(key), F.lit(value)).otherwise(F.col(column)))


# --- categories: a column keeps its strings; the list of categories gives the order ---


def to_category(c: Column, categories: list[str]) -> Column:
    """The string if it is a category, else NULL."""
    return F.when(c.isin(categories), c)


def category_code(c: Column, categories: list[str]) -> Column:
    """Position in the list from 0, -1 for others: order by it for ordered categories."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in categories]), c) - 1, F.lit(-1)).cast("int")


def category_counts(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """column, n: every category, those without rows with 0, by one aggregation."""
    got = df.agg(*[F.count_if(F.col(column) == x).alias(f"_{i}") for i, x in enumerate(categories)])
    rows = F.array(*[F.struct(F.lit(x).alias(column), F.col(f"_{i}").alias("n")) for i, x in enumerate(categories)])
    return got.select(F.explode(rows).alias("x")).select("x.*")


# --- periods and intervals ---


def period(c: Column, unit: str) -> tuple[Column, Column]:
    """First and last day of the day's week, month, quarter or year."""
    start = F.trunc(c, unit).cast("date")
    step = {"week": F.make_interval(weeks=F.lit(1)), "month": F.make_interval(months=F.lit(1)), "quarter": F.make_interval(months=F.lit(3)), "year": F.make_interval(years=F.lit(1))}[unit]
    return start, F.date_sub((start + step).cast("date"), 1)


def interval_index(c: Column, breaks: list[float], closed: str = "right") -> Column:
    """Number from 0 of the interval between ascending breaks that holds the value, NULL outside.

    closed: left, right, neither, or both (a shared break belongs to the lower interval).
    """
    out = None
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:], strict=False)):
        above = c >= lo if closed in ("left", "both") else c > lo
        below = c <= hi if closed in ("right", "both") else c < hi
        out = F.when(above & below, F.lit(i)) if out is None else out.when(above & below, F.lit(i))
    return F.lit(None).cast("int") if out is None else out
