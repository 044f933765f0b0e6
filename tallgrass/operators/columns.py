"""Projection, column DDL, arithmetic, predicates and value replacement. Every function returns a new DataFrame.

Numbers are DOUBLE, missing values NULL (NaN on input becomes NULL through `clean`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def clean(c: str | Column) -> Column:
    """A double with NaN as NULL."""
    c = number(c)
    return F.when(~F.isnan(c), c)


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def string_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def select_dtypes(df: DataFrame, include: Iterable[str]) -> DataFrame:
    kinds = set(include)
    wanted = [n for n, t in df.dtypes if t in kinds or "number" in kinds and t in NUMERIC]
    return df.select(*wanted)


# --- columns as a whole ---


def assign(df: DataFrame, **exprs: Column | Callable[[DataFrame], Column]) -> DataFrame:
    return df.withColumns({k: v(df) if callable(v) and not isinstance(v, Column) else v for k, v in exprs.items()})


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.toDF(*[c + suffix for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def reverse_columns(df: DataFrame) -> DataFrame:
    return df.select(*df.columns[::-1])


def sort_columns(df: DataFrame, ascending: bool = True) -> DataFrame:
    return df.select(*sorted(df.columns, reverse=not ascending))


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(*[b if c == a else a if c == b else c for c in df.columns])


def reindex_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns that are missing become NULL doubles."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def insert_column(df: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    return df.select(*df.columns[:at], value.alias(name), *df.columns[at:])


def pop_column(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(name), df.select(name)


def astype(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """int floors and stays DOUBLE; what can't be read as the type becomes NULL."""
    c = F.col(column)
    target = {"int": F.floor(c.try_cast("double")).cast("double"), "float": c.try_cast("double"), "str": c.cast("string"), "bool": c.try_cast("boolean")}
    return df.withColumn(column, target.get(dtype, c.try_cast(dtype)))


# --- arithmetic ---


def div(a: Column, b: Column | float) -> Column:
    """a / b with IEEE results for a zero divisor."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, F.when(a.isNotNull(), by_zero)).otherwise(a / b)


def floordiv(a: Column, d: float) -> Column:
    return F.floor(a / F.lit(float(d))).cast("double")


def trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def fract(c: Column) -> Column:
    return c - trunc(c)


def sign(c: Column) -> Column:
    return F.signum(c).cast("int")


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """NULL stays NULL."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def zscore(c: str, *by: str) -> Column:
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    return (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)


def minmax(c: str, *by: str) -> Column:
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    return (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))


# --- predicates and values ---


def between(c: Column, lo: float, hi: float, inclusive: str = "both") -> Column:
    left = c >= lo if inclusive in ("both", "left") else c > lo
    right = c <= hi if inclusive in ("both", "right") else c < hi
    return left & right


def where_mask(c: Column, condition: Column, other: float | None = None) -> Column:
    """c where the condition holds, else other (NULL by default)."""
    return F.when(condition, c).otherwise(F.lit(other))


def mask(c: Column, condition: Column, other: float | None = None) -> Column:
    return F.when(condition, F.lit(other)).otherwise(c)


def replace_values(c: Column, mapping: Mapping) -> Column:
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return c if out is None else out.otherwise(c)


def map_values(c: Column, mapping: Mapping, default: object = None) -> Column:
    """The mapped value, or default for what is not mapped."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def isna_counts(df: DataFrame) -> DataFrame:
    """One row (column_name, n_null, n_total) for each column."""
    parts = []
    for c, t in df.dtypes:
        null = F.col(c).isNull() | F.isnan(c) if t in ("float", "double") else F.col(c).isNull()
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count_if(null).alias("n_null"), F.count("*").alias("n_total")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def fillna(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def dropna(df: DataFrame, subset: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=subset)


def first_appearance_codes(df: DataFrame, column: str, order: list[str], code: str = "code") -> DataFrame:
    """Codes of a column's values by first appearance in the given order, counted from 0.

    First places are pre-aggregated; only distinct values are ranked, and joined back.
    """
    from pyspark.sql.window import Window

    seen = df.groupBy(column).agg(F.min(F.struct(*order)).alias("first"))
    codes = seen.select(F.col(column).alias("_value"), (F.row_number().over(Window.orderBy("first")) - 1).cast("double").alias(code))
    return df.join(codes, df[column].eqNullSafe(codes["_value"]), "left").drop("_value")


def dummies(df: DataFrame, column: str, values: Iterable[str], prefix: str | None = None) -> DataFrame:
    prefix = column if prefix is None else prefix
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values])


def cut(c: Column, edges: list[float], labels: list[str], right: bool = True, include_lowest: bool = False) -> Column:
    """Label of the interval of c; NULL outside all. Intervals are (a, b], or [a, b) if not right."""
    out = None
    for k, label in enumerate(labels):
        lo, hi = edges[k], edges[k + 1]
        inside = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        if include_lowest and right and k == 0:
            inside = (c >= lo) & (c <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return F.lit(None).cast("string") if out is None else out


def qcut(df: DataFrame, column: str, q: int, out: str = "bin") -> DataFrame:
    """Bin 0 to q - 1 by linear quantiles, closed on the right; the least value is in bin 0. The edges are one row."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(k / q) for k in range(1, q)])).alias("_edges"))
    above = F.size(F.filter("_edges", lambda e: F.col(column) > e))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(column).isNotNull(), above)).drop("_edges")
