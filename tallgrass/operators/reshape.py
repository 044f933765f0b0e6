"""Reshaping: melt, pivot, unstack, explode, transpose. Pivot values are given, so that schemas are stable and no extra job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value", drop_null: bool = True) -> DataFrame:
    out = df.unpivot(ids, values, variable, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def pivot_table(df: DataFrame, index: list[str], column: str, agg: Column, values: list) -> DataFrame:
    return df.groupBy(*index).pivot(column, values).agg(agg)


def unstack(df: DataFrame, index: list[str], column: str, value: str, order: list[str], values: list) -> DataFrame:
    """One column a value; of several rows for a cell the last in the order wins."""
    cells = [F.max_by(F.when(F.col(column) == v, F.col(value)), F.when(F.col(column) == v, F.struct(*order))).alias(str(v)) for v in values]
    return df.groupBy(*index).agg(*cells)


def explode_split(df: DataFrame, column: str, separator: str, out: str) -> DataFrame:
    import re

    return df.withColumn(out, F.explode(F.split(column, re.escape(separator), -1)))


def transpose(df: DataFrame, key: str, columns: list[str], keys: list, prefix: str = "") -> DataFrame:
    """One row a column, one column a key. For frames as small as a report."""
    long = df.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["_k"], columns, "column_name", "_v")
    return long.groupBy("column_name").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"{prefix}{k}") for k in keys])
