"""User functions: on values, rows, windows and groups, by pandas in Arrow batches. Result types are declared, never guessed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def apply_values(c: str, f: Callable[[pd.Series], pd.Series], kind: str) -> Column:
    """f on a column, a batch of values at a time: of each value it must depend on that value alone."""

    def run(values: pd.Series) -> pd.Series:
        return f(values)

    return F.pandas_udf(run, kind)(c)


def apply_map(df: DataFrame, columns: list[str], f: Callable[[pd.Series], pd.Series], kind: str) -> DataFrame:
    """The columns replaced by f of them, the others as they are."""
    return df.withColumns({c: apply_values(c, f, kind) for c in columns})


def apply_rows(df: DataFrame, f: Callable[[pd.Series], object], out: str, kind: str) -> DataFrame:
    """df with a column that f gives from each row; prefer apply_values, which takes batches."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out}` {kind}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [f(row) for _, row in batch.iterrows()]})

    return df.mapInPandas(run, schema)


def aggregate_custom(df: DataFrame, by: list[str], kind: str = "double", **aggs: tuple[str, Callable[[pd.Series], object]]) -> DataFrame:
    """by, and for each name the function's result over a column of the group. A group's values of that column meet in a task."""

    def made(f: Callable[[pd.Series], object]) -> Callable:
        def run(values: pd.Series) -> object:
            return f(values)

        run.__annotations__ = {"values": pd.Series, "return": float if kind == "double" else object}
        return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG) if kind != "double" else F.pandas_udf(run, kind)

    return df.groupBy(*by).agg(*[made(f)(c).alias(name) for name, (c, f) in aggs.items()])


def apply_groups(df: DataFrame, by: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of each group's rows, one behind another; a group must fit a task. For transforms and filters by any rule."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return f(group)

    return df.groupBy(*by).applyInPandas(run, schema)


def _over(c: str, f: Callable[[list[float]], float | None], window: Window, min_periods: int) -> Column:
    """f of each frame's values without NULL, in order; NULL with fewer than min_periods."""

    def run(frames: pd.Series) -> pd.Series:
        return pd.Series([None if len(x) < min_periods else f(x) for x in frames], dtype="Float64")

    run.__annotations__ = {"frames": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(F.collect_list(F.col(c).cast("double")).over(window))


def rolling_apply(c: str, f: Callable[[list[float]], float | None], window: int, by: list[str], order: list[str], min_periods: int | None = None) -> Column:
    """f of the values of the last `window` rows of each group."""
    return _over(c, f, Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0), window if min_periods is None else min_periods)


def expanding_apply(c: str, f: Callable[[list[float]], float | None], by: list[str], order: list[str], min_periods: int = 1) -> Column:
    """f of all values so far: each row carries its group's rows before it, so groups must be short."""
    return _over(c, f, Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), min_periods)
