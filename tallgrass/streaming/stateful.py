"""Windows that Spark's own do not express, as keyed state: by count, and sessions of a greatest length.

State is a few numbers a key. Rows of a key are taken in the order of event time within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _key_schema(df: DataFrame, by: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in by)


def _ordered(frames: Iterator[pd.DataFrame], ts: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(ts, kind="stable")


def count_windows(df: DataFrame, by: list[str], ts: str, value: str, size: int) -> DataFrame:
    """by, w (from 0), n, sum, min, max: a row for each `size` values of a key, as soon as it is full. NULLs are not counted."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w, n, total, least, most = state.get if state.exists else (0, 0, 0.0, 0.0, 0.0)
        full = []
        for x in _ordered(frames, ts)[value].dropna().astype(float):
            least, most = (x, x) if n == 0 else (min(least, x), max(most, x))
            n, total = n + 1, total + x
            if n == size:
                full.append((*key, w, n, total, least, most))
                w, n, total = w + 1, 0, 0.0
        state.update((w, n, total, least, most))
        yield pd.DataFrame(full, columns=[*by, "w", "n", "sum", "min", "max"])

    out = _key_schema(df, by) + "w long, n long, sum double, min double, max double"
    return df.groupBy(*by).applyInPandasWithState(run, out, "w long, n long, sum double, least double, most double", "append", GroupStateTimeout.NoTimeout)


def sessions_limited(df: DataFrame, by: list[str], ts: str, value: str, gap_ms: int, longest_ms: int) -> DataFrame:
    """by, start, last (milliseconds), n, sum: sessions that end after a gap of more than gap_ms or at longest_ms.

    df has a watermark on ts. A session is written when a later row of its key begins another or the watermark passes its gap.
    """
    names = [*by, "start", "last", "n", "sum"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ended = [(*key, *state.get)]
            state.remove()
            yield pd.DataFrame(ended, columns=names)
            return
        now, ended = (state.get if state.exists else None), []
        rows = _ordered(frames, ts)
        times = rows[ts].astype("datetime64[us]").astype("int64") // 1000
        for t, x in zip(times, rows[value].fillna(0).astype(float), strict=True):
            if now is not None and (t - now[1] > gap_ms or t - now[0] > longest_ms):
                ended.append((*key, *now))
                now = None
            now = (t, t, 1, x) if now is None else (now[0], max(now[1], t), now[2] + 1, now[3] + x)
        state.update(tuple(v.item() if hasattr(v, "item") else v for v in now))
        state.setTimeoutTimestamp(max(int(now[1]) + gap_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(ended, columns=names)

    fields = "start long, last long, n long, sum double"
    return df.groupBy(*by).applyInPandasWithState(run, _key_schema(df, by) + fields, fields, "append", GroupStateTimeout.EventTimeTimeout)
