"""Time series and the batch form of stream windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import slice_of


def _aggs(aggs: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in aggs.items()]


def resample_anchored(df: DataFrame, ts: str, seconds: int, by: list[str] | None = None, **aggs: Column) -> DataFrame:
    """Buckets of fixed length from the first time on; bucket counts from 0. The first time is one row."""
    first = df.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("_t0"))
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.col("_t0")) / (seconds * 1_000_000)).cast("long")
    return df.crossJoin(F.broadcast(first)).groupBy(*(by or []), at.alias("bucket")).agg(*_aggs(aggs))


def resample_calendar(df: DataFrame, ts: str, unit: str, by: list[str] | None = None, **aggs: Column) -> DataFrame:
    return df.groupBy(*(by or []), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("period")).agg(*_aggs(aggs))


def tumbling(df: DataFrame, ts: str, length: str, by: list[str], **aggs: Column) -> DataFrame:
    """Also for streams: set a watermark on df before."""
    return df.groupBy(F.window(ts, length).alias("_w"), *by).agg(*_aggs(aggs)).select(F.col("_w.start").alias("start"), *by, *aggs)


def sliding(df: DataFrame, ts: str, length: str, step: str, by: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(F.window(ts, length, step).alias("_w"), *by).agg(*_aggs(aggs)).select(F.col("_w.start").alias("start"), *by, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], **aggs: Column) -> DataFrame:
    """An event exactly `gap` after the last one belongs to its session."""
    return df.groupBy(F.session_window(ts, gap).alias("_w"), *by).agg(*_aggs(aggs)).select(F.col("_w.start").alias("start"), *by, *aggs)


def count_windows(df: DataFrame, by: list[str], order: list[str], size: int, **aggs: Column) -> DataFrame:
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long")
    return df.withColumn("w", at).groupBy(*by, "w").agg(*_aggs(aggs))


def numbered(df: DataFrame, order: str, out: str = "_i", slices: int | None = None) -> DataFrame:
    """Rows numbered from 1 in the order of one column of distinct values, by range slices and offsets."""
    slices = slices or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(k / slices) for k in range(1, slices)]), 20 * slices).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_s", slice_of(order, "_cuts", slices)).drop("_cuts")
    counts = placed.groupBy("_s").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_s").alias("_o"), offset.alias("_offset"))
    inner = F.row_number().over(Window.partitionBy("_s").orderBy(order))
    return placed.withColumn(out, inner).join(F.broadcast(offsets), F.col("_s") == F.col("_o")).withColumn(out, F.col(out) + F.col("_offset")).drop("_s", "_o", "_offset")


def acf(df: DataFrame, c: str, order: list[str], lags: list[int]) -> DataFrame:
    """Autocorrelation at the given lags: rows are numbered in a distributed way and paired by an equality join."""
    t = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith("timestamp") else F.col(order[0])
    n = numbered(df.select(t.alias("_t"), F.col(c).cast("double").alias("_v")), "_t")
    mean = df.agg(F.avg(c).alias("_m"))
    d = n.crossJoin(F.broadcast(mean)).select("_i", (F.col("_v") - F.col("_m")).alias("d"))
    total = d.agg(F.sum(F.col("d") * F.col("d")).alias("_total"))
    moved = d.select(F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "_i", "d").select("lag", (F.col("_i") + F.col("lag")).alias("_i"), F.col("d").alias("e"))
    pairs = moved.join(d, "_i").groupBy("lag").agg(F.sum(F.col("d") * F.col("e")).alias("_c"))
    return pairs.crossJoin(F.broadcast(total)).select("lag", (F.col("_c") / F.col("_total")).alias("acf"))


def decompose_additive(df: DataFrame, c: str, by: list[str], order: list[str], period: int) -> DataFrame:
    """Adds trend (centred moving mean of period // 2 rows to each side, shorter at the ends), seasonal and residual."""
    w = Window.partitionBy(*by).orderBy(*order)
    half = period // 2
    df = df.withColumn("trend", F.avg(c).over(w.rowsBetween(-half, half))).withColumn("_phase", (F.row_number().over(w) - 1) % period)
    # the mean of a phase and the mean of those means are windows over the partitioning that is there already
    df = df.withColumn("_mean", F.avg(F.col(c) - F.col("trend")).over(Window.partitionBy(*by, "_phase")))
    one = F.row_number().over(Window.partitionBy(*by, "_phase").orderBy(*order)) == 1
    df = df.withColumn("_one", F.when(one, F.col("_mean")))
    df = df.withColumn("seasonal", F.col("_mean") - F.avg("_one").over(Window.partitionBy(*by))).drop("_phase", "_mean", "_one")
    return df.withColumn("residual", F.col(c) - F.col("trend") - F.col("seasonal"))


def sessions_limited(df: DataFrame, ts: str, by: list[str], gap_seconds: float, longest_seconds: float) -> DataFrame:
    """by, start, last, n: a session ends after a gap of more than gap_seconds, or before a row later than longest_seconds.

    Gaps always end a session, so a window cuts at them; only inside such a stretch does a beginning depend on the one
    before, and its times are folded in order as one array of micros: a stretch without gaps must fit a task.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    gap, longest = int(gap_seconds * 1e6), int(longest_seconds * 1e6)
    w = Window.partitionBy(*by).orderBy("_m")
    cut = df.where(F.col(ts).isNotNull()).select(*by, t.alias("_m")).withColumn("_cut", F.coalesce((F.col("_m") - F.lag("_m").over(w) > gap).cast("int"), F.lit(0)))
    times = cut.withColumn("_g", F.sum("_cut").over(w)).groupBy(*by, "_g").agg(F.sort_array(F.collect_list("_m")).alias("_t"))
    new = lambda x, n: F.named_struct(F.lit("start"), x, F.lit("last"), x, F.lit("n"), n)
    begin = F.named_struct(F.lit("done"), F.expr("CAST(array() AS array<struct<start: bigint, last: bigint, n: bigint>>)"), F.lit("now"), new(F.col("_t")[0], F.lit(0).cast("bigint")))

    def step(s: Column, x: Column) -> Column:
        now = s["now"]
        ends = x - now["start"] > longest
        one = F.lit(1).cast("bigint")
        grown = F.named_struct(F.lit("start"), now["start"], F.lit("last"), x, F.lit("n"), now["n"] + one)
        return F.when(ends, F.named_struct(F.lit("done"), F.array_append(s["done"], now), F.lit("now"), new(x, one))).otherwise(F.named_struct(F.lit("done"), s["done"], F.lit("now"), grown))

    every = F.aggregate("_t", begin, step, lambda s: F.array_append(s["done"], s["now"]))
    return times.select(*by, F.explode(every).alias("_s")).select(*by, F.timestamp_micros("_s.start").alias("start"), F.timestamp_micros("_s.last").alias("last"), F.col("_s.n").alias("n"))


def percentile_nearest(c: str, q: float) -> Column:
    """sorted[round(q * (n - 1))], halves away from zero: an aggregate for windows of bounded size."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.round(q * (F.count(c) - 1)).cast("int"))


def cusum(df: DataFrame, c: str, by: list[str], order: list[str], out: str = "cusum") -> DataFrame:
    """Running sum of the distances from the group's mean."""
    mean = F.avg(c).over(Window.partitionBy(*by))
    df = df.withColumn("_d", F.col(c) - mean)
    return df.withColumn(out, F.sum("_d").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_d")
