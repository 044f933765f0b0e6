"""Windows over streams: the batch builders of operators.timeseries behind a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import timeseries as T


def read(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", **options: str) -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.format(form).schema(schema).options(**options).load(path)


def with_watermark(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as TIMESTAMP, rows later than delay dropped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, length: str, delay: str, by: list[str], **aggs: Column) -> DataFrame:
    return T.tumbling(with_watermark(df, ts, delay), ts, length, by, **aggs)


def sliding(df: DataFrame, ts: str, length: str, step: str, delay: str, by: list[str], **aggs: Column) -> DataFrame:
    return T.sliding(with_watermark(df, ts, delay), ts, length, step, by, **aggs)


def sessions(df: DataFrame, ts: str, gap: str, delay: str, by: list[str], **aggs: Column) -> DataFrame:
    return T.sessions(with_watermark(df, ts, delay), ts, gap, by, **aggs)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there into a table in memory and returns it: for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
