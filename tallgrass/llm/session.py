"""What the operators ask of the session: bounded batches, checkpoints, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a session: whether a query's shuffle files are deleted as soon as it ends. Where Spark knows no such setting they wait for the driver's garbage collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows above which a side is joined by shuffle and not broadcast (rows of two longs, about 70 bytes in a hash table: 35 MB).
BROADCAST_ROWS = 500_000


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named, a temporary one, but only if all runs in this one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


class Written:
    """df as a compressed columnar table in the shared folder; `df` reads it, drop() deletes it.

    For large tables within an operator: a checkpoint of the same rows takes several times the room. The shuffle files
    it was made from are deleted with the write.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{_shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        chosen = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, chosen)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir, so that no lost executor loses it.

    The folder is only set here if the session names none, as in tests.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows; beyond the limit Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def dealt(df: DataFrame, keys: list[str], part: int, by: Column, counts: DataFrame | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """For a join of df on keys with a table of one row a key: df with a column `salt`, and what copies the table's rows to match.

    A key of more than `part` rows in df is dealt into parts by the long `by`, so that no task gets all of its rows; join on
    keys and salt. Such keys are at most a part-th of df's rows, and are broadcast only if they are few. counts: keys and
    count of df's rows, if they are known.
    """
    counts = df.groupBy(*keys).count() if counts is None else counts
    hot = checkpoint(counts.where(F.col("count") > part).select(*keys, F.ceil(F.col("count") / part).cast("int").alias("salts")))
    n = hot.count()
    if n == 0:
        return df.withColumn("salt", F.lit(0)), lambda table: table.withColumn("salt", F.lit(0))
    names = [f"hot_{i}" for i in range(len(keys))]
    hot = hot.withColumnsRenamed(dict(zip(keys, names, strict=True)))

    def with_salts(x: DataFrame) -> DataFrame:
        same = [x[k].eqNullSafe(hot[h]) for k, h in zip(keys, names, strict=True)]
        return x.join(sized(hot, n), same, "left").drop(*names)

    salted = with_salts(df).withColumn("salt", F.coalesce(F.pmod(by, F.col("salts")).cast("int"), F.lit(0))).drop("salts")

    def copied(table: DataFrame) -> DataFrame:
        return with_salts(table).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    return salted, copied


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes as well as by rows, unless the user chose a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(str(spark.conf.get(key)).rstrip("bB")) > 64 << 20:
            spark.conf.set(key, str(16 << 20))
    except Exception as e:  # the setting came with Spark 4
        if "SQL_CONF_NOT_FOUND" not in str(e) and not isinstance(e, ValueError):
            raise
