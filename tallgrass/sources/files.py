"""Readers and writers of files and databases. Schemas can be given; CSV is inferred only on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True, infer: bool = False, sep: str = ",", **options: str) -> DataFrame:
    reader = spark.read.options(header=header, sep=sep, inferSchema=infer, **options)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).options(header=header, sep=sep).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str = "zstd", mode: str = "error") -> None:
    df.write.mode(mode).option("compression", compression).partitionBy(*(partition_by or [])).parquet(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def write_orc(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).orc(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_sql(spark: SparkSession, url: str, query: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A query of a JDBC database, in parallel ranges of a column if one is given. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column is None:
        return reader.option("query", query).load()
    return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts).load()


def write_sql(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column of each row group of the files at a path: file, row_group, rows, column, type, codec, compressed, uncompressed, nulls, low and high (as text; NULL without statistics).

    Footers alone are read, by Hadoop's file systems, on the driver and one file after another: for looking at some files, not for
    a table of millions.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name in sorted(spark.read.parquet(path).inputFiles()):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            for i, group in enumerate(reader.getFooter().getBlocks()):
                for c in group.getColumns():
                    stats = c.getStatistics()
                    known = stats is not None and stats.hasNonNullValue()
                    nulls = stats.getNumNulls() if stats is not None and stats.isNumNullsSet() else None
                    rows.append((name, i, group.getRowCount(), c.getPath().toDotString(), c.getPrimitiveType().getPrimitiveTypeName().name(), c.getCodec().name(), c.getTotalSize(), c.getTotalUncompressedSize(), nulls, stats.minAsString() if known else None, stats.maxAsString() if known else None))
        finally:
            reader.close()
    return spark.createDataFrame(rows, "file string, row_group int, rows long, `column` string, type string, codec string, compressed long, uncompressed long, nulls long, low string, high string")


def read_parquet_evolved(spark: SparkSession, *paths: str) -> DataFrame:
    """Files whose schemas grew: columns by name, those a file lacks NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)
