"""Named tables and SQL over them: everything Spark SQL has, with checked schemas and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import files


class Context:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def register_csv(self, name: str, path: str, schema: str | None = None) -> None:
        self.register(name, files.read_csv(self.spark, path, schema, infer=schema is None))

    def register_parquet(self, name: str, path: str) -> None:
        self.register(name, files.read_parquet(self.spark, path))

    def sql(self, text: str, **values: object) -> DataFrame:
        """:name in the text stands for the value of that name."""
        return self.spark.sql(text, args=values or None)

    def create_function(self, name: str, parameters: str, returns: str, body: str) -> None:
        """A function written in SQL: Catalyst inlines it."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

    def validate(self, name: str, expected: dict[str, str]) -> None:
        """Raises ValueError unless the table has these columns of these types (others may follow)."""
        types = dict(self.spark.table(name).dtypes)
        wrong = {c: (t, types.get(c)) for c, t in expected.items() if types.get(c) != t}
        if wrong:
            raise ValueError(f"columns of {name} differ (expected, found): {wrong}")

    def explain(self, text: str, mode: str = "formatted") -> None:
        self.sql(text).explain(mode)
