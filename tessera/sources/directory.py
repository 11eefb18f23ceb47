"""Read-only tables: one Parquet path a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.schema import TableDef, from_spark


class ParquetDirectory:
    """``<root>/<name>.parquet``, or ``<root>/<schema>/<name>.parquet``; Spark prunes columns and pushes filters into the scan."""

    def __init__(self, spark: SparkSession, root: str, suffix: str = ".parquet"):
        self.spark, self.root, self.suffix = spark, root.rstrip("/"), suffix

    def read(self, definition: TableDef) -> DataFrame:
        return self.spark.read.parquet(self._path(definition.name, definition.schema))

    def _path(self, name: str, schema: str | None) -> str:
        return "/".join((self.root, *([schema] if schema else []), name + self.suffix))

    def describe(self, name: str, schema: str | None = None) -> TableDef:
        """The description that the files' schema allows."""
        return from_spark(name, self.spark.read.parquet(self._path(name, schema)).schema, schema)
