"""A provider of streaming Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.schema import TableDef


class StreamDirectory:
    """Tables as streams over the Parquet files that arrive in ``<root>/<name>``, or ``<root>/<schema>/<name>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, definition: TableDef) -> DataFrame:
        return self.spark.readStream.schema(definition.struct()).parquet("/".join((self.root, *([definition.schema] if definition.schema else []), definition.name)))
