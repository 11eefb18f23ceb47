"""What tables there are and how they look, from the store or from Spark's catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..errors import AmbiguousTableError, CapabilityError, IncompleteTableError, InspectionError, TableNotFoundError, ValidationError
from ..plans.schema import TableDef, from_spark
from .store import Store

HISTORY = "schema_migrations"


class StoreInspector:
    """The store's tables, all from one version of the manifest."""

    def __init__(self, store: Store):
        self.tables = {d.key: d for d in store.definitions()}

    def table(self, name: str, schema: str | None = None) -> TableDef:
        if schema is not None:
            found = [d for d in self.tables.values() if (d.name, d.schema) == (name, schema)]
        else:
            found = [d for d in self.tables.values() if d.name == name]
        if not found:
            raise TableNotFoundError(f"there is no table {schema + '.' if schema else ''}{name}")
        if len(found) > 1:
            raise AmbiguousTableError(f"{name} stands in {', '.join(sorted(str(d.schema) for d in found))}")
        return found[0]

    def table_names(self, schema: str | None = None) -> list[str]:
        return sorted(d.name if schema else d.key for d in self.tables.values() if schema is None or d.schema == schema)


class SparkInspector:
    """Spark's catalog: base tables, no views; constraints are unknown to it."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    def table_names(self, schema: str | None = None) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(schema or self.database) if not t.isTemporary and t.tableType != "VIEW")

    def table(self, name: str, schema: str | None = None) -> TableDef:
        if name not in self.table_names(schema):
            raise TableNotFoundError(f"there is no table {name} in {schema or self.database}")
        try:
            return from_spark(name, self.spark.table(f"`{schema or self.database}`.`{name}`").schema, schema)
        except CapabilityError as e:
            raise IncompleteTableError(f"{name}: {e}") from e


def sweep(inspector: StoreInspector | SparkInspector, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> list[TableDef]:
    """All tables, or the included ones, or all but the excluded ones, sorted; the migration history stays out."""
    if include is not None and exclude is not None:
        raise ValidationError("catalog", "include and exclude contradict each other")
    names = [n for n in inspector.table_names() if n != HISTORY]
    for wanted in (include, exclude):
        if missing := sorted(set(wanted or ()) - set(names)):
            raise TableNotFoundError(f"there is no table {', '.join(missing)}")
    if include is not None:
        names = [n for n in names if n in set(include)]
    if exclude is not None:
        names = [n for n in names if n not in set(exclude)]
    if not names:
        raise InspectionError("no table is left")
    return [inspector.tables[n] if isinstance(inspector, StoreInspector) else inspector.table(n) for n in names]
