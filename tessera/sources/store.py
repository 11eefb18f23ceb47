"""A table store of immutable Parquet parts and one manifest that names the current ones.

An insert adds a part: its cost is that of the new rows. Updates, deletes and upserts that change
rows write anew the parts that hold such rows, and read the others at most; ``compact`` puts small
parts together. A statement or a transaction becomes visible at once, when the manifest is replaced by one rename
under a lock file; readers keep the parts that they started with. Two transactions that change one
table cannot both commit. Old parts stay until ``vacuum``.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

from ..errors import CapabilityError, TableNotFoundError, TransactionError, ValidationError
from ..plans.schema import TableDef
from .files import Files


class Store:
    def __init__(self, spark: SparkSession, root: str, lock_seconds: float = 30):
        self.spark, self.root, self.files, self.lock_seconds = spark, root.rstrip("/"), Files(spark), lock_seconds

    @property
    def _manifest_path(self) -> str:
        return f"{self.root}/manifest.json"

    def manifest(self) -> dict[str, Any]:
        if not self.files.exists(self._manifest_path):
            return {"version": 0, "tables": {}}
        return json.loads(self.files.read(self._manifest_path))

    def read(self, definition: TableDef) -> DataFrame:
        return self.begin().read(definition)

    def definitions(self) -> list[TableDef]:
        tables = self.manifest()["tables"]
        return [TableDef.from_json(tables[k]["definition"]) for k in sorted(tables)]

    def definition(self, key: str) -> TableDef:
        return self.begin().definition(key)

    def create_table(self, definition: TableDef) -> None:
        tx = self.begin()
        tx.create_table(definition)
        tx.commit()

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    @contextmanager
    def lock(self, name: str) -> Iterator[None]:
        """Hold the lock file ``name``; whoever comes second waits up to ``lock_seconds``. A run that was killed leaves its file to be removed by hand."""
        path, until = f"{self.root}/{name}.lock", time.monotonic() + self.lock_seconds
        while True:
            try:
                self.files.write(path, str(time.time()), new=True)
                break
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
                if time.monotonic() > until:
                    raise TransactionError(f"the store is locked: {path}") from e
                time.sleep(0.1)
        try:
            yield
        finally:
            self.files.delete(path)

    def swap(self, base: dict[str, Any], changed: dict[str, Any], touched: set[str]) -> None:
        """Replace the manifest if no touched table changed meanwhile."""
        with self.lock("manifest"):
            now = self.manifest()
            for key in touched:
                if now["tables"].get(key) != base["tables"].get(key):
                    raise TransactionError(f"{key} was changed by another transaction")
            for key in touched:
                if key in changed["tables"]:
                    now["tables"][key] = changed["tables"][key]
                else:
                    now["tables"].pop(key, None)
            now["version"] += 1
            fresh = f"{self.root}/manifest-{uuid.uuid4().hex}.json"
            self.files.write(fresh, json.dumps(now))
            self.files.replace(fresh, self._manifest_path)

    def compact(self, key: str, below: int = 64 << 20) -> int:
        """Put the parts of less than ``below`` bytes into one; how many there were. Fails if the table changes meanwhile."""
        tx = self.begin()
        size = {p: self.files.size(f"{self.root}/parts/{p}") for p in tx.parts(key)}
        small = [p for p, n in size.items() if n < below]
        if len(small) < 2:
            return 0
        d = tx.definition(key)
        try:
            wanted = max(1, -(-sum(size[p] for p in small) // (128 << 20)))
            part = tx.write_part(d, tx.read_parts(d, small).coalesce(wanted))
            tx.set_parts(key, [*(p for p in size if p not in small), part])
            tx.commit()
        except BaseException:
            tx.rollback()
            raise
        return len(small)

    def vacuum(self) -> None:
        """Drop the parts that no table has any more. No reader or writer may be at work."""
        used = {p for t in self.manifest()["tables"].values() for p in t["parts"]}
        p, fs = self.files._path(f"{self.root}/parts")
        if fs.exists(p):
            for status in fs.listStatus(p):
                if status.getPath().getName() not in used:
                    fs.delete(status.getPath(), True)


class Transaction:
    """Changes apart from the store until ``commit``."""

    def __init__(self, store: Store, manifest: dict[str, Any]):
        self.store, self.spark, self.base = store, store.spark, manifest
        self.now = copy.deepcopy(manifest)
        self.touched: set[str] = set()
        self.written: list[str] = []
        self.finished = False

    def _entry(self, key: str) -> dict[str, Any]:
        if key not in self.now["tables"]:
            raise TableNotFoundError(f"there is no table {key}")
        return self.now["tables"][key]

    def definition(self, key: str) -> TableDef:
        return TableDef.from_json(self._entry(key)["definition"])

    def definitions(self) -> list[TableDef]:
        return [self.definition(k) for k in sorted(self.now["tables"])]

    def create_table(self, definition: TableDef) -> None:
        definition.validate()
        if definition.exclusions:
            raise CapabilityError(f"{definition.key}: exclusion constraints cannot be enforced")
        if definition.key in self.now["tables"]:
            raise ValidationError(f"table {definition.key}", "it is already there")
        for f in definition.foreign_keys:
            key = f"{f.schema}.{f.table}" if f.schema else f.table
            other = definition if key == definition.key else self.definition(key)
            unique = {other.primary_key, *(u.columns for u in other.uniques), *(i.columns for i in other.indexes if i.unique and not i.predicate)}
            if not any(set(f.references) == set(u) for u in unique if u):
                raise ValidationError(f"table {definition.key}", f"{key} has no key {', '.join(f.references)}")
        definition.struct()
        self.now["tables"][definition.key] = {"definition": definition.to_json(), "parts": [], "next": {}}
        self.touched.add(definition.key)

    def drop_table(self, key: str) -> None:
        self._entry(key)
        if users := [d.key for d in self.definitions() if d.key != key and any((f"{f.schema}.{f.table}" if f.schema else f.table) == key for f in d.foreign_keys)]:
            raise ValidationError(f"table {key}", f"{', '.join(users)} refers to it")
        del self.now["tables"][key]
        self.touched.add(key)

    def alter_table(self, definition: TableDef) -> None:
        """Describe a table anew; columns that are new read as null or were backfilled by the caller."""
        self._entry(definition.validate().key)["definition"] = definition.to_json()
        self.touched.add(definition.key)

    def read(self, definition: TableDef) -> DataFrame:
        self.alive()
        return self.read_parts(self.definition(definition.key), self._entry(definition.key)["parts"])

    def read_parts(self, definition: TableDef, parts: list[str]) -> DataFrame:
        struct = definition.struct()
        if not parts:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(*(f"{self.store.root}/parts/{p}" for p in parts))

    def write_part(self, definition: TableDef, rows: DataFrame) -> str:
        """A new part, not yet of the table."""
        self.alive()
        part = f"{definition.key.replace('.', '-')}-{uuid.uuid4().hex}"
        self.written.append(part)
        rows.select(*(rows[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in definition.struct())).write.parquet(f"{self.store.root}/parts/{part}")
        return part

    def parts(self, key: str) -> list[str]:
        return list(self._entry(key)["parts"])

    def set_parts(self, key: str, parts: list[str]) -> None:
        self._entry(key)["parts"] = parts
        self.touched.add(key)

    def next_ids(self, key: str, column: str, n: int) -> int:
        """The first of ``n`` new identity values."""
        counters = self._entry(key)["next"]
        first = counters.get(column, 1)
        counters[column] = first + n
        self.touched.add(key)
        return first

    def alive(self) -> None:
        if self.finished:
            raise TransactionError("the transaction is over")

    def commit(self) -> None:
        self.alive()
        self.finished = True
        if self.touched:
            self.store.swap(self.base, self.now, self.touched)

    def rollback(self) -> None:
        if not self.finished:
            self.finished = True
            for part in self.written:
                self.store.files.delete(f"{self.store.root}/parts/{part}")
