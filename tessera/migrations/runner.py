"""Applying and reverting migrations.

A migration is a list of JSON steps on the store: ``create_table``, ``add_columns``, ``add_indexes``,
``drop_table``, ``drop_columns`` and ``drop_indexes`` (of which ``drop_table`` and ``drop_columns`` are
undone by hand), or SQL text with INSERT, UPDATE, DELETE and queries. A migration becomes visible as one transaction with its history row.
Applying and reverting hold the store's migration lock over their whole run, so of two runners the
second waits, and then sees what the first has done.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from enum import StrEnum
from pathlib import Path

from pyspark.sql import functions as F

from ..errors import MigrationError
from ..operators.writes import hold
from ..plans.schema import ColumnDef, TableDef, column, table, text, time
from ..sources.catalog import HISTORY
from ..sources.store import Store, Transaction
from .statements import run_sql

_ID = re.compile(r"[A-Za-z0-9_.-]+\Z")
HISTORY_TABLE = table(HISTORY, column("id", text()), column("checksum", text()), column("applied_at", time()), primary_key=["id"])


class State(StrEnum):
    APPLIED = "applied"
    PENDING = "pending"
    CHANGED = "changed"
    OUT_OF_ORDER = "out_of_order"
    UNKNOWN = "unknown"


@dataclass(frozen=True)
class Migration:
    """(source name, text) pairs up and down; ids sort."""

    id: str
    up: tuple[tuple[str, str], ...]
    down: tuple[tuple[str, str], ...] = ()

    @property
    def checksum(self) -> str:
        """Over the forward sources alone."""
        h = hashlib.sha256()
        for source, sql in self.up:
            h.update(source.encode() + b"\0" + sql.encode() + b"\0")
        return h.hexdigest()


def load_directory(path: str | Path) -> list[Migration]:
    """``<id>/<name>.up.json`` (or ``.up.sql``) files, each with its ``.down`` one."""
    out = []
    for folder in sorted(p for p in Path(path).iterdir() if p.is_dir()):
        ups = sorted(p for p in folder.iterdir() if re.search(r"\.up\.(json|sql)$", p.name))
        downs = {p.name for p in folder.iterdir() if re.search(r"\.down\.(json|sql)$", p.name)}
        pairs = [re.sub(r"\.up\.", ".down.", p.name) for p in ups]
        if not ups:
            raise MigrationError(f"{folder.name} has no forward file")
        if odd := sorted(downs.symmetric_difference(pairs)):
            raise MigrationError(f"{folder.name}: {', '.join(odd)} has no partner")
        out.append(Migration(folder.name, tuple((p.name, p.read_text()) for p in ups), tuple((n, (folder / n).read_text()) for n in reversed(pairs))))
    return out


def _prepared(migrations: list[Migration]) -> list[Migration]:
    ids = [m.id for m in migrations]
    if len(set(ids)) != len(ids):
        raise MigrationError("two migrations have one id")
    for m in migrations:
        if not _ID.match(m.id):
            raise MigrationError(f"{m.id!r} is no id")
        if not m.up or not all(sql.strip() for _, sql in m.up):
            raise MigrationError(f"{m.id} does nothing")
    return sorted(migrations, key=lambda m: m.id)


class Runner:
    def __init__(self, store: Store, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.store, self.clock = store, clock

    def _history(self) -> dict[str, str]:
        if HISTORY not in self.store.manifest()["tables"]:
            return {}
        return {r["id"]: r["checksum"] for r in self.store.read(HISTORY_TABLE).select("id", "checksum").collect()}

    def status(self, migrations: list[Migration]) -> list[tuple[str, State]]:
        """Of every migration, in order of ids. One that was applied although an earlier one is pending is out of order."""
        done, known = self._history(), _prepared(migrations)
        out, pending = [], False
        for m in known:
            if m.id not in done:
                pending = True
                out.append((m.id, State.PENDING))
            elif done[m.id] != m.checksum:
                out.append((m.id, State.CHANGED))
            else:
                out.append((m.id, State.OUT_OF_ORDER if pending else State.APPLIED))
        out += [(i, State.UNKNOWN) for i in done if i not in {m.id for m in known}]
        return sorted(out)

    def plan(self, migrations: list[Migration], through: str | None = None) -> list[Migration]:
        """What ``apply`` would do."""
        known = _prepared(migrations)
        if through is not None and through not in {m.id for m in known}:
            raise MigrationError(f"there is no migration {through}")
        states = dict(self.status(known))
        for wrong in (State.CHANGED, State.OUT_OF_ORDER, State.UNKNOWN):
            if bad := [i for i, s in states.items() if s is wrong]:
                raise MigrationError(f"{wrong}: {', '.join(bad)}")
        return [m for m in known if states[m.id] is State.PENDING and (through is None or m.id <= through)]

    def apply(self, migrations: list[Migration], through: str | None = None) -> list[str]:
        """Apply pending migrations in order; a failure leaves the earlier ones applied and itself undone."""
        with self.store.lock("migrations"):
            if HISTORY not in self.store.manifest()["tables"]:
                self.store.create_table(HISTORY_TABLE)
            out = []
            for m in self.plan(migrations, through):
                def record(tx: Transaction, m: Migration = m) -> None:
                    rows = self.store.spark.createDataFrame([(m.id, m.checksum, self.clock())], HISTORY_TABLE.struct())
                    tx.set_parts(HISTORY, [*tx.parts(HISTORY), tx.write_part(HISTORY_TABLE, rows)])

                self._run(m.id, m.up, record)
                out.append(m.id)
            return out

    def revert_plan(self, migrations: list[Migration], steps: int | None = None, through: str | None = None) -> list[Migration]:
        """What ``revert`` would do, the newest first."""
        if (steps is None) == (through is None):
            raise MigrationError("say either how many steps or down to which migration")
        known = {m.id: m for m in _prepared(migrations)}
        done = sorted(self._history(), reverse=True)
        if through is not None:
            if through not in done:
                raise MigrationError(f"{through} is not applied")
            done = [i for i in done if i >= through]
        else:
            if steps < 1:
                raise MigrationError("steps are 1 or more")
            done = done[:steps]
        out = []
        for i in done:
            if i not in known:
                raise MigrationError(f"{i} is applied but unknown")
            if known[i].checksum != self._history()[i]:
                raise MigrationError(f"{i} was changed after it was applied")
            if not known[i].down:
                raise MigrationError(f"{i} cannot be reverted")
            out.append(known[i])
        return out

    def revert(self, migrations: list[Migration], steps: int | None = None, through: str | None = None) -> list[str]:
        with self.store.lock("migrations"):
            out = []
            for m in self.revert_plan(migrations, steps, through):
                def forget(tx: Transaction, m: Migration = m) -> None:
                    rows = tx.read(HISTORY_TABLE).where(F.col("id") != m.id)
                    tx.set_parts(HISTORY, [tx.write_part(HISTORY_TABLE, rows)])

                self._run(m.id, m.down, forget)
                out.append(m.id)
            return out

    def _run(self, id_: str, sources: tuple[tuple[str, str], ...], record: Callable[[Transaction], None]) -> None:
        tx = self.store.begin()
        try:
            for source, said in sources:
                if source.endswith(".json"):
                    for step in json.loads(said):
                        run_step(tx, step)
                else:
                    run_sql(tx, said)
            record(tx)
            tx.commit()
        except Exception as e:
            tx.rollback()
            raise MigrationError(f"{id_}: {e}") from e


def run_step(tx: Transaction, step: dict) -> None:
    """One step: {"create_table": ...}, {"drop_table": key}, {"add_columns": key, "columns": [...]}, {"drop_columns": key, "columns": [names]},
    {"add_indexes": key, "indexes": [...]} or {"drop_indexes": key, "names": [...]}. A unique index holds for the rows that are there too.
    """
    if "create_table" in step:
        tx.create_table(TableDef.from_json(step["create_table"]))
    elif "drop_table" in step:
        tx.drop_table(step["drop_table"])
    elif "add_columns" in step:
        old = tx.definition(step["add_columns"])
        new: tuple[ColumnDef, ...] = TableDef.from_json({"name": "x", "columns": step["columns"]}).columns
        d = replace(old, columns=(*old.columns, *new)).validate()
        rows = tx.read(old).withColumns({c.name: F.expr(c.generated or c.default or "NULL").cast(c.type.spark()) for c in new})
        part = tx.write_part(d, rows)
        tx.alter_table(d)
        tx.set_parts(d.key, [part])
    elif "drop_columns" in step:
        old = tx.definition(step["drop_columns"])
        d = replace(old, columns=tuple(c for c in old.columns if c.name not in step["columns"])).validate()
        part = tx.write_part(d, tx.read(old))
        tx.alter_table(d)
        tx.set_parts(d.key, [part])
    elif "add_indexes" in step:
        old = tx.definition(step["add_indexes"])
        new = TableDef.from_json({"name": "x", "columns": [], "indexes": step["indexes"]}).indexes
        d = replace(old, indexes=(*old.indexes, *new)).validate()
        hold(tx, replace(d, indexes=new), tx.parts(d.key), [])
        tx.alter_table(d)
    elif "drop_indexes" in step:
        old = tx.definition(step["drop_indexes"])
        if unknown := set(step["names"]) - {old.constraint_name(i) for i in old.indexes}:
            raise MigrationError(f"{old.key} has no index {', '.join(sorted(unknown))}")
        tx.alter_table(replace(old, indexes=tuple(i for i in old.indexes if old.constraint_name(i) not in step["names"])).validate())
    else:
        raise MigrationError(f"unknown step {sorted(step)}")
