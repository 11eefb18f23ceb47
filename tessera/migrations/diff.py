"""The additive difference between a live and a desired schema; anything else needs a hand-written migration."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

from ..errors import ManualMigrationError, MigrationError
from ..plans.schema import ColumnDef, TableDef


@dataclass(frozen=True)
class Change:
    """A step and the step that undoes it."""

    up: dict[str, Any]
    down: dict[str, Any]


def topological(tables: Iterable[TableDef]) -> list[TableDef]:
    """Referenced tables first, otherwise by name; a circle of references is refused."""
    left, out = {t.key: t for t in sorted(tables, key=lambda t: t.key)}, []
    while left:
        ready = [t for t in left.values() if all((k := f"{f.schema}.{f.table}" if f.schema else f.table) == t.key or k not in left for f in t.foreign_keys)]
        if not ready:
            raise MigrationError(f"tables refer to each other in a circle: {', '.join(left)}")
        out.append(ready[0])
        del left[ready[0].key]
    return out


def needs_backfill(c: ColumnDef) -> bool:
    """Whether rows that are there would have no value for a new column."""
    return not c.nullable and c.default is None and c.generated is None and c.identity is None


def diff_schemas(live: Iterable[TableDef], desired: Iterable[TableDef]) -> list[Change]:
    """Changes that lead from one to the other, in an order that always is the same."""
    have, want = {t.key: t for t in live}, {t.key: t.validate() for t in desired}
    if gone := sorted(set(have) - set(want)):
        raise ManualMigrationError(f"dropping {', '.join(gone)} needs a migration by hand")
    out = []
    for d in topological(want.values()):
        if d.key not in have:
            out.append(Change({"create_table": d.to_json()}, {"drop_table": d.key}))
            continue
        out += _table_changes(have[d.key], d)
    return out


def _table_changes(old: TableDef, new: TableDef) -> list[Change]:
    names = {c.name for c in new.columns}
    if gone := [c.name for c in old.columns if c.name not in names]:
        raise ManualMigrationError(f"{old.key}: dropping or renaming {', '.join(gone)} needs a migration by hand")
    for c in old.columns:
        if (now := new.column(c.name)) != c:
            what = [f.name for f in fields(c) if getattr(c, f.name) != getattr(now, f.name)]
            raise ManualMigrationError(f"{old.key}.{c.name}: a change of {', '.join(what)} needs a migration by hand")
    for name in ("primary_key", "uniques", "checks", "foreign_keys", "exclusions"):
        if getattr(old, name) != getattr(new, name):
            raise ManualMigrationError(f"{old.key}: a change of {name} needs a migration by hand")
    if gone := [old.constraint_name(i) for i in old.indexes if i not in new.indexes]:
        raise ManualMigrationError(f"{old.key}: dropping or changing the index {', '.join(gone)} needs a migration by hand")
    indexes = [i for i in new.indexes if i not in old.indexes]
    more = []
    if indexes:
        said = replace(new, indexes=tuple(indexes)).to_json()["indexes"]
        more = [Change({"add_indexes": old.key, "indexes": said}, {"drop_indexes": old.key, "names": [new.constraint_name(i) for i in indexes]})]
    added = [c for c in new.columns if old.column(c.name) is None]
    if not added:
        return more
    if tuple(new.columns[: len(old.columns)]) != old.columns:
        raise ManualMigrationError(f"{old.key}: new columns stand after the old ones")
    if bad := [c.name for c in added if needs_backfill(c)]:
        raise ManualMigrationError(f"{old.key}: {', '.join(bad)} needs values for the rows that are there")
    if bad := [c.name for c in added if c.identity]:
        raise ManualMigrationError(f"{old.key}: a new identity column needs a migration by hand")
    columns = replace(new, columns=tuple(added), primary_key=(), uniques=(), checks=(), indexes=(), foreign_keys=(), exclusions=(), relationships=()).to_json()["columns"]
    return [Change({"add_columns": old.key, "columns": columns}, {"drop_columns": old.key, "columns": [c.name for c in added]}), *more]


def write_migration(root: str | Path, id_: str, name: str, changes: list[Change]) -> Path:
    """Write a migration's folder at once; one that is there is never touched."""
    root, target = Path(root), Path(root) / id_
    if target.exists():
        raise MigrationError(f"{target} is already there")
    if not changes:
        raise MigrationError("there is nothing to change")
    root.mkdir(parents=True, exist_ok=True)
    fresh = Path(tempfile.mkdtemp(prefix=f".{id_}-", dir=root))
    try:
        (fresh / f"001_{name}.up.json").write_text(json.dumps([c.up for c in changes], indent=2) + "\n")
        (fresh / f"001_{name}.down.json").write_text(json.dumps([c.down for c in reversed(changes)], indent=2) + "\n")
        os.rename(fresh, target)
    except BaseException:
        shutil.rmtree(fresh, ignore_errors=True)
        raise
    return target
