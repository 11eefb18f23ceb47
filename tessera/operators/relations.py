"""Batch loading of related rows: one query for all parents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame

from ..errors import ValidationError
from ..plans.nodes import Expression, TableRef, and_, equal, in_, or_
from .builder import Table, select_from
from .database import Database

P, C, K = TypeVar("P"), TypeVar("C"), TypeVar("K")


def load_has_many(db: Database, children: Table[C], key_column: str | tuple[str, ...], parents: list[P], parent_key: Callable[[P], K], child_key: Callable[[C], K]) -> dict[K, list[C]]:
    """The children of every parent, by key; a parent without any has an empty list. Keys of several columns are tuples."""
    keys = list(dict.fromkeys(map(parent_key, parents)))
    out: dict[K, list[C]] = {k: [] for k in keys}
    if known := [k for k in keys if _whole(k)]:
        for child in select_from(children).where(_among(children, key_column, known)).all(db):
            out.setdefault(child_key(child), []).append(child)
    return out


def load_belongs_to(db: Database, owners: Table[C], key_column: str | tuple[str, ...], rows: list[P], row_key: Callable[[P], K | None], owner_key: Callable[[C], K]) -> dict[K, C]:
    """The owner of every row that names one, by key; the last row of a key wins."""
    keys = [k for k in dict.fromkeys(map(row_key, rows)) if _whole(k)]
    if not keys:
        return {}
    return {owner_key(o): o for o in select_from(owners).where(_among(owners, key_column, keys)).all(db)}


def _whole(key: Any) -> bool:
    """Whether a key refers to anything; one with a null does not."""
    return None not in key if isinstance(key, tuple) else key is not None


def _among(table: Table, column: str | tuple[str, ...], keys: list) -> Expression:
    if isinstance(column, str):
        return in_(_column(table, column), *keys)
    each = [and_(*(equal(_column(table, c), v) for c, v in zip(column, key, strict=True))) for key in keys]
    return each[0] if len(each) == 1 else or_(*each)


def _column(table: Table, name: str) -> Any:
    if table.definition.column(name) is None:
        raise ValidationError(f"table {table.definition.key}", f"there is no column {name}")
    return table.col(name)


def related(db: Database, child: TableRef, child_column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """The same without the driver: children of all parents in a DataFrame, by a semi-join on distinct keys."""
    rows = db.read(child)
    keys = parents.select(parents[parent_column].alias("_parent_key")).distinct()
    return rows.join(keys, rows[child_column] == keys["_parent_key"], "left_semi")
