"""Writes of row objects."""

from __future__ import annotations

from typing import Any, TypeVar

from ..errors import ValidationError
from ..plans.nodes import Bound, Expression, Insert, Projection, Update, and_, default_insert, equal, insert, set_, update
from ..plans.render import render
from ..plans.schema import TableDef
from .builder import Table
from .database import Database, Operation
from .decode import column_values, plan
from .writes import merge_rows, referred_columns

R = TypeVar("R")


def _returning(table: Table[R]) -> tuple[Projection, ...]:
    return tuple(Projection(table.ref.col(c)) for _, c, _ in plan(table.row))


def _values(d: TableDef, row: Any, defaults: tuple[str, ...]) -> dict[str, Any]:
    given = column_values(row)
    if unknown := [c for c in given if d.column(c) is None]:
        raise ValidationError(f"table {d.key}", f"there is no column {', '.join(unknown)}")
    out = {}
    for c in d.columns:
        if not c.writable or c.name in defaults:
            continue
        if c.name not in given:
            raise ValidationError(f"table {d.key}", f"the row has no value for {c.name}")
        out[c.name] = given[c.name]
    return out


def insert_statement(table: Table[R], rows: list[R], default_columns: tuple[str, ...] = ()) -> list[Insert]:
    """One statement for all rows, or one a row where every column takes its default."""
    d = table.definition
    if not rows:
        raise ValidationError("rows", "there is nothing to insert")
    if len(set(default_columns)) != len(default_columns):
        raise ValidationError("defaults", "a column stands twice")
    for c in default_columns:
        if d.column(c) is None:
            raise ValidationError("defaults", f"there is no column {c}")
    made = [_values(d, r, tuple(default_columns)) for r in rows]
    if not made[0]:
        return [default_insert(table.ref) for _ in rows]
    return [insert(table.ref, list(made[0]), *([Bound(v) for v in m.values()] for m in made))]


def insert_rows(db: Database, table: Table[R], rows: list[R], default_columns: tuple[str, ...] = ()) -> int:
    return sum(db.exec(w) for w in insert_statement(table, rows, default_columns))


def insert_row(db: Database, table: Table[R], row: R, default_columns: tuple[str, ...] = ()) -> int:
    return insert_rows(db, table, [row], default_columns)


def insert_returning(db: Database, table: Table[R], rows: list[R], default_columns: tuple[str, ...] = ()) -> list[R]:
    """The rows as the table took them."""
    return [r for w in insert_statement(table, rows, default_columns) for r in db.query_write_all(w.with_returning(*_returning(table)), table.row)]


def _by_key(table: Table[R], row: R) -> Expression:
    d = table.definition
    if not d.primary_key:
        raise ValidationError(f"table {d.key}", "it has no primary key; say which rows")
    given = column_values(row)
    tests = [equal(table.ref.col(c), Bound(given[c])) for c in d.primary_key]
    return tests[0] if len(tests) == 1 else and_(*tests)


def update_statement(table: Table[R], row: R, columns: tuple[str, ...] | None = None, where: Expression | None = None) -> Update:
    d, given = table.definition, column_values(row)
    for c in columns or ():
        if d.column(c) is None:
            raise ValidationError("columns", f"there is no column {c}")
        if c in d.primary_key:
            raise ValidationError("columns", f"{c} is part of the key")
        if not d.column(c).writable:
            raise ValidationError("columns", f"{c} is computed by the table")
    chosen = columns if columns is not None else [c.name for c in d.columns if c.writable and c.name not in d.primary_key and c.name in given]
    return update(table.ref, *(set_(table.ref.col(c), Bound(given[c])) for c in chosen), where=where if where is not None else _by_key(table, row)).validate()


def update_row(db: Database, table: Table[R], row: R) -> int:
    return db.exec(update_statement(table, row))


def update_rows(db: Database, table: Table[R], rows: list[R]) -> int:
    """Update every row by its key, in one write; hooks see one statement.

    Only where other tables refer to what is set, it is one statement a row, in one transaction.
    """
    if not rows:
        return 0
    d, first = table.definition, update_statement(table, rows[0])
    if not d.primary_key:
        raise ValidationError(f"table {d.key}", "it has no primary key; say which rows")
    columns = tuple(a.column.name for a in first.assignments)
    db._usable()
    with_begin = hasattr(db.provider, "begin")
    if with_begin and referred_columns(db.transaction or db.provider.begin(), d) & set(columns):
        if db.transaction is not None:
            return sum(update_row(db, table, r) for r in rows)
        own = db.begin()
        try:
            n = sum(update_row(own, table, r) for r in rows)
            own.commit()
        except BaseException:
            own.rollback()
            raise
        return n
    said = render(first)
    given = [column_values(r) for r in rows]
    if missing := [c for g in given for c in (*d.primary_key, *columns) if c not in g]:
        raise ValidationError(f"table {d.key}", f"a row has no value for {missing[0]}")
    return db._run(Operation("exec", said.sql, said.args), lambda: 0 if db.dry_run else merge_rows(db, d, given, columns))


def update_columns(db: Database, table: Table[R], row: R, *columns: str) -> int:
    return db.exec(update_statement(table, row, columns))


def update_where(db: Database, table: Table[R], row: R, where: Expression, *columns: str) -> int:
    return db.exec(update_statement(table, row, columns or None, where))
