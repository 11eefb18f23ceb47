"""Fluent builders. Each call gives a changed copy; the first mistake is kept and raised by the terminal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any, Generic, TypeVar

from ..errors import TesseraError, ValidationError
from ..plans.dialect import SPARK, Dialect
from ..plans.nodes import ColumnRef, Delete, Expression, Join, Logical, Order, Projection, Select, TableRef, equal, in_
from ..plans.render import Statement, render
from ..plans.schema import TableDef
from .database import Database, counting
from .decode import plan

R = TypeVar("R")


@dataclass(frozen=True)
class Table(Generic[R]):
    """A table whose rows are a dataclass; every field must have a column."""

    definition: TableDef
    row: type[R]
    alias: str | None = None

    def __post_init__(self):
        self.definition.validate()
        for _, column, _ in plan(self.row):
            if self.definition.column(column) is None:
                raise ValidationError(f"table {self.definition.key}", f"there is no column {column}")

    @property
    def ref(self) -> TableRef:
        return TableRef(self.definition, self.alias)

    def col(self, name: str) -> ColumnRef:
        return self.ref.col(name)

    __getitem__ = col

    def as_(self, alias: str) -> Table[R]:
        return replace(self, alias=self.ref.as_(alias).alias)


@dataclass(frozen=True)
class SelectBuilder(Generic[R]):
    source: TableRef
    row: type[R] | None = None
    projections: tuple[Projection, ...] = ()
    joins: tuple[Join, ...] = ()
    conditions: tuple[Expression, ...] = ()
    keys: tuple[Expression, ...] = ()
    group_conditions: tuple[Expression, ...] = ()
    orders: tuple[Order, ...] = ()
    is_distinct: bool = False
    most: int | None = None
    skipped: int | None = None
    error: TesseraError | None = None

    def _with(self, make) -> SelectBuilder[R]:
        if self.error:
            return self
        try:
            return replace(self, **make())
        except TesseraError as e:
            return replace(self, error=e)

    def select(self, *names: str) -> SelectBuilder[R]:
        return self._with(lambda: {"projections": self.projections + tuple(Projection(self.source.col(n)) for n in names)})

    def project(self, *projections: Projection | Expression) -> SelectBuilder[R]:
        return self._with(lambda: {"projections": self.projections + tuple(p if isinstance(p, Projection) else Projection(p) for p in projections)})

    def only(self, *projections: Projection | Expression) -> SelectBuilder[R]:
        """Project these in place of what was projected before."""
        return replace(self, projections=()).project(*projections)

    def join(self, *joins: Join) -> SelectBuilder[R]:
        return self._with(lambda: {"joins": self.joins + joins})

    def inner_join(self, source: TableRef | Table, on: Expression) -> SelectBuilder[R]:
        return self.join(Join("inner", getattr(source, "ref", source), on))

    def left_join(self, source: TableRef | Table, on: Expression) -> SelectBuilder[R]:
        return self.join(Join("left", getattr(source, "ref", source), on))

    def where(self, condition: Expression) -> SelectBuilder[R]:
        """Conditions add up."""
        return self._with(lambda: {"conditions": (*self.conditions, condition)})

    def where_equal(self, column: str | ColumnRef, value: Any) -> SelectBuilder[R]:
        return self._with(lambda: {"conditions": (*self.conditions, equal(self._column(column), value))})

    def where_in(self, column: str | ColumnRef, values: list | tuple) -> SelectBuilder[R]:
        def make():
            if not values:
                raise ValidationError("where", "an IN list has members")
            return {"conditions": (*self.conditions, in_(self._column(column), *values))}

        return self._with(make)

    def _column(self, column: str | ColumnRef) -> ColumnRef:
        return self.source.col(column) if isinstance(column, str) else column

    def group_by(self, *keys: Expression) -> SelectBuilder[R]:
        return self._with(lambda: {"keys": self.keys + keys})

    def group_by_columns(self, *names: str) -> SelectBuilder[R]:
        return self._with(lambda: {"keys": self.keys + tuple(self.source.col(n) for n in names)})

    def having(self, condition: Expression) -> SelectBuilder[R]:
        return self._with(lambda: {"group_conditions": (*self.group_conditions, condition)})

    def order(self, *orders: Order) -> SelectBuilder[R]:
        return self._with(lambda: {"orders": self.orders + orders})

    def order_asc(self, *names: str) -> SelectBuilder[R]:
        return self._with(lambda: {"orders": self.orders + tuple(Order(self.source.col(n)) for n in names)})

    def order_desc(self, *names: str) -> SelectBuilder[R]:
        return self._with(lambda: {"orders": self.orders + tuple(Order(self.source.col(n), True) for n in names)})

    def distinct(self) -> SelectBuilder[R]:
        return self._with(lambda: {"is_distinct": True})

    def limit(self, n: int) -> SelectBuilder[R]:
        return self._with(lambda: {"most": n})

    def offset(self, n: int) -> SelectBuilder[R]:
        return self._with(lambda: {"skipped": n})

    def statement(self) -> Select:
        if self.error:
            raise self.error
        return Select(self.source, self.projections, self.joins, _all(self.conditions), self.keys, _all(self.group_conditions), self.orders, self.is_distinct, self.most, self.skipped).validate()

    def build(self, dialect: Dialect = SPARK) -> Statement:
        return render(self.statement(), dialect)

    def build_count(self, dialect: Dialect = SPARK) -> Statement:
        return render(counting(self._countable()), dialect)

    def _countable(self) -> Select:
        if self.error:
            raise self.error
        return (self if self.projections else self.project(*self.source.columns())).statement()

    def frame(self, db: Database):
        return db.frame(self.statement())

    def query(self, db: Database) -> Iterator[R]:
        return db.query(self.statement(), self.row)

    def all(self, db: Database) -> list[R]:
        return db.all(self.statement(), self.row)

    def one(self, db: Database) -> R:
        return db.one(self.statement(), self.row)

    def count(self, db: Database) -> int:
        return db.count(self._countable())


def _all(conditions: tuple[Expression, ...]) -> Expression | None:
    return None if not conditions else conditions[0] if len(conditions) == 1 else Logical("AND", conditions)


def select_from(table: Table[R]) -> SelectBuilder[R]:
    """All columns of the table, as its rows."""
    return SelectBuilder(table.ref, table.row, tuple(Projection(c) for c in table.ref.columns()))


def decode_from(table: Table | TableRef, row: type[R]) -> SelectBuilder[R]:
    """Rows of another shape; the caller projects what it needs."""
    return SelectBuilder(getattr(table, "ref", table), row)


def dynamic_select(source: TableRef) -> SelectBuilder[Any]:
    """Rows whose columns are known when they come."""
    return SelectBuilder(source)


@dataclass(frozen=True)
class DeleteBuilder:
    source: TableRef
    row: type | None = None
    conditions: tuple[Expression, ...] = ()
    every: bool = False
    projections: tuple[Projection, ...] = ()

    def where(self, condition: Expression) -> DeleteBuilder:
        return replace(self, conditions=(*self.conditions, condition))

    def where_equal(self, column: str, value: Any) -> DeleteBuilder:
        return self.where(equal(self.source.col(column), value))

    def where_in(self, column: str, values: list | tuple) -> DeleteBuilder:
        if not values:
            raise ValidationError("where", "an IN list has members")
        return self.where(in_(self.source.col(column), *values))

    def allow_all(self) -> DeleteBuilder:
        return replace(self, every=True)

    def returning(self, *projections: Projection | Expression) -> DeleteBuilder:
        if not projections:
            raise ValidationError("returning", "it projects something")
        return replace(self, projections=tuple(p if isinstance(p, Projection) else Projection(p) for p in projections))

    def statement(self) -> Delete:
        return Delete(self.source, _all(self.conditions), self.every, self.projections).validate()

    def build(self, dialect: Dialect = SPARK) -> Statement:
        return render(self.statement(), dialect)

    def exec(self, db: Database) -> int:
        return db.exec(self.statement())

    def query(self, db: Database) -> Iterator[Any]:
        return db.query_write(self.statement(), self.row)

    def all(self, db: Database) -> list[Any]:
        return db.query_write_all(self.statement(), self.row)

    def one(self, db: Database) -> Any:
        return db.query_write_one(self.statement(), self.row)


def delete_from(table: Table | TableRef) -> DeleteBuilder:
    return DeleteBuilder(getattr(table, "ref", table), getattr(table, "row", None))
