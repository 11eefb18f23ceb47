"""Expressions and statements: immutable, compared by value, checked by ``validate``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import ValidationError
from ..functions import AGGREGATES, CURATED
from .schema import ColumnDef, TableDef, check_name


@dataclass(frozen=True)
class TableRef:
    """A table in a statement, under an alias if it has one."""

    definition: TableDef
    alias: str | None = None

    def as_(self, alias: str) -> TableRef:
        return replace(self, alias=check_name("alias", alias))

    def col(self, name: str) -> ColumnRef:
        if self.definition.column(name) is None:
            raise ValidationError(self.qualifier, f"there is no column {name}")
        return ColumnRef(self, name)

    __getitem__ = col

    def columns(self) -> tuple[ColumnRef, ...]:
        return tuple(ColumnRef(self, c.name) for c in self.definition.columns)

    @property
    def qualifier(self) -> str:
        return self.alias or self.definition.name

    @property
    def identity(self) -> tuple[str | None, str, str | None]:
        return (None if self.alias else self.definition.schema, self.definition.name if not self.alias else "", self.alias)


def table_ref(definition: TableDef) -> TableRef:
    return TableRef(definition.validate())


class Expression:
    """Base of all expressions."""


@dataclass(frozen=True)
class ColumnRef(Expression):
    source: TableRef
    name: str

    @property
    def definition(self) -> ColumnDef | None:
        return self.source.definition.column(self.name)


@dataclass(frozen=True)
class Bound(Expression):
    """A value sent beside the statement."""

    value: Any

    def __hash__(self) -> int:
        return hash(repr(self.value))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Bound) and type(self.value) is type(other.value) and self.value == other.value


@dataclass(frozen=True)
class Compare(Expression):
    left: Expression
    op: str
    right: Expression


@dataclass(frozen=True)
class Logical(Expression):
    op: str
    operands: tuple[Expression, ...]


@dataclass(frozen=True)
class Not(Expression):
    operand: Expression


@dataclass(frozen=True)
class NullTest(Expression):
    operand: Expression
    negated: bool = False


@dataclass(frozen=True)
class Membership(Expression):
    """IN or NOT IN, of a list or of a subquery."""

    operand: Expression
    members: tuple[Expression, ...] | Select
    negated: bool = False


@dataclass(frozen=True)
class Function(Expression):
    name: str
    arguments: tuple[Expression, ...]
    curated: bool = True
    distinct: bool = False
    star: bool = False

    def with_distinct(self) -> Function:
        return replace(self, distinct=True)

    @property
    def aggregates(self) -> bool:
        return self.curated and self.name in AGGREGATES


@dataclass(frozen=True)
class Scalar(Expression):
    """A subquery of one expression as a value: NULL without rows, an error with several."""

    select: Select


@dataclass(frozen=True)
class Excluded(Expression):
    """In an upsert's assignment, the value that could not be inserted."""

    column: ColumnRef


OPERATORS = ("=", "<>", ">", ">=", "<", "<=", "LIKE")


def bind(value: Any) -> Bound:
    return Bound(value)


def as_expression(x: Any) -> Expression:
    return x if isinstance(x, Expression) else Bound(x)


def compare(left: Expression, op: str, right: Any) -> Compare:
    return Compare(left, op, as_expression(right))


def equal(left, right):
    return compare(left, "=", right)


def not_equal(left, right):
    return compare(left, "<>", right)


def greater(left, right):
    return compare(left, ">", right)


def greater_or_equal(left, right):
    return compare(left, ">=", right)


def less(left, right):
    return compare(left, "<", right)


def less_or_equal(left, right):
    return compare(left, "<=", right)


def like(left, right):
    return compare(left, "LIKE", right)


def and_(*operands: Expression) -> Logical:
    return Logical("AND", operands)


def or_(*operands: Expression) -> Logical:
    return Logical("OR", operands)


def negate(operand: Expression) -> Not:
    return Not(operand)


def is_null(operand: Expression) -> NullTest:
    return NullTest(operand)


def is_not_null(operand: Expression) -> NullTest:
    return NullTest(operand, True)


def in_(operand: Expression, *members: Any) -> Membership:
    return Membership(operand, tuple(map(as_expression, members)))


def not_in(operand: Expression, *members: Any) -> Membership:
    return Membership(operand, tuple(map(as_expression, members)), True)


def in_select(operand: Expression, select: Select) -> Membership:
    return Membership(operand, select)


def not_in_select(operand: Expression, select: Select) -> Membership:
    return Membership(operand, select, True)


def scalar(select: Select) -> Scalar:
    return Scalar(select)


def excluded(column: ColumnRef) -> Excluded:
    return Excluded(column)


def call(name: str, *arguments: Any) -> Function:
    """A curated function."""
    if name.upper() not in CURATED:
        raise ValidationError("function", f"{name} is not curated; func() reaches any other")
    return Function(name.upper(), tuple(map(as_expression, arguments)))


def func(name: str, *arguments: Any) -> Function:
    """Any function the engine has, placed like a scalar."""
    return Function(check_name("function", name), tuple(map(as_expression, arguments)), curated=False)


def count_all() -> Function:
    return Function("COUNT", (), star=True)


def count(e):
    return call("COUNT", e)


def sum_(e):
    return call("SUM", e)


def min_(e):
    return call("MIN", e)


def max_(e):
    return call("MAX", e)


def avg(e):
    return call("AVG", e)


def coalesce(*e):
    return call("COALESCE", *e)


def lower(e):
    return call("LOWER", e)


def upper(e):
    return call("UPPER", e)


def abs_(e):
    return call("ABS", e)


@dataclass(frozen=True)
class Projection:
    expression: Expression
    alias: str | None = None

    def as_(self, alias: str) -> Projection:
        return replace(self, alias=check_name("projection alias", alias))


def project(expression: Expression, alias: str | None = None) -> Projection:
    made = Projection(expression)
    return made.as_(alias) if alias is not None else made


@dataclass(frozen=True)
class Join:
    kind: str
    source: TableRef
    on: Expression


def inner_join(source: TableRef, on: Expression) -> Join:
    return Join("inner", source, on)


def left_join(source: TableRef, on: Expression) -> Join:
    return Join("left", source, on)


@dataclass(frozen=True)
class Order:
    expression: Expression
    descending: bool = False


def asc(expression: Expression) -> Order:
    return Order(expression)


def desc(expression: Expression) -> Order:
    return Order(expression, True)


@dataclass(frozen=True)
class Select:
    source: TableRef
    projections: tuple[Projection, ...]
    joins: tuple[Join, ...] = ()
    where: Expression | None = None
    group_by: tuple[Expression, ...] = ()
    having: Expression | None = None
    order: tuple[Order, ...] = ()
    distinct: bool = False
    limit: int | None = None
    offset: int | None = None

    def validate(self) -> Select:
        from .validate import validate_select

        validate_select(self)
        return self

    def but(self, **changes: Any) -> Select:
        """A changed, validated copy."""
        return replace(self, **changes).validate()


def select(source: TableRef, *projections: Projection | Expression, **clauses: Any) -> Select:
    made = tuple(p if isinstance(p, Projection) else Projection(p) for p in projections)
    return Select(source, made, **{k: tuple(v) if isinstance(v, list) else v for k, v in clauses.items()}).validate()


@dataclass(frozen=True)
class Assignment:
    column: ColumnRef
    value: Expression


def set_(column: ColumnRef, value: Any) -> Assignment:
    return Assignment(column, as_expression(value))


class Write:
    """Base of the statements that change a table."""

    def validate(self):
        from .validate import validate_write

        validate_write(self)
        return self

    def with_returning(self, *projections: Projection | Expression):
        made = tuple(p if isinstance(p, Projection) else Projection(p) for p in projections)
        return replace(self, returning=made).validate()


@dataclass(frozen=True)
class Insert(Write):
    """Rows of values for some columns; ``default_values`` inserts one row of defaults."""

    into: TableRef
    columns: tuple[ColumnRef, ...] = ()
    rows: tuple[tuple[Expression, ...], ...] = ()
    default_values: bool = False
    returning: tuple[Projection, ...] = ()


@dataclass(frozen=True)
class Update(Write):
    table: TableRef
    assignments: tuple[Assignment, ...]
    where: Expression | None = None
    all_rows: bool = False
    returning: tuple[Projection, ...] = ()


@dataclass(frozen=True)
class Delete(Write):
    table: TableRef
    where: Expression | None = None
    all_rows: bool = False
    returning: tuple[Projection, ...] = ()


@dataclass(frozen=True)
class Upsert(Write):
    """An insert that on conflict does nothing (no assignments) or updates."""

    insert: Insert
    conflict: tuple[ColumnRef, ...] = ()
    assignments: tuple[Assignment, ...] = ()
    returning: tuple[Projection, ...] = field(default=())


def insert(into: TableRef, columns: list[str] | tuple[str, ...], *rows: tuple | list) -> Insert:
    return Insert(into, tuple(into.col(c) for c in columns), tuple(tuple(map(as_expression, r)) for r in rows)).validate()


def default_insert(into: TableRef) -> Insert:
    return Insert(into, default_values=True).validate()


def update(table: TableRef, *assignments: Assignment, where: Expression | None = None, all_rows: bool = False) -> Update:
    return Update(table, assignments, where, all_rows)


def delete(table: TableRef, where: Expression | None = None, all_rows: bool = False) -> Delete:
    return Delete(table, where, all_rows)


def upsert(inserted: Insert, conflict: list[ColumnRef] | tuple[ColumnRef, ...] = (), *assignments: Assignment) -> Upsert:
    return Upsert(inserted, tuple(conflict), assignments).validate()
