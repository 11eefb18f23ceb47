"""Lowering of a validated SELECT to a DataFrame; Catalyst plans the rest.

Every source's columns get names of their own (``_q<source>_<column>``), so tables of one name in
different schemas, and self-joins, stay apart. Spark answers IN with a subquery in two values
outside conditions; there it is spelled out with counts, which keeps the third.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, ValidationError
from ..functions import aggregate_column, scalar_column, spark_aggregate
from .nodes import Bound, ColumnRef, Compare, Excluded, Expression, Function, Logical, Membership, Not, NullTest, Scalar, Select, TableRef
from .render import name_of
from .schema import Kind
from .validate import bare_columns, children, has_aggregate, holds

Read = Callable[[TableRef], DataFrame]


def literal(value: Any, near: Expression | None = None) -> Column:
    """A bound value; text beside a decimal column becomes that column's decimal."""
    if isinstance(value, str) and isinstance(near, ColumnRef) and near.definition and near.definition.type.kind is Kind.DECIMAL:
        return F.lit(value).cast(near.definition.type.spark())
    if isinstance(value, bool) or value is None or isinstance(value, str | bytes | float | Decimal | datetime | date):
        return F.lit(value)
    if isinstance(value, int):
        if -(2**63) <= value < 2**63:
            return F.lit(value).cast("long")
        if abs(value) < 10**20:
            return F.lit(Decimal(value)).cast("decimal(20,0)")
    raise ValidationError("value", f"{value!r} cannot be bound")


def like_pattern(pattern: str) -> str:
    """A LIKE pattern for Spark: a backslash before an ordinary character says that character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            if i == len(pattern):
                raise ValidationError("like", "the pattern ends with an escape")
            c = ("\\" if pattern[i] in "%_\\" else "") + pattern[i]
        out.append(c)
        i += 1
    return "".join(out)


@dataclass
class Lowering:
    """Expressions to Columns, over sources with own column names; ``computed`` holds what earlier steps made."""

    read: Read
    names: dict[tuple[TableRef, str], str] = field(default_factory=dict)
    computed: dict[Expression, str] = field(default_factory=dict)
    excluded: dict[str, str] = field(default_factory=dict)

    def column(self, e: Expression, condition: bool = False, near: Expression | None = None) -> Column:
        """``condition``: the value is used as a condition, where NULL and false are alike."""
        if e in self.computed:
            return F.col(self.computed[e])
        match e:
            case ColumnRef():
                if (e.source, e.name) not in self.names:
                    raise QueryError(f"column {e.source.qualifier}.{e.name} must be grouped or aggregated")
                return F.col(self.names[e.source, e.name])
            case Excluded():
                return F.col(self.excluded[e.column.name])
            case Bound():
                return literal(e.value, near)
            case Compare(left, "LIKE", right):
                if isinstance(right, Bound) and isinstance(right.value, str):
                    return self.column(left).like(like_pattern(right.value))
                return F.like(self.column(left), self.column(right))
            case Compare(left, op, right):
                a, b = self.column(left, near=right), self.column(right, near=left)
                return {"=": a == b, "<>": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
            case Logical():
                return reduce(and_ if e.op == "AND" else or_, (self.column(x, condition) for x in e.operands))
            case Not():
                return ~self.column(e.operand, condition)
            case NullTest():
                x = self.column(e.operand)
                return x.isNotNull() if e.negated else x.isNull()
            case Membership():
                found = self._in_select(e, condition) if isinstance(e.members, Select) else self._in_list(e)
                return ~found if e.negated else found
            case Scalar():
                return lower(e.select, self.read).scalar()
            case Function():
                return self._function(e)
        raise ValidationError("expression", f"{e!r} cannot be lowered")

    def _in_list(self, e: Membership) -> Column:
        x = self.column(e.operand)
        if all(isinstance(m, Bound) and m.value is not None for m in e.members):
            return x.isin(*(self.column(m, near=e.operand) for m in e.members))
        return reduce(or_, (x == self.column(m, near=e.operand) for m in e.members))

    def _in_select(self, e: Membership, condition: bool) -> Column:
        x, members = self.column(e.operand), lower(e.members, self.read)
        members = members.toDF("_m")
        if condition:
            return x.isin(members)
        n = members.agg(F.count("*").alias("n")).scalar()
        nulls = members.agg((F.count("*") - F.count("_m")).alias("n")).scalar()
        return F.when(x.isin(members), True).when(n == 0, False).when(x.isNull() | (nulls > 0), F.lit(None).cast("boolean")).otherwise(False)

    def _function(self, e: Function) -> Column:
        if e.aggregates:
            raise QueryError(f"{e.name} has no group here")
        near = next((x for x in e.arguments if isinstance(x, ColumnRef)), None)
        arguments = [self.column(x, near=near) for x in e.arguments]
        if e.curated:
            return scalar_column(e.name, arguments)
        if not e.distinct:
            return F.call_function(e.name, *arguments)
        plain = [x for x in e.arguments if not isinstance(x, ColumnRef | Bound)]
        if plain:
            raise QueryError(f"{e.name}(DISTINCT ...) takes columns and values")
        said = [f"`{self.computed.get(x) or self.names[x.source, x.name]}`" if isinstance(x, ColumnRef) else _sql_literal(x.value) for x in e.arguments]
        return F.expr(f"{e.name}(DISTINCT {', '.join(said)})")


def _sql_literal(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "NULL" if value is None else str(value)


def constant(e: Expression) -> bool:
    """Whether it is the same for every row, so it orders nothing."""
    return not holds(e, lambda x: isinstance(x, ColumnRef | Scalar) or isinstance(x, Function) and (x.aggregates or not x.curated) or isinstance(x, Membership) and isinstance(x.members, Select))


def _aggregates(e: Expression) -> list[Function]:
    if isinstance(e, Function) and e.aggregates:
        return [e]
    return [f for c in children(e) for f in _aggregates(c)]


def _spark_aggregate(e: Expression) -> bool:
    return holds(e, lambda x: isinstance(x, Function) and not x.curated and spark_aggregate(x.name))


def lower(s: Select, read: Read) -> DataFrame:
    """The DataFrame of a SELECT. Nothing runs."""
    s.validate()
    sources = [s.source, *(j.source for j in s.joins)]
    names = {(t, c.name): f"_q{i}_{c.name}" for i, t in enumerate(sources) for c in t.definition.columns}
    at = Lowering(read, names)

    def scan(t: TableRef) -> DataFrame:
        return read(t).select(*(F.col(f"`{c.name}`").alias(names[t, c.name]) for c in t.definition.columns))

    df = scan(s.source)
    for join in s.joins:
        df = df.join(scan(join.source), at.column(join.on, condition=True), join.kind)
    if s.where is not None:
        df = df.where(at.column(s.where, condition=True))
    over = [p.expression for p in s.projections] + ([s.having] if s.having is not None else []) + [o.expression for o in s.order]
    if s.group_by or any(map(has_aggregate, over)):
        df, at = _grouped(s, df, at, over)
    titles = [p.alias or name_of(p.expression) for p in s.projections]
    order = [o for o in s.order if not constant(o.expression)]
    columns = [at.column(p.expression) for p in s.projections]
    if s.distinct:
        made = {p.expression: f"_p{i}" for i, p in enumerate(s.projections)}
        df = df.select(*(c.alias(f"_p{i}") for i, c in enumerate(columns))).distinct()
        at = Lowering(read, {}, made)
        for o in order:
            if o.expression not in made and bare_columns(o.expression, tuple(made)):
                raise QueryError("with DISTINCT, rows are ordered only by what is projected")
        df = _sorted(df, order, at)
        df = df.select(*(F.col(f"_p{i}").alias(t) for i, t in enumerate(titles)))
    else:
        df = _sorted(df, order, at)
        df = df.select(*(c.alias(t) for c, t in zip(columns, titles, strict=True)))
    if s.offset is not None:
        df = df.offset(s.offset)
    return df if s.limit is None else df.limit(s.limit)


def _sorted(df: DataFrame, order, at: Lowering) -> DataFrame:
    if not order:
        return df
    hidden = {f"_o{i}": at.column(o.expression) for i, o in enumerate(order)}
    subqueries = [holds(o.expression, lambda x: isinstance(x, Scalar) or isinstance(x, Membership) and isinstance(x.members, Select)) for o in order]
    df = df.withColumns({k: c for (k, c), sub in zip(hidden.items(), subqueries, strict=True) if sub}) if any(subqueries) else df
    keys = [F.col(k) if sub else c for (k, c), sub in zip(hidden.items(), subqueries, strict=True)]
    return df.orderBy(*(k.desc() if o.descending else k.asc() for k, o in zip(keys, order, strict=True)))


def _grouped(s: Select, df: DataFrame, at: Lowering, over: list[Expression]) -> tuple[DataFrame, Lowering]:
    """Keys and aggregate arguments are projected first, so anything may stand in them."""
    keys = {e: f"_g{i}" for i, e in enumerate(dict.fromkeys(s.group_by))}
    calls = list(dict.fromkeys(f for e in over for f in _aggregates(e)))
    arguments = {e: f"_x{i}" for i, e in enumerate(dict.fromkeys(f.arguments[0] for f in calls if not f.star))}
    extra = list(dict.fromkeys(e for e in over if _spark_aggregate(e)))
    carried = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys(c for e in extra for c in bare_columns(e)))}
    pre = [at.column(e).alias(n) for group in (keys, arguments, carried) for e, n in group.items()]
    df = df.select(*pre) if pre else df.select(F.lit(1).alias("_one"))
    made = {f: f"_a{i}" for i, f in enumerate(calls)}
    inside = Lowering(at.read, {}, dict(carried))
    results = [aggregate_column(f.name, None if f.star else arguments[f.arguments[0]], f.distinct).alias(n) for f, n in made.items()]
    results += [inside.column(e).alias(f"_e{i}") for i, e in enumerate(extra)]
    grouped = df.groupBy(*keys.values())
    df = grouped.agg(*results) if results else df.select(*keys.values()).distinct()
    after = Lowering(at.read, {}, keys | made | {e: f"_e{i}" for i, e in enumerate(extra)})
    if s.having is not None:
        df = df.where(after.column(s.having, condition=True))
    return df, after
