"""What a statement may say, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import ValidationError
from ..functions import CURATED
from .nodes import Bound, ColumnRef, Compare, Delete, Excluded, Expression, Function, Insert, Logical, Membership, Not, NullTest, OPERATORS, Scalar, Select, TableRef, Update, Upsert, Write
from .schema import check_name


@dataclass(frozen=True)
class Place:
    """Where an expression stands and what may stand there."""

    sources: tuple[TableRef, ...]
    aggregates: bool = False
    inside_aggregate: bool = False
    subqueries: bool = True
    columns: bool = True
    excluded: TableRef | None = None


def children(e: Expression) -> tuple[Expression, ...]:
    """The direct operands of an expression; subqueries are closed."""
    match e:
        case Compare():
            return (e.left, e.right)
        case Logical():
            return e.operands
        case Not() | NullTest():
            return (e.operand,)
        case Membership():
            return (e.operand, *(e.members if isinstance(e.members, tuple) else ()))
        case Function():
            return e.arguments
    return ()


def holds(e: Expression, test) -> bool:
    return test(e) or any(holds(c, test) for c in children(e))


def has_aggregate(e: Expression) -> bool:
    return holds(e, lambda x: isinstance(x, Function) and x.aggregates)


def bare_columns(e: Expression, keys: tuple[Expression, ...] = ()) -> list[ColumnRef]:
    """Columns outside aggregates and outside the given keys."""
    if e in keys or isinstance(e, Function) and e.aggregates:
        return []
    return [e] if isinstance(e, ColumnRef) else [c for x in children(e) for c in bare_columns(x, keys)]


def check(e: Expression, path: str, at: Place) -> None:
    match e:
        case ColumnRef():
            if not at.columns:
                raise ValidationError(path, "the values may not read columns of the target")
            if e.source not in at.sources:
                raise ValidationError(path, f"{e.source.qualifier}.{e.name} comes from no table of the statement")
            if e.definition is None:
                raise ValidationError(path, f"{e.source.qualifier} has no column {e.name}")
        case Excluded():
            if at.excluded is None or e.column.source != at.excluded:
                raise ValidationError(path, "EXCLUDED stands only in an upsert's assignments")
        case Bound():
            pass
        case Compare():
            if e.op not in OPERATORS:
                raise ValidationError(path, f"unknown operator {e.op!r}")
            check(e.left, f"{path}.left", at)
            check(e.right, f"{path}.right", at)
        case Logical():
            if e.op not in ("AND", "OR") or len(e.operands) < 2:
                raise ValidationError(path, "AND and OR take two operands or more")
            for i, x in enumerate(e.operands):
                check(x, f"{path}.{e.op.lower()}[{i}]", at)
        case Not() | NullTest():
            check(e.operand, f"{path}.operand", at)
        case Membership():
            check(e.operand, f"{path}.operand", at)
            if isinstance(e.members, Select):
                _subquery(e.members, f"{path}.members", at)
            else:
                if not e.members:
                    raise ValidationError(path, "an IN list has members")
                for i, x in enumerate(e.members):
                    if holds(x, lambda y: isinstance(y, Scalar)):
                        raise ValidationError(f"{path}.members[{i}]", "an IN list holds no subquery")
                    check(x, f"{path}.members[{i}]", at)
        case Scalar():
            _subquery(e.select, path, at)
        case Function():
            _function(e, path, at)
        case _:
            raise ValidationError(path, f"{e!r} is no expression")


def _subquery(select: Select, path: str, at: Place) -> None:
    if not at.subqueries:
        raise ValidationError(path, "a subquery stands only in the clauses of a SELECT")
    if len(select.projections) != 1:
        raise ValidationError(path, "a subquery used as an expression projects exactly one expression")
    try:
        validate_select(select)
    except ValidationError as err:
        raise ValidationError(f"{path}.{err.path}", err.message) from err


def _function(e: Function, path: str, at: Place) -> None:
    check_name(path, e.name)
    if e.curated and e.name not in CURATED:
        raise ValidationError(path, f"{e.name} is not curated")
    if e.star:
        if e.name != "COUNT" or not e.curated or e.arguments:
            raise ValidationError(path, "only COUNT takes *")
        if e.distinct:
            raise ValidationError(path, "COUNT(DISTINCT *) is refused")
    if e.aggregates:
        if at.inside_aggregate:
            raise ValidationError(path, "an aggregate stands inside another")
        if not at.aggregates:
            raise ValidationError(path, f"{e.name} may not stand here")
        at = replace(at, inside_aggregate=True)
    elif e.curated and e.distinct:
        raise ValidationError(path, f"{e.name} takes no DISTINCT")
    if e.curated and not e.star:
        least, most = CURATED[e.name]
        if len(e.arguments) < least or most is not None and len(e.arguments) > most:
            raise ValidationError(path, f"{e.name} doesn't take {len(e.arguments)} arguments")
    if not e.curated and e.distinct and not e.arguments:
        raise ValidationError(path, "DISTINCT needs an argument")
    for i, x in enumerate(e.arguments):
        check(x, f"{path}.{e.name}[{i}]", at)


def check_sources(sources: list[TableRef], path: str) -> None:
    """No table twice, and no two names that read alike."""
    for i, one in enumerate(sources):
        if one.definition.name == "" or one.alias == "":
            raise ValidationError(path, "a table has a name")
        one.definition.validate()
        for other in sources[:i]:
            if one.identity == other.identity:
                raise ValidationError(path, f"{one.qualifier} stands twice; give one an alias")
            apart = not one.alias and not other.alias and one.definition.schema and other.definition.schema
            if one.qualifier == other.qualifier and not apart:
                raise ValidationError(path, f"two tables are called {one.qualifier}")


def validate_select(s: Select) -> None:
    sources = [s.source]
    check_sources(sources, "from")
    for i, join in enumerate(s.joins):
        if join.kind not in ("inner", "left"):
            raise ValidationError(f"join[{i}]", f"unknown join {join.kind!r}")
        sources.append(join.source)
        check_sources(sources, f"join[{i}]")
        check(join.on, f"join[{i}].on", Place(tuple(sources)))
    at = Place(tuple(sources))
    for i, e in enumerate(s.group_by):
        if isinstance(e, Bound):
            raise ValidationError(f"group_by[{i}]", "a bare value groups nothing")
        if has_aggregate(e):
            raise ValidationError(f"group_by[{i}]", "an aggregate is no group key")
        check(e, f"group_by[{i}]", at)
    if not s.projections:
        raise ValidationError("projections", "a SELECT projects something")
    over = replace(at, aggregates=True)
    for i, p in enumerate(s.projections):
        if p.alias is not None:
            check_name(f"projections[{i}].alias", p.alias)
        check(p.expression, f"projections[{i}]", over)
    some = any(has_aggregate(p.expression) for p in s.projections)
    if not s.group_by and some:
        for i, p in enumerate(s.projections):
            if bare_columns(p.expression):
                raise ValidationError(f"projections[{i}]", "without GROUP BY, aggregates and bare columns don't mix")
    one_group = not s.group_by and some
    if s.where is not None:
        check(s.where, "where", at)
    if s.having is not None:
        if not s.group_by and not some:
            raise ValidationError("having", "HAVING needs GROUP BY or aggregating projections")
        check(s.having, "having", over)
        if one_group and bare_columns(s.having):
            raise ValidationError("having", "a bare column stands beside aggregates")
    for i, o in enumerate(s.order):
        if has_aggregate(o.expression) and not (s.group_by or some):
            raise ValidationError(f"order[{i}]", "an aggregate orders only grouped rows")
        check(o.expression, f"order[{i}]", over)
        if one_group and bare_columns(o.expression):
            raise ValidationError(f"order[{i}]", "a bare column stands beside aggregates")
    for name in ("limit", "offset"):
        n = getattr(s, name)
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
            raise ValidationError(name, "it is a number of rows, 0 or more")


def _target(table: TableRef, path: str) -> None:
    table.definition.validate()
    if table.alias is not None:
        raise ValidationError(path, "the table that is written has no alias")


def _own(column: ColumnRef, table: TableRef, path: str) -> None:
    if column.source != table:
        raise ValidationError(path, f"{column.name} is a column of another table")
    if column.definition is None:
        raise ValidationError(path, f"there is no column {column.name}")


def _assignments(table: TableRef, assignments, at: Place, path: str) -> None:
    seen = set()
    for i, a in enumerate(assignments):
        own = f"{path}[{i}]"
        _own(a.column, table, own)
        if a.column.name in seen:
            raise ValidationError(own, f"{a.column.name} is set twice")
        seen.add(a.column.name)
        if not a.column.definition.writable:
            raise ValidationError(own, f"{a.column.name} is computed by the table")
        check(a.value, own, at)


def _rows_chosen(w: Update | Delete, at: Place) -> None:
    if w.where is None and not w.all_rows:
        raise ValidationError("where", "writing all rows must be said")
    if w.where is not None and w.all_rows:
        raise ValidationError("where", "a condition and all rows contradict each other")
    if w.where is not None:
        check(w.where, "where", at)


def _returning(w: Write, table: TableRef) -> None:
    for i, p in enumerate(w.returning):
        if p.alias is not None:
            check_name(f"returning[{i}].alias", p.alias)
        check(p.expression, f"returning[{i}]", Place((table,), subqueries=False))


def validate_write(w: Write) -> None:
    match w:
        case Insert():
            _target(w.into, "into")
            if w.default_values:
                if w.columns or w.rows:
                    raise ValidationError("values", "default values stand alone")
            else:
                _insert_rows(w)
            _returning(w, w.into)
        case Update():
            _target(w.table, "table")
            if not w.assignments:
                raise ValidationError("set", "an update sets something")
            at = Place((w.table,), subqueries=False)
            _assignments(w.table, w.assignments, at, "set")
            _rows_chosen(w, at)
            _returning(w, w.table)
        case Delete():
            _target(w.table, "table")
            _rows_chosen(w, Place((w.table,), subqueries=False))
            _returning(w, w.table)
        case Upsert():
            validate_write(w.insert)
            if w.insert.returning:
                raise ValidationError("returning", "it belongs to the upsert, not to its insert")
            if not w.conflict and not w.assignments:
                raise ValidationError("conflict", "an upsert names its conflict or sets something")
            names = set()
            for i, c in enumerate(w.conflict):
                _own(c, w.insert.into, f"conflict[{i}]")
                if c.name in names:
                    raise ValidationError(f"conflict[{i}]", f"{c.name} stands twice")
                names.add(c.name)
            into = w.insert.into
            _assignments(into, w.assignments, Place((into,), subqueries=False, excluded=into), "set")
            _returning(w, into)
        case _:
            raise ValidationError("statement", f"{w!r} writes nothing")


def _insert_rows(w: Insert) -> None:
    if not w.columns or not w.rows:
        raise ValidationError("values", "an insert names columns and rows")
    seen = set()
    for i, c in enumerate(w.columns):
        _own(c, w.into, f"columns[{i}]")
        if c.name in seen:
            raise ValidationError(f"columns[{i}]", f"{c.name} stands twice")
        seen.add(c.name)
        if not c.definition.writable:
            raise ValidationError(f"columns[{i}]", f"{c.name} is computed by the table")
    at = Place((w.into,), subqueries=False, columns=False)
    for i, row in enumerate(w.rows):
        if len(row) != len(w.columns):
            raise ValidationError(f"rows[{i}]", f"it has {len(row)} values for {len(w.columns)} columns")
        for j, e in enumerate(row):
            check(e, f"rows[{i}][{j}]", at)
