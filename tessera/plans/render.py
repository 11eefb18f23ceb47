"""Statements as SQL text with bound arguments, in the order in which they stand in the text."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..errors import CapabilityError, ValidationError
from .dialect import SPARK, Can, Dialect
from .nodes import Bound, ColumnRef, Compare, Delete, Excluded, Expression, Function, Insert, Logical, Membership, Not, NullTest, Projection, Scalar, Select, TableRef, Update, Upsert, Write
from .schema import Action, ForeignKeyDef, Identity, TableDef


@dataclass(frozen=True)
class Statement:
    sql: str
    args: tuple[Any, ...] = ()


def precompiled(sql: str, *args: Any) -> Statement:
    """Trusted SQL text as it is."""
    if not sql.strip():
        raise ValidationError("sql", "the text is empty")
    return Statement(sql, args)


class Renderer:
    def __init__(self, dialect: Dialect):
        self.dialect, self.out, self.args = dialect, [], []

    def statement(self) -> Statement:
        most = self.dialect.max_parameters
        if most is not None and len(self.args) > most:
            raise CapabilityError(f"{self.dialect.name} binds at most {most} values, not {len(self.args)}")
        return Statement("".join(self.out), tuple(self.args))

    def say(self, *parts: str) -> None:
        self.out += parts

    def bound(self, value: Any) -> None:
        self.args.append(value)
        self.say(self.dialect.placeholder(len(self.args)))

    def name(self, name: str) -> str:
        return self.dialect.identifier(name)

    def table(self, t: TableRef) -> None:
        self.say(self.name(t.definition.schema) + "." if t.definition.schema else "", self.name(t.definition.name))
        if t.alias:
            self.say(" AS ", self.name(t.alias))

    def listed(self, items, each, between: str = ", ") -> None:
        for i, x in enumerate(items):
            if i:
                self.say(between)
            each(x)

    def column(self, c: ColumnRef, bare: bool = False) -> None:
        if not bare:
            t = c.source
            self.say(self.name(t.definition.schema) + "." if t.definition.schema and not t.alias else "", self.name(t.qualifier), ".")
        self.say(self.name(c.name))

    def expression(self, e: Expression, bare: bool = False) -> None:
        match e:
            case ColumnRef():
                self.column(e, bare)
            case Excluded():
                self.say("VALUES(" if self.dialect.name == "mysql" else "EXCLUDED.", self.name(e.column.name), ")" if self.dialect.name == "mysql" else "")
            case Bound():
                self.bound(e.value)
            case Compare():
                self.say("(")
                self.expression(e.left, bare)
                self.say(f" {e.op} ")
                self.expression(e.right, bare)
                self.say(")")
            case Logical():
                self.say("(")
                self.listed(e.operands, lambda x: self.expression(x, bare), f" {e.op} ")
                self.say(")")
            case Not():
                self.say("(NOT ")
                self.expression(e.operand, bare)
                self.say(")")
            case NullTest():
                self.say("(")
                self.expression(e.operand, bare)
                self.say(" IS NOT NULL)" if e.negated else " IS NULL)")
            case Membership():
                self.say("(")
                self.expression(e.operand, bare)
                self.say(" NOT IN (" if e.negated else " IN (")
                if isinstance(e.members, Select):
                    if e.members.limit is not None or e.members.offset is not None:
                        self.dialect.require(Can.LIMIT_IN_MEMBERSHIP, "LIMIT or OFFSET in an IN subquery")
                    self.select(e.members)
                else:
                    self.listed(e.members, lambda x: self.expression(x, bare))
                self.say("))")
            case Scalar():
                self.say("(")
                self.select(e.select)
                self.say(")")
            case Function():
                self.say(e.name, "(", "DISTINCT " if e.distinct else "", "*" if e.star else "")
                self.listed(e.arguments, lambda x: self.expression(x, bare))
                self.say(")")

    def projection(self, p: Projection, bare: bool = False) -> None:
        self.expression(p.expression, bare)
        if p.alias:
            self.say(" AS ", self.name(p.alias))

    def select(self, s: Select) -> None:
        self.say("SELECT ", "DISTINCT " if s.distinct else "")
        self.listed(s.projections, self.projection)
        self.say(" FROM ")
        self.table(s.source)
        for j in s.joins:
            self.say(f" {j.kind.upper()} JOIN ")
            self.table(j.source)
            self.say(" ON ")
            self.expression(j.on)
        if s.where is not None:
            self.say(" WHERE ")
            self.expression(s.where)
        if s.group_by:
            self.say(" GROUP BY ")
            self.listed(s.group_by, self.expression)
        if s.having is not None:
            self.say(" HAVING ")
            self.expression(s.having)
        if s.order:
            self.say(" ORDER BY ")
            self.listed(s.order, lambda o: (self.expression(o.expression), self.say(" DESC" if o.descending else " ASC")))
        if s.limit is not None:
            self.say(" LIMIT ")
            self.bound(s.limit)
        elif s.offset is not None and Can.OFFSET_WITHOUT_LIMIT not in self.dialect.can:
            self.say(f" LIMIT {self.dialect.endless}")
        if s.offset is not None:
            self.say(" OFFSET ")
            self.bound(s.offset)

    def returning(self, w: Write) -> None:
        if w.returning:
            self.dialect.require(Can.RETURNING, "RETURNING")
            self.say(" RETURNING ")
            self.listed(w.returning, lambda p: self.projection(p, bare=True))

    def insert(self, w: Insert, upsert: bool = False) -> None:
        self.say("INSERT INTO ")
        self.table(w.into)
        if w.default_values:
            if upsert:
                self.dialect.require(Can.DEFAULT_VALUES_UPSERT, "upsert of default values")
            self.say(" () VALUES ()" if self.dialect.name == "mysql" else " DEFAULT VALUES")
            return
        self.say(" (", ", ".join(self.name(c.name) for c in w.columns), ") VALUES ")

        def row(values):
            self.say("(")
            self.listed(values, lambda x: self.expression(x, bare=True))
            self.say(")")

        self.listed(w.rows, row)

    def assignments(self, w: Update | Upsert) -> None:
        def one(a):
            self.say(self.name(a.column.name), " = ")
            self.expression(a.value, bare=not isinstance(w, Upsert))

        self.listed(w.assignments, one)

    def write(self, w: Write) -> None:
        match w:
            case Insert():
                self.insert(w)
            case Update():
                self.say("UPDATE ")
                self.table(w.table)
                self.say(" SET ")
                self.assignments(w)
                self.where(w)
            case Delete():
                self.say("DELETE FROM ")
                self.table(w.table)
                self.where(w)
            case Upsert():
                self.upsert(w)
        self.returning(w)

    def where(self, w: Update | Delete) -> None:
        if w.where is not None:
            self.say(" WHERE ")
            self.expression(w.where, bare=True)

    def upsert(self, w: Upsert) -> None:
        self.insert(w.insert, upsert=True)
        if Can.DUPLICATE_KEY_UPDATE in self.dialect.can:
            # its clause answers to every key, so it can neither keep to one nor leave rows as they are
            if w.conflict:
                raise CapabilityError(f"{self.dialect.name} cannot name the conflict of an upsert")
            if not w.assignments:
                raise CapabilityError(f"{self.dialect.name} has no upsert that sets nothing")
            self.say(" ON DUPLICATE KEY UPDATE ")
            self.assignments(w)
            return
        self.dialect.require(Can.CONFLICT_TARGET, "ON CONFLICT")
        if w.assignments and not w.conflict:
            raise CapabilityError(f"{self.dialect.name} updates only on a named conflict")
        self.say(" ON CONFLICT")
        if w.conflict:
            self.say(" (", ", ".join(self.name(c.name) for c in w.conflict), ")")
        if w.assignments:
            self.say(" DO UPDATE SET ")
            self.assignments(w)
        else:
            self.say(" DO NOTHING")


def render(statement: Select | Write, dialect: Dialect = SPARK) -> Statement:
    """The text of a statement, validated again."""
    statement.validate()
    r = Renderer(dialect)
    r.select(statement) if isinstance(statement, Select) else r.write(statement)
    return r.statement()


def name_of(e: Expression) -> str:
    """The result name of a projection without an alias."""
    if isinstance(e, ColumnRef):
        return e.name
    r = Renderer(SPARK)
    r.expression(e)
    return r.statement().sql


def create_table(d: TableDef, dialect: Dialect = SPARK) -> list[Statement]:
    """CREATE TABLE and its indexes; facts that the dialect cannot say are refused, never dropped."""
    d.validate()
    q = dialect.identifier
    if d.exclusions:
        raise CapabilityError(f"{d.key}: exclusion constraints can be described but not created")
    lines = []
    for c in d.columns:
        said = [q(c.name), dialect.type_name(c.type)]
        if c.identity:
            if dialect.name == "mysql":
                said.append("AUTO_INCREMENT")
            elif dialect.name != "sqlite":
                dialect.require(Can.IDENTITY, "identity columns")
                said.append(f"GENERATED {'ALWAYS' if c.identity is Identity.ALWAYS else 'BY DEFAULT'} AS IDENTITY")
        if c.generated is not None:
            said.append(f"GENERATED ALWAYS AS ({c.generated}) {'STORED' if c.stored else 'VIRTUAL'}")
        if not c.nullable:
            said.append("NOT NULL")
        if c.default is not None:
            said.append(f"DEFAULT {c.default}")
        lines.append(" ".join(said))
    full = dialect is not SPARK
    if not full and (d.primary_key or d.uniques or d.checks or d.foreign_keys):
        raise CapabilityError(f"{d.key}: Spark's file tables take no constraints; the table store does")
    if d.primary_key:
        lines.append(f"PRIMARY KEY ({', '.join(map(q, d.primary_key))})")
    for u in d.uniques:
        lines.append((f"CONSTRAINT {q(u.name)} " if u.name else "") + f"UNIQUE ({', '.join(map(q, u.columns))})")
    for k in d.checks:
        lines.append((f"CONSTRAINT {q(k.name)} " if k.name else "") + f"CHECK ({k.expression})")
    for f in d.foreign_keys:
        lines.append(_foreign_key(f, q))
    table = (q(d.schema) + "." if d.schema else "") + q(d.name)
    out = [Statement(f"CREATE TABLE {table} ({', '.join(lines)})")]
    for i in d.indexes:
        if i.predicate is not None:
            dialect.require(Can.PARTIAL_INDEX, "partial indexes")
        if not full:
            raise CapabilityError(f"{d.key}: Spark has no indexes")
        where = f" WHERE {i.predicate}" if i.predicate is not None else ""
        out.append(Statement(f"CREATE {'UNIQUE ' if i.unique else ''}INDEX {q(d.constraint_name(i))} ON {table} ({', '.join(map(q, i.columns))}){where}"))
    return out


def _foreign_key(f: ForeignKeyDef, q) -> str:
    there = (q(f.schema) + "." if f.schema else "") + q(f.table)
    said = (f"CONSTRAINT {q(f.name)} " if f.name else "") + f"FOREIGN KEY ({', '.join(map(q, f.columns))}) REFERENCES {there} ({', '.join(map(q, f.references))})"
    for what, action in (("DELETE", f.on_delete), ("UPDATE", f.on_update)):
        if action is not Action.NO_ACTION:
            said += f" ON {what} {action.upper()}"
    return said
