"""SQL texts with named, bound values: ``SELECT ... WHERE id = {{bind "id"}}``.

The only action is ``bind "name"``, with a column after it where the value's type is to be told:
``{{bind "id" users.id}}``, or ``{{bind "id" app.users.id}}`` for a table of a schema.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from ..errors import ValidationError
from .dialect import SPARK, Dialect
from .render import Statement, precompiled
from .schema import Kind, TableDef

_ACTION = re.compile(r"\{\{(.*?)\}\}", re.S)
_BIND = re.compile(r'\s*bind\s+"([A-Za-z_][A-Za-z0-9_]*)"(?:\s+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\.([A-Za-z_][A-Za-z0-9_]*))?\s*\Z')
_PYTHON = {Kind.BOOLEAN: "bool", Kind.INTEGER: "int", Kind.FLOAT: "float", Kind.TEXT: "str", Kind.BYTES: "bytes", Kind.TIME: "datetime.datetime", Kind.JSON: "str", Kind.UUID: "str", Kind.DECIMAL: "decimal.Decimal"}


@dataclass(frozen=True)
class Template:
    """Text pieces, and between them the names that are bound."""

    name: str
    pieces: tuple[str, ...]
    binds: tuple[str, ...]
    typed: tuple[tuple[str, str, str], ...] = ()

    @property
    def parameters(self) -> tuple[str, ...]:
        """Each name once, in order."""
        return tuple(dict.fromkeys(self.binds))

    def compile(self, dialect: Dialect = SPARK) -> Compiled:
        seen: dict[str, int] = {}
        out, order = [self.pieces[0]], []
        for name, piece in zip(self.binds, self.pieces[1:], strict=True):
            if dialect.numbered and name in seen:
                out.append(dialect.placeholder(seen[name]))
            else:
                order.append(name)
                seen[name] = len(order)
                out.append(dialect.placeholder(len(order)))
            out.append(piece)
        return Compiled(self, dialect, "".join(out), tuple(order))


@dataclass(frozen=True)
class Compiled:
    template: Template
    dialect: Dialect
    sql: str
    order: tuple[str, ...]

    def bind(self, values: dict[str, Any]) -> Statement:
        """All names must have a value, and all values a name."""
        wanted = set(self.template.parameters)
        if missing := sorted(wanted - set(values)):
            raise ValidationError(self.template.name, f"no value for {', '.join(missing)}")
        if unused := sorted(set(values) - wanted):
            raise ValidationError(self.template.name, f"nothing binds {', '.join(unused)}")
        return precompiled(self.sql, *(values[n] for n in self.order))

    def python_source(self, tables: dict[str, TableDef], function: str | None = None) -> str:
        """A function with an annotated parameter a name; every name needs a typed bind of one type.

        ``tables`` go by name, or by schema and name like ``app.users``.
        """
        types: dict[str, str] = {}
        for name, table, column in self.template.typed:
            d = tables.get(table)
            c = d.column(column) if d else None
            if c is None:
                raise ValidationError(self.template.name, f"there is no column {table}.{column}")
            said = _PYTHON[c.type.kind] + (" | None" if c.nullable else "")
            if types.setdefault(name, said) != said:
                raise ValidationError(self.template.name, f"{name} is bound with two types")
        if untyped := [n for n in self.template.parameters if n not in types]:
            raise ValidationError(self.template.name, f"no type for {', '.join(untyped)}")
        head = ", ".join(f"{n}: {types[n]}" for n in self.template.parameters)
        args = "".join(f", {n}" for n in self.order)
        return f"def {function or self.template.name}({head}) -> Statement:\n    return precompiled({self.sql!r}{args})\n"


def parse(name: str, source: str) -> Template:
    pieces, binds, typed, at = [], [], [], 0
    for m in _ACTION.finditer(source):
        found = _BIND.match(m[1])
        if not found:
            raise ValidationError(name, f"only bind actions are allowed, not {m[0]!r}")
        pieces.append(source[at : m.start()])
        binds.append(found[1])
        if found[2]:
            typed.append((found[1], found[2], found[3]))
        at = m.end()
    rest = source[at:]
    for piece in (*pieces, rest):
        if "{{" in piece or "}}" in piece:
            raise ValidationError(name, "an action isn't closed")
    if not source.strip():
        raise ValidationError(name, "the text is empty")
    return Template(name, (*pieces, rest), tuple(binds), tuple(typed))
