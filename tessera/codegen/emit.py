"""Emitting modules: dataclasses and Table objects from descriptions, functions from templates."""

from __future__ import annotations

import keyword
from collections.abc import Iterable
from pathlib import Path

from ..errors import ValidationError
from ..plans.dialect import SPARK, Dialect
from ..plans.schema import ColumnDef, Kind, TableDef
from ..plans.templates import Template

_PYTHON = {Kind.BOOLEAN: "bool", Kind.INTEGER: "int", Kind.FLOAT: "float", Kind.TEXT: "str", Kind.BYTES: "bytes", Kind.TIME: "datetime.datetime", Kind.JSON: "str", Kind.UUID: "str", Kind.DECIMAL: "decimal.Decimal"}


def class_name(d: TableDef) -> str:
    if d.row_name:
        return d.row_name
    parts = d.name.split("_")
    last = parts[-1]
    if last.endswith("ies"):
        last = last[:-3] + "y"
    elif last.endswith("s") and not last.endswith("ss"):
        last = last[:-1]
    return "".join(p[:1].upper() + p[1:] for p in (*parts[:-1], last))


def _field(c: ColumnDef) -> str:
    kind = "UInt64" if c.type.unsigned else _PYTHON[c.type.kind]
    name = _attribute(c.name)
    meta = f" = dataclasses.field(metadata={{'column': {c.name!r}}})"
    return f"    {name}: {kind}{' | None' if c.nullable else ''}{meta}"


def _attribute(name: str) -> str:
    return f"{name}_" if keyword.iskeyword(name) else name


def _key(columns: tuple[str, ...]) -> str:
    """The key of a row ``x``: a value, or a tuple of several."""
    said = [f"x.{_attribute(c)}" for c in columns]
    return said[0] if len(said) == 1 else f"({', '.join(said)})"


def store_module(tables: Iterable[TableDef]) -> str:
    """A module with a row class, a description, a Table and relationship loaders for each table."""
    tables = sorted((t.validate() for t in tables), key=lambda t: t.key)
    names = [class_name(t) for t in tables]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValidationError("generate", f"two tables make the class {', '.join(sorted(twice))}")
    by_name = {t.name: t for t in tables}
    out = ['"""Row classes and tables; generated, do not edit."""', "", "import dataclasses", "import datetime", "import decimal", "import json", "", "from tessera.operators.builder import Table", "from tessera.operators.decode import UInt64", "from tessera.operators.relations import load_belongs_to, load_has_many", "from tessera.plans.schema import TableDef", ""]
    for t, name in zip(tables, names, strict=True):
        import json

        out += ["", "@dataclasses.dataclass(frozen=True)", f"class {name}:", f'    """A row of {t.key}."""', "", *(_field(c) for c in t.columns), "", "", f"{t.name} = Table(TableDef.from_json(json.loads({json.dumps(t.to_json())!r})), {name})", ""]
    for t in tables:
        for r in t.relationships:
            if r.table not in by_name:
                raise ValidationError("generate", f"{t.key}.{r.name}: there is no table {r.table}")
            loader = "load_has_many" if r.kind == "has_many" else "load_belongs_to"
            column = repr(r.references[0] if len(r.columns) == 1 else r.references)
            out += ["", f"def {t.name}_{r.name}(db, rows):", f'    """{r.kind} {r.table}, by key."""', f"    return {loader}(db, {r.table}, {column}, rows, lambda x: {_key(r.columns)}, lambda x: {_key(r.references)})", ""]
    return "\n".join(out) + "\n"


def query_module(templates: Iterable[Template], tables: Iterable[TableDef] = (), dialect: Dialect = SPARK) -> str:
    """A module with a function for each template."""
    known = {t.key: t for t in tables}
    body = [t.compile(dialect).python_source(known) for t in sorted(templates, key=lambda t: t.name)]
    return "\n".join(['"""Queries; generated, do not edit."""', "", "import datetime", "import decimal", "", "from tessera.plans.render import Statement, precompiled", "", "", *body])


def planned(path: str | Path, source: str) -> str:
    """What writing a module would do: ``create``, ``update``, ``keep``, or ``refuse`` where the file is not a generated one."""
    path = Path(path)
    if not path.exists():
        return "create"
    have = path.read_text()
    if have == source:
        return "keep"
    return "update" if "generated, do not edit" in have.partition("\n")[0] else "refuse"


def write_module(path: str | Path, source: str) -> bool:
    """Write a module if it differs; whether it did. A file that was not generated is never written over."""
    path = Path(path)
    compile(source, str(path), "exec")
    what = planned(path, source)
    if what == "refuse":
        raise ValidationError("generate", f"{path} is there and was not generated")
    if what == "keep":
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(source)
    return True


def check_module(path: str | Path, source: str) -> bool:
    """Whether a written module is up to date."""
    return Path(path).exists() and Path(path).read_text() == source
