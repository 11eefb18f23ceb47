"""Settings of code generation that stay the same from run to run, read from a JSON file.

    {"out": "store.py", "queries_out": "queries.py", "include": ["users"], "exclude": null,
     "row_names": {"users": "Person"}, "queries": [{"function": "by_id", "file": "by_id.sql"}, {"function": "all", "sql": "..."}]}

Paths are relative to the file's folder. Every setting may be left out; unknown ones are refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

from ..errors import ValidationError
from ..plans.schema import TableDef
from ..plans.templates import Template, parse
from .emit import check_module, planned, query_module, store_module, write_module


@dataclass(frozen=True)
class Settings:
    root: Path = Path()
    out: str | None = None
    queries_out: str | None = None
    include: list[str] | None = None
    exclude: list[str] | None = None
    row_names: dict[str, str] | None = None
    queries: list[dict[str, str]] | None = None

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        path = Path(path)
        said: dict[str, Any] = json.loads(path.read_text())
        if unknown := sorted(set(said) - {f.name for f in fields(cls)} | set(said) & {"root"}):
            raise ValidationError(path.name, f"there is no setting {', '.join(unknown)}")
        return cls(root=path.parent, **said)

    def named(self, tables: Iterable[TableDef]) -> list[TableDef]:
        """The tables with the row classes that the settings name; a name for no table is refused."""
        names, tables = self.row_names or {}, list(tables)
        if unknown := sorted(set(names) - {t.key for t in tables}):
            raise ValidationError("row_names", f"there is no table {', '.join(unknown)}")
        return [replace(t, row_name=names[t.key]) if t.key in names else t for t in tables]

    def templates(self) -> list[Template]:
        out = []
        for q in self.queries or ():
            function = q.get("function", "")
            if not function.isidentifier() or ("file" in q) == ("sql" in q) or set(q) - {"function", "file", "sql"}:
                raise ValidationError("queries", f"a query has a function and either a file or sql, not {sorted(q)}")
            out.append(parse(function, q["sql"] if "sql" in q else (self.root / q["file"]).read_text()))
        if twice := sorted({t.name for t in out if [x.name for x in out].count(t.name) > 1}):
            raise ValidationError("queries", f"two queries make {', '.join(twice)}")
        return out

    def modules(self, tables: Iterable[TableDef]) -> dict[Path, str]:
        """The source of each module to generate."""
        if not self.out:
            raise ValidationError("generate", "no output is named")
        tables, templates = self.named(tables), self.templates()
        if templates and not self.queries_out:
            raise ValidationError("queries", "no output is named")
        made = {self.root / self.out: store_module(tables)}
        if templates:
            made[self.root / self.queries_out] = query_module(templates, tables)
        return made

    def write(self, tables: Iterable[TableDef]) -> list[Path]:
        """The modules that were written because they differed; none if one of the files was not generated."""
        if foreign := [str(path) for path, what in self.plan(tables).items() if what == "refuse"]:
            raise ValidationError("generate", f"{', '.join(foreign)} is there and was not generated")
        return [path for path, source in self.modules(tables).items() if write_module(path, source)]

    def plan(self, tables: Iterable[TableDef]) -> dict[Path, str]:
        """What ``write`` would do to each file; nothing is written."""
        return {path: planned(path, source) for path, source in self.modules(tables).items()}

    def check(self, tables: Iterable[TableDef]) -> bool:
        """Whether all modules are up to date."""
        return all(check_module(path, source) for path, source in self.modules(tables).items())
