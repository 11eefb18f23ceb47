"""Command line: migrations and code generation for a store.

    python -m tessera.cli --store DIR status|plan|apply|revert|verify --migrations DIR [--through ID] [--steps N]
    python -m tessera.cli --store DIR diff --schema FILE.json|FILE.sql --migrations DIR --id ID --name NAME
    python -m tessera.cli --store DIR diff-live --schema FILE.json|FILE.sql
    python -m tessera.cli --store DIR dump [--dialect postgresql|mysql|sqlite]
    python -m tessera.cli --store DIR generate [--settings FILE.json] [--out FILE.py] [--check]
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from .codegen.settings import Settings
from .errors import TesseraError, ValidationError
from .migrations import Runner, diff_schemas, load_directory, write_migration
from .migrations.diff import topological
from .migrations.runner import State
from .plans.ddl import parse_ddl
from .plans.dialect import DIALECTS
from .plans.render import create_table
from .plans.schema import TableDef
from .sources.catalog import HISTORY, StoreInspector, sweep
from .sources.store import Store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--store", required=True)
    p.add_argument("verb", choices="status plan apply revert verify diff diff-live dump generate".split())
    for name in ("migrations", "schema", "id", "name", "through", "out", "settings", "dialect"):
        p.add_argument(f"--{name}")
    p.add_argument("--steps", type=int)
    p.add_argument("--check", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    store = Store(spark, a.store)
    try:
        return _run(a, store)
    except TesseraError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _live(store: Store, include: list[str] | None = None, exclude: list[str] | None = None) -> list[TableDef]:
    inspector = StoreInspector(store)
    if include is None and exclude is None and set(inspector.table_names()) <= {HISTORY}:
        return []
    return sweep(inspector, include, exclude)


def _desired(path: str) -> list[TableDef]:
    """The tables of a JSON file, or of DDL text in a file that ends in .sql."""
    text = Path(path).read_text()
    return parse_ddl(text) if path.endswith(".sql") else [TableDef.from_json(x) for x in json.loads(text)]


def _run(a: argparse.Namespace, store: Store) -> int:
    runner = Runner(store)
    if a.verb == "dump" and a.dialect:
        if a.dialect not in DIALECTS:
            raise ValidationError("dialect", f"there is no dialect {a.dialect}")
        for t in topological(_live(store)):
            for said in create_table(t, DIALECTS[a.dialect]):
                print(f"{said.sql};")
        return 0
    if a.verb == "diff-live":
        # what a migration would change; nothing is written
        desired = _desired(a.schema)
        for change in diff_schemas(_live(store), desired):
            for step, what in change.up.items():
                if step in ("create_table", "add_columns", "add_indexes"):
                    print(step, TableDef.from_json(what).key if step == "create_table" else what)
        return 0
    if a.verb == "dump":
        print(json.dumps([t.to_json() for t in topological(_live(store))], indent=2))
        return 0
    if a.verb == "generate":
        how = Settings.load(a.settings) if a.settings else Settings()
        if a.out:
            how = replace(how, out=str(Path(a.out).absolute()))
        tables = _live(store, how.include, how.exclude)
        if a.check:
            return 0 if how.check(tables) else 1
        for path in how.write(tables):
            print(path)
        return 0
    if a.verb == "diff":
        desired = _desired(a.schema)
        print(write_migration(a.migrations, a.id, a.name or "change", diff_schemas(_live(store), desired)))
        return 0
    migrations = load_directory(a.migrations)
    if a.verb in ("status", "verify"):
        states = runner.status(migrations)
        for i, s in states:
            print(f"{i}\t{s}")
        return int(a.verb == "verify" and any(s is not State.APPLIED for _, s in states))
    if a.verb == "plan":
        done = [m.id for m in runner.plan(migrations, a.through)]
    elif a.verb == "apply":
        done = runner.apply(migrations, a.through)
    else:
        done = runner.revert(migrations, a.steps, a.through)
    print("\n".join(done))
    return 0


if __name__ == "__main__":
    sys.exit(main())
