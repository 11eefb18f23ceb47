"""SQL steps of migrations, run inside their transaction.

Spark parses a step. INSERT, UPDATE and DELETE become writes of the transaction, under the same
constraints as all others; queries run and are forgotten, so that a wrong one stops the migration;
anything else is refused, since it would write past the transaction. Tables are read as views, those
of a schema as `schema.name` in backticks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MigrationError, ValidationError
from ..operators.database import Database
from ..operators.writes import insert_frame, remove, rewrite
from ..plans.schema import TableDef
from ..sources.store import Transaction

_PIECE = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|`[^`]*(?:`|\Z)|;|[^-/'\"`;]+|.", re.S)
_QUERY = re.compile(r"(?:\(|\s)*(?:SELECT|WITH|VALUES|TABLE|FROM)\b", re.I)
_WRITES = frozenset(("InsertIntoStatement", "UpdateTable", "DeleteFromTable", "MergeIntoTable"))
_SUBQUERY = re.compile(r"subquery|exists\(|\blistquery", re.I)


def split_statements(text: str) -> list[str]:
    """The statements of a text; semicolons in literals, names and comments part nothing, and comments go."""
    out = [""]
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece == ";":
            out.append("")
        elif piece.startswith(("--", "/*")):
            out[-1] += " "
        else:
            out[-1] += piece
    return [x.strip() for x in out if x.strip()]


@contextmanager
def _views(tx: Transaction) -> Iterator[None]:
    """The tables as they are in the transaction now."""
    keys = [d.key for d in tx.definitions()]
    for d in tx.definitions():
        tx.read(d).createOrReplaceTempView(f"`{d.key}`")
    try:
        yield
    finally:
        for key in keys:
            tx.spark.catalog.dropTempView(key)


def run_sql(tx: Transaction, text: str) -> None:
    for one in split_statements(text):
        with _views(tx):
            _run(tx, one)


def _run(tx: Transaction, sql: str) -> None:
    spark = tx.spark
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kind = plan.getClass().getSimpleName()
    if kind == "InsertIntoStatement":
        if plan.overwrite() or plan.partitionSpec().nonEmpty():
            raise MigrationError("only plain INSERT INTO runs in a migration")
        d, _ = _target(tx, plan.table())
        dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
        rows = DataFrame(dataset.ofRows(spark._jsparkSession, plan.query()), spark)
        names = [plan.userSpecifiedCols().apply(i) for i in range(plan.userSpecifiedCols().size())] or [c.name for c in d.columns if c.writable]
        if len(names) != len(rows.columns):
            raise ValidationError("columns", f"{len(rows.columns)} values for {len(names)} columns")
        insert_frame(Database(spark, tx.store, transaction=tx), d, rows.toDF(*names))
    elif kind == "UpdateTable":
        d, said = _target(tx, plan.table())
        values = {}
        for i in range(plan.assignments().size()):
            name = _text(plan.assignments().apply(i).key(), said).strip("`")
            c = d.column(name)
            if c is None or not c.writable:
                raise ValidationError("set", f"{name} cannot be written")
            values[name] = F.expr(_text(plan.assignments().apply(i).value(), said)).cast(c.type.spark())
        chosen = F.expr(_text(plan.condition().get(), said)) if plan.condition().isDefined() else F.lit(True)
        rewrite(tx, d, F.coalesce(chosen, F.lit(False)), values)
    elif kind == "DeleteFromTable":
        d, said = _target(tx, plan.table())
        remove(tx, d, F.coalesce(F.expr(_text(plan.condition(), said)), F.lit(False)))
    elif _QUERY.match(sql) and kind != "UnresolvedWith" or kind == "UnresolvedWith" and plan.child().getClass().getSimpleName() not in _WRITES:
        spark.sql(sql).write.format("noop").mode("overwrite").save()
    else:
        raise MigrationError(f"a {kind} would write past the transaction; use a JSON step")


def _target(tx: Transaction, table) -> tuple[TableDef, list[str]]:
    """The table that is written, and the names by which its columns may be qualified."""
    said = []
    if table.getClass().getSimpleName() == "SubqueryAlias":
        said.append(table.alias())
        table = table.child()
    parts = [table.multipartIdentifier().apply(i) for i in range(table.multipartIdentifier().size())]
    d = tx.definition(".".join(parts))
    return d, [*said, d.key, d.name]


def _text(expression, qualifiers: list[str]) -> str:
    """An expression's text over the table's own columns."""
    text = expression.sql()
    if _SUBQUERY.search(text):
        raise MigrationError("subqueries stand only in the query of an INSERT")
    for q in qualifiers:
        text = re.sub(rf"(?<![\w`.])`?{re.escape(q)}`?\.", "", text)
    return text
