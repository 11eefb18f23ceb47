"""The handle on which statements run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any, Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import DecodeError, HookError, MultipleRowsError, NoRowsError, QueryError, TesseraError, TransactionError, ValidationError
from ..plans.lowering import lower
from ..plans.nodes import Function, Projection, Select, TableRef, Write
from ..plans.render import Statement, name_of, render
from ..plans.schema import TableDef
from .decode import DynamicRow, check_names, decode, plan


class Provider(Protocol):
    """Where tables come from."""

    def read(self, definition: TableDef) -> DataFrame: ...


@dataclass(frozen=True)
class Operation:
    """What is about to run; hooks see it and cannot change it."""

    kind: str
    sql: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class Hook:
    """Called before and after each operation; ``after`` gets the error, if any."""

    before: Callable[[Operation], None] | None = None
    after: Callable[[Operation, Exception | None], None] | None = None


@dataclass(frozen=True)
class Database:
    """A Spark session with a provider of tables. Cheap to copy; all state lives in the provider."""

    spark: SparkSession
    provider: Any
    hooks: tuple[Hook, ...] = ()
    transaction: Any = None
    dry_run: bool = False

    def with_hooks(self, *hooks: Hook) -> Database:
        return replace(self, hooks=(*self.hooks, *hooks))

    # -- running

    def _run(self, operation: Operation, action: Callable[[], Any]) -> Any:
        result, error, entered = None, None, []
        for h in self.hooks:
            try:
                if h.before:
                    h.before(operation)
            except Exception as e:
                error = HookError(f"a hook failed before the {operation.kind}: {e}")
                error.__cause__ = e
                break
            entered.append(h)
        if error is None:
            try:
                result = action()
            except TesseraError as e:
                error = e
            except Exception as e:
                error = translated(e)
                error.__cause__ = e
        later = []
        # those whose own before failed, or never ran, have nothing to end
        for h in reversed(entered):
            if h.after:
                try:
                    h.after(operation, error)
                except Exception as e:
                    later.append(e)
        if later:
            raise ExceptionGroup("hooks failed after the operation", [*([error] if error else []), *later])
        if error:
            raise error
        return result

    def read(self, t: TableRef) -> DataFrame:
        return (self.transaction or self.provider).read(t.definition)

    def frame(self, s: Select) -> DataFrame:
        """The SELECT as a DataFrame; nothing runs."""
        self._usable()
        return lower(s, self.read)

    def _usable(self) -> None:
        if self.transaction is not None and self.transaction.finished:
            raise TransactionError("the transaction is over")

    # -- reading

    def query(self, s: Select, cls: type | None = None) -> Iterator[Any]:
        """Rows one by one; nothing runs before the first is asked for."""
        self._usable()
        s.validate()

        def rows() -> Iterator[Any]:
            said = render(s)
            operation = Operation("query", said.sql, said.args)
            if self.dry_run:
                self._run(operation, lambda: None)
                return
            source = self._run(operation, lambda: self.frame(s).toLocalIterator())
            while True:
                try:
                    row = next(source)
                except StopIteration:
                    return
                except Exception as e:
                    raise translated(e) from e
                yield _made(row, cls)

        return rows()

    def all(self, s: Select, cls: type | None = None) -> list[Any]:
        said = render(s)
        rows = self._run(Operation("query", said.sql, said.args), lambda: [] if self.dry_run else self.frame(s).collect())
        return [_made(r, cls) for r in rows]

    def one(self, s: Select, cls: type | None = None) -> Any:
        """Exactly one row; at most two are fetched."""
        said = render(s)
        rows = self._run(Operation("query", said.sql, said.args), lambda: [] if self.dry_run else self.frame(s).limit(2).collect())
        if not rows:
            raise NoRowsError("the query has no rows")
        if len(rows) > 1:
            raise MultipleRowsError("the query has more than one row")
        return _made(rows[0], cls)

    def count(self, s: Select) -> int:
        return self.one(counting(s)).get("count", int)

    # -- static SQL

    def sql_frame(self, statement: Statement) -> DataFrame:
        """Spark's own grammar over the provider's tables, which ``register`` made views of."""
        return self.spark.sql(statement.sql, args=list(statement.args) or None)

    def query_rendered(self, statement: Statement, cls: type | None = None) -> list[Any]:
        rows = self._run(Operation("query", statement.sql, statement.args), lambda: [] if self.dry_run else self.sql_frame(statement).collect())
        return [_made(r, cls) for r in rows]

    def query_rendered_one(self, statement: Statement, cls: type | None = None) -> Any:
        rows = self._run(Operation("query", statement.sql, statement.args), lambda: [] if self.dry_run else self.sql_frame(statement).limit(2).collect())
        if len(rows) != 1:
            raise (MultipleRowsError if rows else NoRowsError)(f"the query has {'more than one row' if rows else 'no rows'}")
        return _made(rows[0], cls)

    def exec_rendered(self, statement: Statement) -> None:
        self._run(Operation("exec", statement.sql, statement.args), lambda: None if self.dry_run else self.sql_frame(statement))

    def register(self, *definitions: TableDef) -> None:
        """Temporary views of tables, by which static SQL reads them; one of a schema is called `schema.name`, in backticks."""
        for d in definitions:
            self.read(TableRef(d)).createOrReplaceTempView(f"`{d.key}`")

    # -- writing

    def exec(self, w: Write) -> int:
        """Run a write without RETURNING; the number of rows it touched."""
        self._usable()
        if w.returning:
            raise ValidationError("returning", "a statement that returns rows is queried")
        from .writes import execute

        w.validate()
        said = render(w)
        return self._run(Operation("exec", said.sql, said.args), lambda: 0 if self.dry_run else execute(self, w)[0])

    def query_write(self, w: Write, cls: type | None = None) -> Iterator[Any]:
        """Run a write with RETURNING when its rows are first asked for.

        Whether the row type finds its columns is checked before anything runs, and rows are made before the commit.
        """
        self._usable()
        if not w.returning:
            raise ValidationError("returning", "the statement returns no rows")
        w.validate()
        check_returning(w, cls)

        def rows() -> Iterator[Any]:
            from .writes import execute

            said = render(w)
            yield from self._run(Operation("query", said.sql, said.args), lambda: [] if self.dry_run else execute(self, w, lambda df: [_made(r, cls) for r in df.collect()])[1])

        return rows()

    def query_write_all(self, w: Write, cls: type | None = None) -> list[Any]:
        return list(self.query_write(w, cls))

    def query_write_one(self, w: Write, cls: type | None = None) -> Any:
        rows = self.query_write_all(w, cls)
        if len(rows) != 1:
            raise (MultipleRowsError if rows else NoRowsError)(f"the statement returned {len(rows)} rows")
        return rows[0]

    # -- transactions

    def begin(self) -> Database:
        """A handle whose writes stay apart until ``commit``."""
        if self.transaction is not None:
            raise TransactionError("a transaction is already open")
        if not hasattr(self.provider, "begin"):
            raise TransactionError("these tables are read only")
        return replace(self, transaction=self.provider.begin())

    def commit(self) -> None:
        if self.transaction is None:
            raise TransactionError("no transaction is open")
        self.transaction.commit()

    def rollback(self) -> None:
        """Forget the transaction's writes; nothing happens if it is over."""
        if self.transaction is None:
            raise TransactionError("no transaction is open")
        if not self.transaction.finished:
            self.transaction.rollback()


def check_returning(w: Write, cls: type | None) -> None:
    """Refuse what could not be decoded: two columns of one name, or a field of the row type without a column."""
    names = [p.alias or name_of(p.expression) for p in w.returning]
    check_names(names)
    if cls is not None and (missing := [column for _, column, _ in plan(cls) if column not in names]):
        raise DecodeError(f"the statement returns no column {', '.join(missing)}")


def counting(s: Select) -> Select:
    """``COUNT(*)`` of the same rows; order goes, and what would change the meaning is refused."""
    for name in ("limit", "offset"):
        if getattr(s, name) is not None:
            raise ValidationError(name, "COUNT takes no page")
    for name in ("group_by", "having", "distinct"):
        if getattr(s, name):
            raise ValidationError(name, "COUNT takes plain rows")
    return replace(s, projections=(Projection(Function("COUNT", (), star=True), "count"),), order=()).validate()


def translated(e: Exception) -> Exception:
    """Spark's errors as this library's."""
    text = str(e)
    if "SCALAR_SUBQUERY_TOO_MANY_ROWS" in text:
        return QueryError("a scalar subquery returned more than one row")
    if isinstance(e, PySparkException) or type(e).__name__ == "Py4JJavaError":
        return QueryError(text.splitlines()[0] if text else type(e).__name__)
    return e


def _made(row: Any, cls: type | None) -> Any:
    if cls is None:
        return DynamicRow.of(row)
    check_names(list(row.__fields__))
    return decode(row, cls)
