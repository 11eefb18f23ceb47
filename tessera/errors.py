"""Errors of the library."""

from __future__ import annotations


class TesseraError(Exception):
    """Base of all errors raised here."""


class ValidationError(TesseraError):
    """A description or statement that is refused before anything runs."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")
        self.path, self.message = path, message


class CapabilityError(TesseraError):
    """A valid description or statement that a dialect or the store cannot express."""


class QueryError(TesseraError):
    """A statement that Spark refused or that failed while running."""


class DecodeError(TesseraError):
    """A result row that doesn't fit its destination."""


class HookError(TesseraError):
    """A hook that failed before its operation, which then did not run."""


class NoRowsError(TesseraError):
    """One row was asked for and none came."""


class MultipleRowsError(TesseraError):
    """One row was asked for and more came."""


class ConstraintError(TesseraError):
    """Rows that break a constraint of their table."""

    def __init__(self, table: str, constraint: str, message: str):
        super().__init__(f"{table}: {constraint}: {message}")
        self.table, self.constraint = table, constraint


class TransactionError(TesseraError):
    """A transaction begun, committed or used at the wrong time, or one that lost to another."""


class InspectionError(TesseraError):
    """Base of what inspection raises."""


class TableNotFoundError(InspectionError):
    """No such table."""


class AmbiguousTableError(InspectionError):
    """A name that several schemas have."""


class IncompleteTableError(InspectionError):
    """A table whose description cannot be told in full."""


class MigrationError(TesseraError):
    """A migration that cannot be planned, applied or reverted."""


class ManualMigrationError(MigrationError):
    """A schema change that needs a hand-written migration."""
