"""Text dialects and what each can say."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntFlag, auto

from ..errors import CapabilityError
from .schema import ColumnType, Kind


class Can(IntFlag):
    RETURNING = auto()
    CONFLICT_TARGET = auto()
    DUPLICATE_KEY_UPDATE = auto()
    DEFAULT_VALUES = auto()
    DEFAULT_VALUES_UPSERT = auto()
    LIMIT_IN_MEMBERSHIP = auto()
    UNSIGNED = auto()
    PARTIAL_INDEX = auto()
    IDENTITY = auto()
    OFFSET_WITHOUT_LIMIT = auto()
    TEXT_WIDTH = auto()


@dataclass(frozen=True)
class Dialect:
    name: str
    quote: str
    numbered: bool
    can: Can
    types: dict[Kind, str]
    max_parameters: int | None = None
    decimal_max: tuple[int, int] | None = (38, 38)
    #: What stands for "no limit" before an OFFSET, where one must.
    endless: str | None = None

    def __hash__(self) -> int:
        return hash(self.name)

    def identifier(self, name: str) -> str:
        return f"{self.quote}{name}{self.quote}"

    def placeholder(self, n: int) -> str:
        return f"${n}" if self.numbered else "?"

    def require(self, what: Can, said: str) -> None:
        if what not in self.can:
            raise CapabilityError(f"{self.name} has no {said}")

    def type_name(self, t: ColumnType) -> str:
        if t.unsigned and t.kind is Kind.INTEGER:
            self.require(Can.UNSIGNED, "unsigned integers")
            return f"{self.types[t.kind]} UNSIGNED" if self.name == "mysql" else "DECIMAL(20,0)"
        if t.kind is Kind.TEXT and t.width is not None and Can.TEXT_WIDTH in self.can:
            return f"{'CHAR' if t.fixed else 'VARCHAR'}({t.width})"
        if t.kind is Kind.DECIMAL and self.decimal_max:
            if t.precision > self.decimal_max[0] or t.scale > self.decimal_max[1]:
                raise CapabilityError(f"{self.name} has no decimal of {t.precision} digits with {t.scale} of them after the point")
            return f"{self.types[t.kind]}({t.precision},{t.scale})"
        return self.types[t.kind]


def _types(*names: str) -> dict[Kind, str]:
    return dict(zip((Kind.BOOLEAN, Kind.INTEGER, Kind.FLOAT, Kind.TEXT, Kind.BYTES, Kind.TIME, Kind.JSON, Kind.UUID, Kind.DECIMAL), names, strict=True))


POSTGRESQL = Dialect("postgresql", '"', True, Can.RETURNING | Can.CONFLICT_TARGET | Can.DEFAULT_VALUES | Can.DEFAULT_VALUES_UPSERT | Can.LIMIT_IN_MEMBERSHIP | Can.PARTIAL_INDEX | Can.IDENTITY | Can.OFFSET_WITHOUT_LIMIT | Can.TEXT_WIDTH, _types("BOOLEAN", "BIGINT", "DOUBLE PRECISION", "TEXT", "BYTEA", "TIMESTAMPTZ", "JSONB", "UUID", "NUMERIC"), 65535, (1000, 1000))
MYSQL = Dialect("mysql", "`", False, Can.DUPLICATE_KEY_UPDATE | Can.DEFAULT_VALUES | Can.DEFAULT_VALUES_UPSERT | Can.UNSIGNED | Can.TEXT_WIDTH, _types("BOOLEAN", "BIGINT", "DOUBLE", "TEXT", "BLOB", "DATETIME", "JSON", "CHAR(36)", "DECIMAL"), 65535, (65, 30), "18446744073709551615")
SQLITE = Dialect("sqlite", '"', False, Can.RETURNING | Can.CONFLICT_TARGET | Can.DEFAULT_VALUES | Can.LIMIT_IN_MEMBERSHIP | Can.PARTIAL_INDEX, _types("INTEGER", "INTEGER", "REAL", "TEXT", "BLOB", "TEXT", "TEXT", "TEXT", "TEXT"), 32766, None, "-1")
SPARK = Dialect("spark", "`", False, Can.LIMIT_IN_MEMBERSHIP | Can.OFFSET_WITHOUT_LIMIT | Can.UNSIGNED | Can.TEXT_WIDTH | Can.RETURNING | Can.CONFLICT_TARGET | Can.DEFAULT_VALUES | Can.DEFAULT_VALUES_UPSERT, _types("BOOLEAN", "BIGINT", "DOUBLE", "STRING", "BINARY", "TIMESTAMP", "STRING", "STRING", "DECIMAL"))
DIALECTS = {d.name: d for d in (POSTGRESQL, MYSQL, SQLITE, SPARK)}
