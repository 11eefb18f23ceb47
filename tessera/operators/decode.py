"""Result rows into dataclasses, strictly: NULL is no zero value, and numbers never wrap."""

from __future__ import annotations

import dataclasses
import re
import types
import typing
from datetime import date, datetime
from decimal import Decimal
from functools import lru_cache
from typing import Any

from pyspark.sql import Row

from ..errors import DecodeError

_LAYOUTS = ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")


class Int64(int):
    """Marks a destination of 64-bit signed integers, like ``int``."""


class UInt64(int):
    """Marks a destination of 64-bit unsigned integers."""


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def nullable(kind: Any) -> tuple[bool, Any]:
    """Whether NULL may go there, and the type without it."""
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(kind) if a is not type(None)]
        if len(rest) < len(typing.get_args(kind)):
            return True, rest[0] if len(rest) == 1 else Any
    return kind is Any, kind


@lru_cache(maxsize=512)
def plan(cls: type) -> tuple[tuple[str, str, Any], ...]:
    """(field, column, type) of a dataclass; metadata ``column`` renames a field, and "-" leaves it out."""
    if not dataclasses.is_dataclass(cls):
        raise DecodeError(f"{cls!r} is no dataclass")
    hints = typing.get_type_hints(cls)
    out = []
    for f in dataclasses.fields(cls):
        column = f.metadata.get("column", snake_case(f.name))
        if column != "-" and f.init:
            out.append((f.name, column, hints[f.name]))
    return tuple(out)


def convert(value: Any, kind: Any, what: str = "value") -> Any:
    """``value`` as ``kind``, or a DecodeError."""
    may, kind = nullable(kind)
    if value is None:
        if may:
            return None
        raise DecodeError(f"{what}: expected {getattr(kind, '__name__', kind)}, got NULL")
    if kind is Any:
        return value
    if hasattr(kind, "scan_value"):
        return kind.scan_value(value)
    try:
        return _convert(value, kind)
    except (TypeError, ValueError, ArithmeticError) as e:
        raise DecodeError(f"{what}: {value!r} is no {getattr(kind, '__name__', kind)}") from e


def _convert(value: Any, kind: Any) -> Any:
    if kind in (int, Int64, UInt64):
        if isinstance(value, bool) or not isinstance(value, int | Decimal) or value != int(value):
            raise TypeError
        low, high = (0, 2**64) if kind is UInt64 else (-(2**63), 2**63)
        if not low <= value < high:
            raise OverflowError
        return int(value)
    if kind is float:
        if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
            raise TypeError
        return float(value)
    if kind is bool:
        if not isinstance(value, bool | int):
            raise TypeError
        return bool(value)
    if kind is str:
        if isinstance(value, bytes | bytearray):
            return bytes(value).decode()
        if isinstance(value, Decimal):
            return format(value, "f")
        if not isinstance(value, str):
            raise TypeError
        return value
    if kind is bytes:
        return value.encode() if isinstance(value, str) else bytes(value)
    if kind is Decimal:
        if isinstance(value, bool | float):
            raise TypeError
        return Decimal(value)
    if kind is datetime:
        if isinstance(value, datetime):
            return value
        if isinstance(value, date):
            return datetime(value.year, value.month, value.day)
        for layout in _LAYOUTS:
            try:
                return datetime.strptime(value, layout)
            except ValueError:
                continue
        raise ValueError
    if kind is date and isinstance(value, date):
        return value.date() if isinstance(value, datetime) else value
    origin = typing.get_origin(kind) or kind
    if isinstance(origin, type) and isinstance(value, origin):
        return value
    raise TypeError


def check_names(names: list[str]) -> None:
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise DecodeError(f"the result has two columns named {', '.join(twice)}")


def decode(row: Row, cls: type) -> Any:
    """A row as ``cls``; other columns are ignored, missing ones refused."""
    names = list(row.__fields__)
    check_names(names)
    at = {n: i for i, n in enumerate(names)}
    values = {}
    for field, column, kind in plan(cls):
        if column not in at:
            raise DecodeError(f"the result has no column {column}")
        values[field] = convert(row[at[column]], kind, column)
    return cls(**values)


class DynamicRow:
    """A row whose columns are known only when it comes."""

    __slots__ = ("names", "values")

    def __init__(self, names: tuple[str, ...], values: tuple):
        check_names(list(names))
        self.names, self.values = names, values

    @classmethod
    def of(cls, row: Row) -> DynamicRow:
        return cls(tuple(row.__fields__), tuple(row))

    def get(self, name: str, kind: Any = Any) -> Any:
        if name not in self.names:
            raise DecodeError(f"the result has no column {name}")
        return convert(self.values[self.names.index(name)], kind, name)

    def __getitem__(self, name: str) -> Any:
        return self.get(name)

    def decode(self, cls: type) -> Any:
        return decode(Row(*self.names)(*self.values), cls)

    def as_dict(self) -> dict[str, Any]:
        return dict(zip(self.names, self.values, strict=True))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, DynamicRow) and (self.names, self.values) == (other.names, other.values)

    def __repr__(self) -> str:
        return f"DynamicRow({self.as_dict()!r})"


def column_values(row: Any) -> dict[str, Any]:
    """The columns that an object gives for a write: of ``column_values()``, or of its fields."""
    if hasattr(row, "column_values"):
        return dict(row.column_values())
    return {column: getattr(row, field) for field, column, _ in plan(type(row))}
