"""Table descriptions: nine logical column types, columns, constraints and relationships."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from enum import StrEnum
from typing import Any

from pyspark.sql import types as T

from ..errors import CapabilityError, ValidationError

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def check_name(path: str, name: str) -> str:
    if not isinstance(name, str) or not _NAME.match(name):
        raise ValidationError(path, f"{name!r} is no identifier")
    return name


class Kind(StrEnum):
    BOOLEAN = "boolean"
    INTEGER = "integer"
    FLOAT = "float"
    TEXT = "text"
    BYTES = "bytes"
    TIME = "time"
    JSON = "json"
    UUID = "uuid"
    DECIMAL = "decimal"


@dataclass(frozen=True)
class ColumnType:
    """A logical type. What a kind doesn't use stays None or False."""

    kind: Kind
    unsigned: bool = False
    width: int | None = None
    fixed: bool = False
    precision: int | None = None
    scale: int | None = None

    def validate(self, path: str) -> None:
        if self.kind is Kind.DECIMAL:
            if self.precision is None or self.precision < 1:
                raise ValidationError(path, "a decimal needs a precision of at least 1")
            if self.scale is None:
                raise ValidationError(path, "a decimal's scale must be stated")
            if not 0 <= self.scale <= self.precision:
                raise ValidationError(path, "a decimal's scale lies between 0 and its precision")
        elif self.precision is not None or self.scale is not None:
            raise ValidationError(path, f"a {self.kind} has no precision or scale")
        if self.width is not None and (self.kind is not Kind.TEXT or self.width < 0):
            raise ValidationError(path, "only text has a width, and it is not negative")
        if self.fixed and self.width is None:
            raise ValidationError(path, "fixed text needs a width")
        if self.unsigned and self.kind is not Kind.INTEGER:
            raise ValidationError(path, "only integers are unsigned")

    def spark(self) -> T.DataType:
        """The Spark type that holds it."""
        if self.kind is Kind.DECIMAL and self.precision > 38:
            raise CapabilityError(f"Spark decimals have at most 38 digits, not {self.precision}")
        plain = {Kind.BOOLEAN: T.BooleanType(), Kind.FLOAT: T.DoubleType(), Kind.TEXT: T.StringType(), Kind.BYTES: T.BinaryType(), Kind.TIME: T.TimestampType(), Kind.JSON: T.StringType(), Kind.UUID: T.StringType()}
        if self.kind is Kind.INTEGER:
            return T.DecimalType(20, 0) if self.unsigned else T.LongType()
        return T.DecimalType(self.precision, self.scale) if self.kind is Kind.DECIMAL else plain[self.kind]

    def to_json(self) -> dict[str, Any]:
        return {"kind": str(self.kind)} | {f.name: v for f in fields(self)[1:] if (v := getattr(self, f.name)) not in (None, False)}

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> ColumnType:
        known = {f.name for f in fields(cls)}
        if unknown := set(data) - known:
            raise ValidationError("type", f"unknown attributes {sorted(unknown)}")
        try:
            return cls(**data | {"kind": Kind(data["kind"])})
        except (KeyError, ValueError) as e:
            raise ValidationError("type", f"unknown kind {data.get('kind')!r}") from e


def boolean() -> ColumnType:
    return ColumnType(Kind.BOOLEAN)


def integer(unsigned: bool = False) -> ColumnType:
    return ColumnType(Kind.INTEGER, unsigned=unsigned)


def float_() -> ColumnType:
    return ColumnType(Kind.FLOAT)


def text(width: int | None = None, fixed: bool = False) -> ColumnType:
    return ColumnType(Kind.TEXT, width=width, fixed=fixed)


def bytes_() -> ColumnType:
    return ColumnType(Kind.BYTES)


def time() -> ColumnType:
    return ColumnType(Kind.TIME)


def json_() -> ColumnType:
    return ColumnType(Kind.JSON)


def uuid() -> ColumnType:
    return ColumnType(Kind.UUID)


def decimal(precision: int, scale: int) -> ColumnType:
    return ColumnType(Kind.DECIMAL, precision=precision, scale=scale)


class Identity(StrEnum):
    ALWAYS = "always"
    BY_DEFAULT = "by default"


class Action(StrEnum):
    NO_ACTION = "no action"
    RESTRICT = "restrict"
    CASCADE = "cascade"
    SET_NULL = "set null"
    SET_DEFAULT = "set default"


@dataclass(frozen=True)
class ColumnDef:
    """A column; not null unless said otherwise. ``default`` and ``generated`` are SQL texts."""

    name: str
    type: ColumnType
    nullable: bool = False
    default: str | None = None
    generated: str | None = None
    stored: bool | None = None
    identity: Identity | None = None

    @property
    def writable(self) -> bool:
        return self.generated is None and self.identity is not Identity.ALWAYS

    def validate(self, path: str) -> None:
        check_name(f"{path}.name", self.name)
        self.type.validate(f"{path}.type")
        if (self.generated is None) != (self.stored is None):
            raise ValidationError(path, "a generated column states its expression and its storage together")
        if self.generated is not None and self.default is not None:
            raise ValidationError(path, "a generated column has no default")
        if self.identity and self.generated is not None:
            raise ValidationError(path, "an identity column is not generated")
        if self.identity and self.default is not None:
            raise ValidationError(path, "an identity column has no default")
        if self.identity and self.nullable:
            raise ValidationError(path, "an identity column is not nullable")
        if self.identity and self.type.kind is not Kind.INTEGER:
            raise ValidationError(path, "an identity column is an integer")


@dataclass(frozen=True)
class UniqueDef:
    columns: tuple[str, ...]
    name: str | None = None


@dataclass(frozen=True)
class CheckDef:
    expression: str
    name: str | None = None


@dataclass(frozen=True)
class IndexDef:
    columns: tuple[str, ...]
    name: str | None = None
    unique: bool = False
    predicate: str | None = None


@dataclass(frozen=True)
class ForeignKeyDef:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    schema: str | None = None
    name: str | None = None
    on_delete: Action = Action.NO_ACTION
    on_update: Action = Action.NO_ACTION


@dataclass(frozen=True)
class ExclusionDef:
    """A fact that can be described but not enforced."""

    expression: str
    name: str | None = None


@dataclass(frozen=True)
class RelationshipDef:
    """``belongs_to`` or ``has_many``; columns pair with those of the other table."""

    name: str
    kind: str
    table: str
    columns: tuple[str, ...]
    references: tuple[str, ...]
    schema: str | None = None


@dataclass(frozen=True)
class TableDef:
    """A table; ``validate`` refuses what contradicts itself."""

    name: str
    columns: tuple[ColumnDef, ...]
    schema: str | None = None
    primary_key: tuple[str, ...] = ()
    uniques: tuple[UniqueDef, ...] = ()
    checks: tuple[CheckDef, ...] = ()
    indexes: tuple[IndexDef, ...] = ()
    foreign_keys: tuple[ForeignKeyDef, ...] = ()
    exclusions: tuple[ExclusionDef, ...] = ()
    relationships: tuple[RelationshipDef, ...] = ()
    row_name: str | None = None
    _by_name: dict[str, ColumnDef] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        for name in ("columns", "primary_key", "uniques", "checks", "indexes", "foreign_keys", "exclusions", "relationships"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        object.__setattr__(self, "_by_name", {c.name: c for c in self.columns})

    @property
    def key(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    def column(self, name: str) -> ColumnDef | None:
        return self._by_name.get(name)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark(), c.nullable, {"logical": str(c.type.kind)}) for c in self.columns])

    def constraint_name(self, constraint: Any) -> str:
        if constraint.name:
            return constraint.name
        kind = {UniqueDef: "key", CheckDef: "check", IndexDef: "idx", ForeignKeyDef: "fkey"}.get(type(constraint), "excl")
        return "_".join((self.name, *getattr(constraint, "columns", ()), kind))

    def validate(self) -> TableDef:
        path = f"table {self.key}"
        check_name(f"{path}.name", self.name)
        if self.schema is not None:
            check_name(f"{path}.schema", self.schema)
        if not self.columns:
            raise ValidationError(path, "a table has at least one column")
        seen: set[str] = set()
        for c in self.columns:
            c.validate(f"{path}.{c.name}")
            if c.name in seen:
                raise ValidationError(path, f"column {c.name} is described twice")
            seen.add(c.name)
        self._check_columns(f"{path}.primary_key", self.primary_key, empty=True)
        for name in self.primary_key:
            if self.column(name).nullable:
                raise ValidationError(f"{path}.primary_key", f"{name} is nullable")
        names: set[str] = set()
        for one in (*self.uniques, *self.checks, *self.indexes, *self.foreign_keys, *self.exclusions):
            own = f"{path}.{self.constraint_name(one)}"
            if one.name is not None:
                check_name(own, one.name)
                if one.name in names:
                    raise ValidationError(own, "two constraints have this name")
                names.add(one.name)
            if isinstance(one, CheckDef | ExclusionDef):
                if not one.expression.strip():
                    raise ValidationError(own, "the expression is empty")
                continue
            self._check_columns(own, one.columns)
            if isinstance(one, ForeignKeyDef):
                check_name(f"{own}.table", one.table)
                if len(one.columns) != len(one.references):
                    raise ValidationError(own, "it pairs lists of different lengths")
                for action in (one.on_delete, one.on_update):
                    if action is Action.SET_NULL and not all(self.column(c).nullable for c in one.columns):
                        raise ValidationError(own, "SET NULL needs nullable columns")
        for one in self.relationships:
            own = f"{path}.{one.name}"
            check_name(own, one.name)
            if one.kind not in ("belongs_to", "has_many"):
                raise ValidationError(own, f"unknown kind {one.kind!r}")
            self._check_columns(own, one.columns)
            if len(one.columns) != len(one.references):
                raise ValidationError(own, "it pairs lists of different lengths")
            if one.kind == "belongs_to" and not any((k.columns, k.table, k.references) == (one.columns, one.table, one.references) for k in self.foreign_keys):
                raise ValidationError(own, "no foreign key matches it")
        if len({r.name for r in self.relationships}) != len(self.relationships):
            raise ValidationError(path, "two relationships have one name")
        return self

    def _check_columns(self, path: str, names: tuple[str, ...], empty: bool = False) -> None:
        if not names and not empty:
            raise ValidationError(path, "it names no column")
        if len(set(names)) != len(names):
            raise ValidationError(path, "it names a column twice")
        for name in names:
            if self.column(name) is None:
                raise ValidationError(path, f"there is no column {name}")

    def to_json(self) -> dict[str, Any]:
        out: dict[str, Any] = {"name": self.name, "schema": self.schema, "primary_key": list(self.primary_key), "row_name": self.row_name}
        out["columns"] = [{f.name: v for f in fields(c) if (v := getattr(c, f.name)) is not None} | {"type": c.type.to_json()} for c in self.columns]
        for name in ("uniques", "checks", "indexes", "foreign_keys", "exclusions", "relationships"):
            out[name] = [{f.name: v for f in fields(x) if (v := getattr(x, f.name)) is not None} for x in getattr(self, name)]
        return out

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> TableDef:
        def made(kind, x):
            x = {k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}
            for k in ("on_delete", "on_update"):
                if k in x:
                    x[k] = Action(x[k])
            return kind(**x)

        columns = [ColumnDef(**c | {"type": ColumnType.from_json(c["type"])} | ({"identity": Identity(c["identity"])} if "identity" in c else {})) for c in data["columns"]]
        kinds = {"uniques": UniqueDef, "checks": CheckDef, "indexes": IndexDef, "foreign_keys": ForeignKeyDef, "exclusions": ExclusionDef, "relationships": RelationshipDef}
        return cls(data["name"], tuple(columns), data.get("schema"), tuple(data.get("primary_key", ())), row_name=data.get("row_name"), **{k: tuple(made(kind, x) for x in data.get(k, ())) for k, kind in kinds.items()})


def column(name: str, type_: ColumnType, **options) -> ColumnDef:
    """A column; options are the fields of ColumnDef."""
    return ColumnDef(name, type_, **options)


def table(name: str, *parts: Any, schema: str | None = None, primary_key: tuple[str, ...] | list[str] = (), row_name: str | None = None) -> TableDef:
    """A validated table from columns and constraints in any order."""
    kinds = {ColumnDef: "columns", UniqueDef: "uniques", CheckDef: "checks", IndexDef: "indexes", ForeignKeyDef: "foreign_keys", ExclusionDef: "exclusions", RelationshipDef: "relationships"}
    found: dict[str, list] = {k: [] for k in kinds.values()}
    for p in parts:
        if type(p) not in kinds:
            raise ValidationError(f"table {name}", f"{p!r} is no part of a table")
        found[kinds[type(p)]].append(p)
    return TableDef(name, schema=schema, primary_key=tuple(primary_key), row_name=row_name, **{k: tuple(v) for k, v in found.items()}).validate()


def in_schema(definition: TableDef, schema: str) -> TableDef:
    return replace(definition, schema=schema).validate()


def from_spark(name: str, struct: T.StructType, schema: str | None = None) -> TableDef:
    """The description that a Spark schema allows; types without a logical kind are refused."""
    return TableDef(name, tuple(ColumnDef(f.name, logical_type(f), f.nullable) for f in struct.fields), schema).validate()


def logical_type(f: T.StructField) -> ColumnType:
    """The logical type of a Spark field."""
    tagged = (f.metadata or {}).get("logical")
    if isinstance(f.dataType, T.StringType):
        return {"json": json_(), "uuid": uuid()}.get(tagged, text())
    if isinstance(f.dataType, T.DecimalType):
        return integer(unsigned=True) if tagged == "integer" else decimal(f.dataType.precision, f.dataType.scale)
    plain = {T.BooleanType: boolean(), T.ByteType: integer(), T.ShortType: integer(), T.IntegerType: integer(), T.LongType: integer(), T.FloatType: float_(), T.DoubleType: float_(), T.BinaryType: bytes_(), T.TimestampType: time(), T.TimestampNTZType: time(), T.DateType: time()}
    if type(f.dataType) not in plain:
        raise CapabilityError(f"column {f.name}: {f.dataType.simpleString()} has no logical type")
    return plain[type(f.dataType)]
