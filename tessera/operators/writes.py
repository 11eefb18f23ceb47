"""Writes to the table store, with the constraints that a database server would hold."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CapabilityError, ConstraintError, ValidationError
from ..plans.lowering import Lowering
from ..plans.nodes import Bound, Delete, Excluded, Insert, TableRef, Update, Upsert, Write
from ..plans.render import name_of
from ..plans.schema import Action, ColumnDef, ForeignKeyDef, Kind, TableDef
from ..sources.store import Transaction

_ROW = "__row"


def execute(db, w: Write, take: Callable[[DataFrame], Any] = lambda rows: rows) -> tuple[int, Any]:
    """Run a write in the open transaction, or in one of its own; rows touched, and what ``take`` makes of those that RETURNING asks for.

    ``take`` runs before the commit, so nothing is written where the rows don't fit their destination.
    """
    tx: Transaction | None = db.transaction
    if tx is None and not hasattr(db.provider, "begin"):
        raise CapabilityError("these tables are read only")
    own = tx is None
    tx = tx or db.provider.begin()
    try:
        parts, d, target = {Insert: _insert, Update: _update, Delete: _delete, Upsert: _upsert}[type(w)](tx, w)
        touched = tx.read_parts(d, parts)
        n = touched.count()
        returned = take(touched.select(*(Lowering(None, _names(target, d)).column(p.expression).alias(p.alias or name_of(p.expression)) for p in w.returning))) if w.returning else None
        if own:
            tx.commit()
    except BaseException:
        if own:
            tx.rollback()
        raise
    return n, returned


def _names(t: TableRef, d: TableDef) -> dict:
    return {(t, c.name): c.name for c in d.columns}


def _value(value: Any, c: ColumnDef) -> Any:
    """A bound value as the column's Python type."""
    kind = c.type.kind
    if value is None:
        return None
    if kind is Kind.DECIMAL or c.type.unsigned:
        value = Decimal(str(value)) if isinstance(value, float) else Decimal(value)
        if kind is Kind.DECIMAL and value != round(value, c.type.scale):
            raise ValidationError(c.name, f"{value} has more than {c.type.scale} digits after the point")
        return value
    if kind is Kind.FLOAT and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind is Kind.BYTES:
        return value.encode() if isinstance(value, str) else bytes(value)
    if kind is Kind.TIME and isinstance(value, str):
        return datetime.fromisoformat(value)
    if kind is Kind.INTEGER and (isinstance(value, bool) or not isinstance(value, int) or not -(2**63) <= value < 2**63):
        raise ValidationError(c.name, f"{value!r} is no 64-bit integer")
    return value


def _incoming(tx: Transaction, w: Insert, d: TableDef) -> DataFrame:
    """The rows of an insert with defaults, identities and generated columns."""
    spark, struct = tx.spark, d.struct()
    rows = [()] if w.default_values else w.rows
    given = [c.name for c in w.columns]
    ids = {c.name: tx.next_ids(d.key, c.name, len(rows)) for c in d.columns if c.identity and c.name not in given}
    plain = all(isinstance(e, Bound) for row in rows for e in row)
    if plain:
        fields = [f for f in struct if f.name in given or f.name in ids]
        made = [{n: _value(e.value, d.column(n)) for n, e in zip(given, row, strict=True)} | {n: first + i for n, first in ids.items()} | {_ROW: i} for i, row in enumerate(rows)]
        schema = type(struct)([*(type(f)(f.name, f.dataType) for f in fields)]).add(_ROW, "long")
        df = spark.createDataFrame([tuple(m[f.name] for f in schema) for m in made], schema)
    else:
        at = Lowering(None)
        frames = []
        for i, row in enumerate(rows):
            columns = [at.column(e).cast(struct[n].dataType).alias(n) for n, e in zip(given, row, strict=True)]
            columns += [F.lit(first + i).cast(struct[n].dataType).alias(n) for n, first in ids.items()]
            frames.append(spark.range(1).select(*columns, F.lit(i).cast("long").alias(_ROW)))
        df = reduce(DataFrame.unionByName, frames)
    rest = {c.name: F.expr(c.default).cast(c.type.spark()) if c.default is not None else F.lit(None).cast(c.type.spark()) for c in d.columns if c.name not in df.columns and c.generated is None}
    return _generated(df.withColumns(rest) if rest else df, d)


def _generated(df: DataFrame, d: TableDef) -> DataFrame:
    made = {c.name: F.expr(c.generated).cast(c.type.spark()) for c in d.columns if c.generated is not None}
    return df.withColumns(made) if made else df


# -- statements: each returns the parts that hold the rows it touched


def _insert(tx: Transaction, w: Insert):
    d = tx.definition(w.into.definition.key)
    part = tx.write_part(d, _incoming(tx, w, d))
    hold(tx, d, [part], tx.parts(d.key))
    tx.set_parts(d.key, [*tx.parts(d.key), part])
    _hold_references(tx, d, [part])
    return [part], d, w.into


def insert_frame(db, definition: TableDef, rows: DataFrame) -> int:
    """Append a DataFrame of some columns; defaults, identities and constraints hold as for single rows."""
    own = db.transaction is None
    tx = db.transaction or db.provider.begin()
    try:
        d = tx.definition(definition.key)
        if unknown := [c for c in rows.columns if d.column(c) is None or not d.column(c).writable]:
            raise ValidationError("columns", f"{', '.join(unknown)} cannot be written")
        df = rows
        for c in d.columns:
            if c.name not in rows.columns and c.generated is None:
                if c.identity:
                    n = df.count()
                    first = tx.next_ids(d.key, c.name, 1)
                    df = df.withColumn(c.name, F.monotonically_increasing_id() + F.lit(first))
                    if n:
                        tx._entry(d.key)["next"][c.name] = first + df.agg(F.max(c.name)).first()[0] + 1
                else:
                    df = df.withColumn(c.name, F.expr(c.default or "NULL").cast(c.type.spark()))
        part = tx.write_part(d, _generated(df, d))
        hold(tx, d, [part], tx.parts(d.key))
        tx.set_parts(d.key, [*tx.parts(d.key), part])
        _hold_references(tx, d, [part])
        n = tx.read_parts(d, [part]).count()
        if own:
            tx.commit()
        return n
    except BaseException:
        if own:
            tx.rollback()
        raise


def _chosen(w: Update | Delete, d: TableDef) -> Column:
    if w.where is None:
        return F.lit(True)
    return F.coalesce(Lowering(None, _names(w.table, d)).column(w.where, condition=True), F.lit(False))


def _update(tx: Transaction, w: Update):
    d = tx.definition(w.table.definition.key)
    at = Lowering(None, _names(w.table, d))
    values = {a.column.name: at.column(a.value, near=a.column).cast(a.column.definition.type.spark()) for a in w.assignments}
    return rewrite(tx, d, _chosen(w, d), values), d, w.table


def _hit(tx: Transaction, d: TableDef, chosen: Column) -> tuple[list[str], list[str]]:
    """The parts that hold a chosen row, and the others."""
    parts = tx.parts(d.key)
    if not parts:
        return [], []
    place = F.regexp_extract("_metadata.file_path", r"/parts/([^/]+)/[^/]*$", 1)
    found = {r[0] for r in tx.read(d).where(chosen).select(place).distinct().collect()}
    return [p for p in parts if p in found], [p for p in parts if p not in found]


def rewrite(tx: Transaction, d: TableDef, chosen: Column, values: dict[str, Column]) -> list[str]:
    """Write the rows that stay and those that change of the parts that hold some of these; other parts are left alone."""
    hit, rest = _hit(tx, d, chosen)
    if not hit:
        return []
    old = tx.read_parts(d, hit)
    changed = old.where(chosen).select(*(values.get(c.name, F.col(f"`{c.name}`")).alias(c.name) for c in d.columns))
    kept, part = tx.write_part(d, old.where(~chosen)), tx.write_part(d, _generated(changed, d))
    keys = {c for f in _children_of(tx, d) for c in f[1].references} & set(values)
    before = old.where(chosen).select(*(F.col(f"`{c}`").alias(f"old_{c}") for c in sorted(keys)), *(values.get(c, F.col(f"`{c}`")).alias(f"new_{c}") for c in sorted(keys))) if keys else None
    if before is not None:
        before = _stored(tx, before)
    hold(tx, d, [part], [*rest, kept])
    tx.set_parts(d.key, [*rest, kept, part])
    _hold_references(tx, d, [part])
    if before is not None:
        _follow_update(tx, d, before)
    return [part]


def merge_rows(db, definition: TableDef, rows: list[dict[str, Any]], columns: tuple[str, ...]) -> int:
    """Set ``columns`` of the rows that have the primary keys of ``rows``, in one write; how many there were.

    Two rows of one key are refused. Columns that other tables refer to are not followed here.
    """
    own = db.transaction is None
    if own and not hasattr(db.provider, "begin"):
        raise CapabilityError("these tables are read only")
    tx = db.transaction or db.provider.begin()
    try:
        d = tx.definition(definition.key)
        struct = d.struct()
        fields = [f for f in struct if f.name in (*d.primary_key, *columns)]
        schema = type(struct)([type(f)(f"__new_{f.name}", f.dataType) for f in fields])
        given = [tuple(_value(r[f.name], d.column(f.name)) for f in fields) for r in rows]
        new = _stored(tx, tx.spark.createDataFrame(given, schema))
        keys = [f"__new_{k}" for k in d.primary_key]
        if not new.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ConstraintError(d.key, "primary key", "the statement would change a row twice")
        n = 0
        parts = tx.parts(d.key)
        if parts:
            old = tx.read(d)
            same = [F.col(f"`{k}`") == F.col(f"__new_{k}") for k in d.primary_key]
            place = F.regexp_extract("_metadata.file_path", r"/parts/([^/]+)/[^/]*$", 1)
            found = {r[0] for r in old.select("*", place.alias("__part")).join(new, same, "left_semi").select("__part").distinct().collect()}
            if found:
                rest = [p for p in parts if p not in found]
                old = tx.read_parts(d, [p for p in parts if p in found])
                changed = old.join(new, same).select(*(F.col(f"__new_{c.name}" if c.name in columns else f"`{c.name}`").alias(c.name) for c in d.columns))
                kept, part = tx.write_part(d, old.join(new, same, "left_anti")), tx.write_part(d, _generated(changed, d))
                hold(tx, d, [part], [*rest, kept])
                tx.set_parts(d.key, [*rest, kept, part])
                _hold_references(tx, d, [part])
                n = tx.read_parts(d, [part]).count()
        if own:
            tx.commit()
        return n
    except BaseException:
        if own:
            tx.rollback()
        raise


def referred_columns(tx: Transaction, d: TableDef) -> set[str]:
    """The columns of a table that foreign keys refer to."""
    return {c for _, f in _children_of(tx, d) for c in f.references}


def _stored(tx: Transaction, df: DataFrame) -> DataFrame:
    """A small side table in the store's own folder, dropped with the transaction's other parts by vacuum."""
    part = f"side-{len(tx.written)}-{id(tx):x}"
    path = f"{tx.store.root}/parts/{part}"
    tx.written.append(part)
    df.write.mode("overwrite").parquet(path)
    return tx.spark.read.parquet(path)


def _delete(tx: Transaction, w: Delete):
    d = tx.definition(w.table.definition.key)
    return remove(tx, d, _chosen(w, d)), d, w.table


def remove(tx: Transaction, d: TableDef, chosen: Column) -> list[str]:
    """Take the chosen rows out of the parts that hold them; a part, not of the table any more, that has them."""
    hit, rest = _hit(tx, d, chosen)
    if not hit:
        return []
    old = tx.read_parts(d, hit)
    kept, gone = tx.write_part(d, old.where(~chosen)), tx.write_part(d, old.where(chosen))
    tx.set_parts(d.key, [*rest, kept])
    _follow_delete(tx, d, gone)
    return [gone]


def _upsert(tx: Transaction, w: Upsert):
    d = tx.definition(w.insert.into.definition.key)
    fresh_rows = _incoming(tx, w.insert, d)
    keys = tuple(c.name for c in w.conflict)
    candidates = [d.primary_key, *(u.columns for u in d.uniques), *(i.columns for i in d.indexes if i.unique and not i.predicate)]
    if keys and not any(set(keys) == set(k) for k in candidates if k):
        raise ValidationError("conflict", f"no key of {d.key} is {', '.join(keys)}")
    wanted = [keys] if keys else [k for k in candidates if k]
    old = tx.read(d)
    incoming = _stored(tx, fresh_rows)
    for k in wanted:
        full = reduce(and_, (F.col(c).isNotNull() for c in k))
        twice = incoming.where(full).groupBy(*k).agg(F.count("*").alias("n"), F.min(_ROW).alias("first")).where("n > 1")
        if w.assignments:
            if not twice.isEmpty():
                raise ConstraintError(d.key, ", ".join(k), "the statement would change a row twice")
        else:
            later = incoming.alias("i").join(twice.alias("t"), [F.col(f"i.{c}") == F.col(f"t.{c}") for c in k] + [F.col(f"i.{_ROW}") > F.col("t.first")], "left_semi").select(_ROW)
            incoming = incoming.join(later, _ROW, "left_anti")
    if not w.assignments:
        for k in wanted:
            incoming = incoming.join(old.select(*k), list(k), "left_anti")
        part = tx.write_part(d, incoming)
        hold(tx, d, [part], tx.parts(d.key))
        tx.set_parts(d.key, [*tx.parts(d.key), part])
        _hold_references(tx, d, [part])
        return [part], d, w.insert.into
    new = incoming.select(*(F.col(f"`{c.name}`").alias(f"__new_{c.name}") for c in d.columns))
    same = reduce(and_, (old[k] == new[f"__new_{k}"] for k in keys))
    into = w.insert.into
    at = Lowering(None, _names(into, d), excluded={c.name: f"__new_{c.name}" for c in d.columns})
    values = {a.column.name: at.column(a.value, near=a.value.column if isinstance(a.value, Excluded) else a.column).cast(a.column.definition.type.spark()) for a in w.assignments}
    changed = old.join(new, same).select(*(values.get(c.name, F.col(f"`{c.name}`")).alias(c.name) for c in d.columns))
    added = tx.write_part(d, incoming.join(old.select(*keys), list(keys), "left_anti"))
    others, parts = tx.parts(d.key), [added]
    place = F.regexp_extract("_metadata.file_path", r"/parts/([^/]+)/[^/]*$", 1)
    found = {r[0] for r in old.select(*keys, place.alias("__part")).join(incoming.select(*keys), list(keys), "left_semi").select("__part").distinct().collect()} if others else set()
    if found:
        kept = tx.write_part(d, tx.read_parts(d, [p for p in others if p in found]).join(incoming.select(*keys), list(keys), "left_anti"))
        others, parts = [*(p for p in others if p not in found), kept], [tx.write_part(d, _generated(changed, d)), added]
    hold(tx, d, parts, others)
    tx.set_parts(d.key, [*others, *parts])
    _hold_references(tx, d, parts)
    return parts, d, into


# -- constraints


def hold(tx: Transaction, d: TableDef, parts: list[str], others: list[str]) -> None:
    """Refuse new rows that break a rule of their own, or a key together with the other rows."""
    rows, rest = tx.read_parts(d, parts), tx.read_parts(d, others)
    rules: list[tuple[str, Column]] = []
    for c in d.columns:
        col = F.col(f"`{c.name}`")
        if not c.nullable:
            rules.append((f"{c.name} is not null", col.isNull()))
        if c.type.width is not None:
            rules.append((f"{c.name} has at most {c.type.width} characters", F.length(col) > c.type.width))
        if c.type.unsigned:
            rules.append((f"{c.name} lies between 0 and 2^64 - 1", (col < 0) | (col > F.lit(Decimal(2**64 - 1)))))
    rules += [(d.constraint_name(k), ~F.expr(k.expression)) for k in d.checks]
    keys = []
    for name, columns, predicate in _keys(d):
        full = reduce(and_, (F.col(f"`{c}`").isNotNull() for c in columns))
        keys.append((name, columns, full & F.expr(predicate) if predicate else full))
    # one pass over the new rows for all of their own rules and keys
    asked = [F.max(F.coalesce(r, F.lit(False)).cast("int")) for _, r in rules]
    for _, columns, full in keys:
        asked += [F.count(F.when(full, 1)), F.count_distinct(F.when(full, F.struct(*(F.col(f"`{c}`") for c in columns))))]
    if not asked:
        return
    said = list(rows.agg(*(a.alias(f"r{i}") for i, a in enumerate(asked))).first())
    for (rule, _), n in zip(rules, said[: len(rules)], strict=True):
        if n:
            raise ConstraintError(d.key, rule, "a row breaks it")
    for i, (name, columns, full) in enumerate(keys):
        n, apart = said[len(rules) + 2 * i : len(rules) + 2 * i + 2]
        if n != apart:
            raise ConstraintError(d.key, name, f"two rows have the same {', '.join(columns)}")
        if n and others and not rows.where(full).select(*columns).join(rest.where(full).select(*columns), list(columns), "left_semi").isEmpty():
            raise ConstraintError(d.key, name, f"two rows have the same {', '.join(columns)}")


def _keys(d: TableDef) -> list[tuple[str, tuple[str, ...], str | None]]:
    out = [("primary key", d.primary_key, None)] if d.primary_key else []
    out += [(d.constraint_name(u), u.columns, None) for u in d.uniques]
    return out + [(d.constraint_name(i), i.columns, i.predicate) for i in d.indexes if i.unique]


def _parent(tx: Transaction, f: ForeignKeyDef) -> TableDef:
    return tx.definition(f"{f.schema}.{f.table}" if f.schema else f.table)


def _hold_references(tx: Transaction, d: TableDef, parts: list[str]) -> None:
    """Every new row's foreign keys must be there; a key with a null is exempt."""
    rows = tx.read_parts(d, parts)
    for f in d.foreign_keys:
        parent = _parent(tx, f)
        own = rows.where(reduce(and_, (F.col(c).isNotNull() for c in f.columns))).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(f.columns)))
        there = tx.read(parent).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(f.references)))
        if not own.join(there, own.columns, "left_anti").isEmpty():
            raise ConstraintError(d.key, d.constraint_name(f), f"{f.table} has no such row")


def _children_of(tx: Transaction, d: TableDef) -> list[tuple[TableDef, ForeignKeyDef]]:
    return [(child, f) for child in tx.definitions() for f in child.foreign_keys if (f"{f.schema}.{f.table}" if f.schema else f.table) == d.key]


def _follow_delete(tx: Transaction, d: TableDef, gone: str) -> None:
    """Apply the children's actions for deleted rows."""
    for child, f in _children_of(tx, d):
        removed = tx.read_parts(d, [gone]).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(f.references))).distinct()
        removed = removed.join(tx.read(d).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(f.references))), removed.columns, "left_anti")
        _act(tx, child, f, f.on_delete, removed)


def _act(tx: Transaction, child: TableDef, f: ForeignKeyDef, action: Action, keys: DataFrame) -> None:
    rows = tx.read(child)
    pairs = [f"_k{i}" for i in range(len(f.columns))]
    hit = rows.join(keys.select(*pairs).distinct(), reduce(and_, (rows[c] == keys[p] for c, p in zip(f.columns, pairs, strict=True))), "left_semi")
    if hit.isEmpty():
        return
    if action in (Action.NO_ACTION, Action.RESTRICT):
        raise ConstraintError(child.key, child.constraint_name(f), "rows refer to what would go")
    missed = rows.join(keys.select(*pairs).distinct(), reduce(and_, (rows[c] == keys[p] for c, p in zip(f.columns, pairs, strict=True))), "left_anti")
    kept = tx.write_part(child, missed)
    if action is Action.CASCADE:
        gone = tx.write_part(child, hit)
        tx.set_parts(child.key, [kept])
        _follow_delete(tx, child, gone)
        return
    new = {c: F.lit(None) if action is Action.SET_NULL else F.expr(child.column(c).default or "NULL") for c in f.columns}
    part = tx.write_part(child, _generated(hit.withColumns({c: v.cast(child.column(c).type.spark()) for c, v in new.items()}), child))
    hold(tx, child, [part], [kept])
    tx.set_parts(child.key, [kept, part])
    _hold_references(tx, child, [part])


def _follow_update(tx: Transaction, d: TableDef, before: DataFrame) -> None:
    """Apply the children's actions for changed keys; ``before`` pairs old and new values."""
    for child, f in _children_of(tx, d):
        if not set(f.references) & {c.removeprefix("old_") for c in before.columns}:
            continue
        if any(f"old_{c}" not in before.columns for c in f.references):
            raise CapabilityError(f"{child.key}: a key changed in part is not followed")
        moved = before.where(~reduce(and_, (F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in f.references)))
        moved = moved.select(*(F.col(f"old_{c}").alias(f"_k{i}") for i, c in enumerate(f.references)), *(F.col(f"new_{c}").alias(f"_n{i}") for i, c in enumerate(f.references)))
        there = tx.read(d).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(f.references)))
        if f.on_update is not Action.CASCADE:
            _act(tx, child, f, f.on_update, moved.join(there, there.columns, "left_anti"))
            continue
        rows = tx.read(child)
        same = reduce(and_, (rows[c] == moved[f"_k{i}"] for i, c in enumerate(f.columns)))
        hit = rows.join(moved, same).select(*(F.col(f"_n{f.columns.index(c.name)}").alias(c.name) if c.name in f.columns else rows[c.name] for c in child.columns))
        kept, part = tx.write_part(child, rows.join(moved, same, "left_anti")), tx.write_part(child, _generated(hit, child))
        hold(tx, child, [part], [kept])
        tx.set_parts(child.key, [kept, part])
        _hold_references(tx, child, [part])
