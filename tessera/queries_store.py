"""Queries for handles, typed rows, decoding, inspection, migrations and generated code, with SQL that says the same.

What an operator answers about itself (texts, states, refusals) comes as rows, and the SQL states what is expected.
"""

from __future__ import annotations

import hashlib
import io
import json
import tempfile
import types
from contextlib import redirect_stdout
from dataclasses import dataclass, field, make_dataclass, replace
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .codegen import check_module, query_module, store_module, write_module
from .codegen.settings import Settings
from .errors import TesseraError
from .migrations import Migration, Runner, diff_schemas, load_directory, write_migration
from .operators.builder import Table, dynamic_select, select_from
from .operators.database import Database, Hook
from .operators.relations import load_has_many
from .operators.typed import insert_returning, insert_rows, update_columns, update_rows, update_statement
from .operators.writes import insert_frame
from .plans import schema as s
from .plans.dialect import DIALECTS, POSTGRESQL, SPARK, Can
from .plans.nodes import TableRef, count, delete, equal, func, greater, inner_join, insert, less, lower, max_, not_equal, project, select, set_, update
from .plans.render import create_table, render
from .plans.templates import parse
from .queries import _S_NATION, _S_REGION, CUSTOMER, NATION, ORDERS, REGION, I, X, _add, _registered, c, customer, database, n, nation, o, orders, r, region, scratch, sn, sr
from .sources import ParquetDirectory, Store
from .sources.catalog import StoreInspector, sweep
from .streaming import StreamDirectory


@dataclass(frozen=True)
class RegionRow:
    r_regionkey: int
    r_name: str


@dataclass(frozen=True)
class NationRow:
    n_nationkey: int
    n_name: str
    n_regionkey: int | None


def _empty(spark: SparkSession, *tables: s.TableDef) -> Database:
    """A new store with empty tables."""
    store = Store(spark, scratch.root(spark))
    for d in tables:
        store.create_table(d)
    return Database(spark, store)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _refusal(action) -> str:
    """The name of what is raised."""
    try:
        action()
    except TesseraError as e:
        return type(e).__name__
    return "none"


def _module(source: str) -> types.ModuleType:
    """A module of generated text, read without this one's future imports."""
    made = types.ModuleType("made")
    exec(compile(source, "made", "exec", dont_inherit=True), made.__dict__)
    return made


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


# -- sources and handles


@_registered("SELECT r_name, lower(r_name) AS other FROM region WHERE r_regionkey > 0")
def schema_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one name in two schemas."""
    made = [s.table("region", s.column("r_regionkey", I), s.column("r_name", X), schema=name, primary_key=["r_regionkey"]) for name in ("a", "b")]
    db = _empty(spark, *made)
    source = ParquetDirectory(spark, sf_dir).read(REGION).select("r_regionkey", "r_name")
    insert_frame(db, made[0], source)
    insert_frame(db, made[1], source.where("r_regionkey > 0").select("r_regionkey", F.lower("r_name").alias("r_name")))
    a, b = map(TableRef, made)
    return db.frame(select(a, a["r_name"], project(b["r_name"], "other"), joins=(inner_join(b, equal(a["r_regionkey"], b["r_regionkey"])),)))


@_registered(_values("name, found", "('n_name', true)", "('n_nope', false)", "('r_name', false)"))
def column_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(x, _refusal(lambda x=x: nation.col(x)) == "none") for x in ("n_name", "n_nope", "r_name")], "name string, found boolean")


@_registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def lazy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir).query(select(nation, *nation.columns()), NationRow)
    return _rows(spark, [(x.n_nationkey, x.n_name, x.n_regionkey) for x in rows], "n_nationkey long, n_name string, n_regionkey long")


@_registered("SELECT r_regionkey, r_name FROM region")
def collect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select_from(Table(REGION, RegionRow)).all(database(spark, sf_dir))
    return _rows(spark, [(x.r_regionkey, x.r_name) for x in found], "r_regionkey long, r_name string")


@_registered("SELECT c_custkey, n_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def rendered_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's text in Spark's dialect, run as text."""
    db = database(spark, sf_dir)
    db.register(CUSTOMER, NATION)
    made = select(customer, c("c_custkey"), project(n("n_name"), "title"), joins=(inner_join(nation, equal(c("c_nationkey"), n("n_nationkey"))),), where=greater(c("c_acctbal"), 5000.0))
    return db.sql_frame(render(made))


@_registered("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 7 AND n_regionkey = 1")
def rendered_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.register(NATION)
    return db.sql_frame(dynamic_select(nation).select("n_name", "n_regionkey").where(less(n("n_nationkey"), 7)).where_equal("n_regionkey", 1).build(SPARK))


@_registered("SELECT 'all' AS of, n_nationkey FROM nation UNION ALL SELECT 'one', n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'two', n_nationkey FROM nation WHERE n_regionkey = 2")
def builder_immutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, base = database(spark, sf_dir), dynamic_select(nation).select("n_nationkey")
    one, two = base.where_equal("n_regionkey", 1), base.where_equal("n_regionkey", 2)
    frames = [x.frame(db).select(F.lit(name).alias("of"), "n_nationkey") for name, x in (("all", base), ("one", one), ("two", two))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@_registered("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def join_added_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dynamic_select(nation).select("n_name").join(inner_join(region, equal(n("n_regionkey"), r("r_regionkey")))).project(r("r_name"))
    return made.where(not_equal(r("r_name"), "ASIA")).frame(database(spark, sf_dir))


@_registered(_values("name, aggregates", "('COUNT', true)", "('MAX', true)", "('LOWER', false)", "('max_by', false)"))
def aggregate_introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [count(o("o_orderkey")), max_(o("o_orderkey")), lower(o("o_orderstatus")), func("max_by", o("o_orderkey"), o("o_totalprice"))]
    return _rows(spark, [(f.name, f.aggregates) for f in made], "name string, aggregates boolean")


_add("aggregate_any_name", select(orders, o("o_orderstatus"), project(func("max_by", o("o_orderkey"), o("o_totalprice")), "dearest"), project(func("count_if", greater(o("o_totalprice"), 100000.0)), "dear"), group_by=(o("o_orderstatus"),)), "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS dearest, count(*) FILTER (o_totalprice > 100000) AS dear FROM orders GROUP BY 1")
_add("aggregate_bool_or", select(customer, c("c_mktsegment"), project(func("bool_or", less(c("c_acctbal"), 0.0)), "owing"), group_by=(c("c_mktsegment"),)), "SELECT c_mktsegment, bool_or(c_acctbal < 0) AS owing FROM customer GROUP BY 1")

_BIG = s.table("big", s.column("id", s.integer(unsigned=True)), s.column("name", X), primary_key=["id"])
_LEAF = s.table("leaf", s.column("id", I), s.column("big_id", s.integer(unsigned=True)), s.ForeignKeyDef(("big_id",), "big", ("id",)), primary_key=["id"])


@_registered(_values("parent, id", "('18446744073709551615', 1)", "('18446744073709551615', 3)", "('9223372036854775808', 2)"))
def unsigned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys beyond the signed 64 bits, through inserts, foreign keys and the loader."""
    top, half = 2**64 - 1, 2**63
    db = _empty(spark, _BIG, _LEAF)
    db.exec(insert(TableRef(_BIG), ["id", "name"], (top, "top"), (half, "half"), (5, "none")))
    db.exec(insert(TableRef(_LEAF), ["id", "big_id"], (1, top), (2, half), (3, top)))
    leaf = Table(_LEAF, make_dataclass("Leaf", [("id", int), ("big_id", Any)]))
    found = load_has_many(db, leaf, "big_id", [top, half, 5], lambda k: k, lambda x: int(x.big_id))
    return _rows(spark, [(str(k), x.id) for k, leaves in found.items() for x in leaves], "parent string, id long")


# -- typed writes

_NOTE = s.table("memo", s.column("id", I, identity=s.Identity.ALWAYS), s.column("title", X, default="'untitled'"), s.column("size", I, default="3"), primary_key=["id"])


@dataclass(frozen=True)
class Memo:
    id: int
    title: str
    size: int


@_registered(_values("id, title, size", "(1, 'untitled', 9)", "(2, 'untitled', 8)"))
def omitted_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _empty(spark, _NOTE)
    insert_rows(db, Table(_NOTE, Memo), [Memo(0, "not taken", 9), Memo(0, "nor this", 8)], ("title",))
    return db.read(TableRef(_NOTE))


@_registered(_values("id, title, size", "(1, 'untitled', 3)", "(2, 'untitled', 3)", "(3, 'untitled', 3)"))
def default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of nothing but defaults: a statement a row."""
    db = _empty(spark, _NOTE)
    insert_rows(db, Table(_NOTE, Memo), [Memo(0, "", 0)] * 3, ("title", "size"))
    return db.read(TableRef(_NOTE))


@_registered("SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 3) THEN lower(r_name) ELSE r_name END AS r_name FROM region")
def typed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their keys, in one merge."""
    db = scratch(spark, sf_dir)
    table = Table(_S_REGION, RegionRow)
    found = select_from(table).where_in("r_regionkey", [1, 3]).all(db)
    update_rows(db, table, [replace(x, r_name=x.r_name.lower()) for x in found])
    return db.read(sr)


@_registered("SELECT n_nationkey, CASE n_nationkey WHEN 4 THEN 'four' ELSE n_name END AS n_name, n_regionkey FROM nation")
def typed_update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    update_columns(db, Table(_S_NATION, NationRow), NationRow(4, "four", 99), "n_name")
    return db.read(sn)


@_registered(_values("id, title, size", "(1, 'a', 1)", "(2, 'b', 2)"))
def typed_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _empty(spark, _NOTE)
    return _rows(spark, [(x.id, x.title, x.size) for x in insert_returning(db, Table(_NOTE, Memo), [Memo(0, "a", 1), Memo(0, "b", 2)])], "id long, title string, size long")


@_registered("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def returning_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    found = db.query_write_all(delete(sn, where=equal(sn["n_regionkey"], 3)).with_returning(*(sn[x] for x in ("n_name", "n_regionkey", "n_nationkey"))), NationRow)
    return _rows(spark, [(x.n_nationkey, x.n_name.upper(), x.n_regionkey) for x in found], "n_nationkey long, n_name string, n_regionkey long")


@_registered("SELECT 'DecodeError' AS refused, r_regionkey FROM region")
def returning_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row type that would not get all its columns: nothing is deleted."""
    db = scratch(spark, sf_dir)
    refused = _refusal(lambda: db.query_write_all(delete(sr, all_rows=True).with_returning(sr["r_regionkey"]), RegionRow))
    return db.read(sr).select(F.lit(refused).alias("refused"), "r_regionkey")


@_registered(_values("column_name, refused", "('n_name', 'none')", "('n_regionkey', 'none')", "('n_nationkey', 'ValidationError')", "('n_nope', 'ValidationError')"))
def key_not_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, row = Table(_S_NATION, NationRow), NationRow(1, "x", 2)
    chosen = [a.column.name for a in update_statement(table, row).assignments]
    return _rows(spark, [(x, "none") for x in chosen] + [(x, _refusal(lambda x=x: update_statement(table, row, (x,)))) for x in ("n_nationkey", "n_nope")], "column_name string, refused string")


@_registered("SELECT r_regionkey, r_name, 1 AS parts FROM region UNION ALL VALUES (10, 'ten', 1), (11, 'eleven', 1)")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    db.exec(insert(sr, ["r_regionkey", "r_name"], (10, "ten")))
    db.exec(insert(sr, ["r_regionkey", "r_name"], (11, "eleven")))
    db.provider.compact("region")
    return db.read(sr).withColumn("parts", F.lit(len(db.provider.manifest()["tables"]["region"]["parts"])))


# -- hooks, dry runs, rows


@_registered(_values("place, said", "(0, 'one before')", "(1, 'two before')", "(2, 'two after none')", "(3, 'one after none')", "(4, 'one before')", "(5, 'one after HookError')", "(6, 'raised HookError')"))
def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before in order and after in reverse; where a before fails, only the hooks that were entered end."""
    said: list[str] = []
    named = lambda x: Hook(lambda op: said.append(f"{x} before"), lambda op, e: said.append(f"{x} after {type(e).__name__ if e else 'none'}"))

    def fail(op):
        raise RuntimeError("no")

    db, made = database(spark, sf_dir), select(region, r("r_name"))
    db.with_hooks(named("one"), named("two")).all(made)
    said.append(f"raised {_refusal(lambda: db.with_hooks(named('one'), Hook(before=fail), named('three')).all(made))}")
    return _rows(spark, list(enumerate(said)), "place int, said string")


@_registered(_values("kind, args, text_says", "('query', 1, true)", "('exec', 2, true)"))
def operation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = []
    db = replace(scratch(spark, sf_dir), dry_run=True).with_hooks(Hook(seen.append))
    db.all(select(sr, sr["r_name"], where=equal(sr["r_regionkey"], 2)))
    db.exec(update(sr, set_(sr["r_name"], "x"), where=equal(sr["r_regionkey"], 2)))
    return _rows(spark, [(x.kind, len(x.args), x.sql.split()[0] in ("SELECT", "UPDATE")) for x in seen], "kind string, args int, text_says boolean")


@_registered("SELECT r_regionkey, r_name FROM region")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    replace(db, dry_run=True).exec(delete(sr, all_rows=True))
    return db.read(sr)


@_registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def typed_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated function with annotated parameters, for a table that is named with its schema."""
    made = parse("by_customer", 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = {{bind "who" app.orders.o_custkey}} AND o_totalprice > {{bind "least" app.orders.o_totalprice}}')
    module = _module(query_module([made], [s.in_schema(ORDERS, "app")]))
    db = database(spark, sf_dir)
    db.register(ORDERS)
    return db.sql_frame(module.by_customer(7, 1000.0))


class Shouted(str):
    @classmethod
    def scan_value(cls, value: Any) -> Shouted:
        return cls(str(value).upper() + "!")


@_registered("SELECT n_nationkey, upper(n_name) || '!' AS n_name FROM nation")
def value_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = database(spark, sf_dir).all(select(nation, n("n_name"), n("n_nationkey")), make_dataclass("Loud", [("n_nationkey", int), ("n_name", Shouted)]))
    return _rows(spark, [(x.n_nationkey, str(x.n_name)) for x in found], "n_nationkey long, n_name string")


@_registered("SELECT n_nationkey AS key, n_name AS title FROM nation")
def scan_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields find their columns by name, in any order, renamed by metadata; other columns are ignored."""
    kind = make_dataclass("Told", [("title", str, field(metadata={"column": "n_name"})), ("key", int, field(metadata={"column": "n_nationkey"})), ("rest", str, field(default="", metadata={"column": "-"}))])
    found = database(spark, sf_dir).all(select(nation, *nation.columns()), kind)
    return _rows(spark, [(x.key, x.title) for x in found], "key long, title string")


@_registered("SELECT r_regionkey, r_name, 'DecodeError' AS missing FROM region")
def dynamic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = database(spark, sf_dir).all(select(region, *region.columns()))
    return _rows(spark, [(x.get("r_regionkey", int), x.decode(RegionRow).r_name, _refusal(lambda x=x: x.get("nope"))) for x in found], "r_regionkey long, r_name string, missing string")


_CAPABLE = {"postgresql": "CONFLICT_TARGET DEFAULT_VALUES DEFAULT_VALUES_UPSERT IDENTITY LIMIT_IN_MEMBERSHIP OFFSET_WITHOUT_LIMIT PARTIAL_INDEX RETURNING TEXT_WIDTH", "mysql": "DEFAULT_VALUES DEFAULT_VALUES_UPSERT DUPLICATE_KEY_UPDATE TEXT_WIDTH UNSIGNED", "sqlite": "CONFLICT_TARGET DEFAULT_VALUES LIMIT_IN_MEMBERSHIP PARTIAL_INDEX RETURNING"}


@_registered(_values("dialect, flag", *(f"('{d}', '{x}')" for d, flags in _CAPABLE.items() for x in flags.split())))
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(d.name, x.name) for d in DIALECTS.values() if d is not SPARK for x in Can if x in d.can], "dialect string, flag string")


# -- descriptions and inspection

_ACCOUNT = s.table("account", s.column("id", I, identity=s.Identity.ALWAYS), s.column("mail", s.text(40), nullable=True), s.column("owed", s.decimal(8, 2), default="0"), s.column("owner", I, nullable=True), s.UniqueDef(("mail",)), s.CheckDef("owed >= 0", "positive"), s.IndexDef(("owner",), predicate="owner IS NOT NULL"), s.ForeignKeyDef(("owner",), "account", ("id",), on_delete=s.Action.SET_NULL), primary_key=["id"])
_ACCOUNT_TEXT = 'CREATE TABLE "account" ("id" BIGINT GENERATED ALWAYS AS IDENTITY NOT NULL, "mail" VARCHAR(40), "owed" NUMERIC(8,2) NOT NULL DEFAULT 0, "owner" BIGINT, PRIMARY KEY ("id"), UNIQUE ("mail"), CONSTRAINT "positive" CHECK (owed >= 0), FOREIGN KEY ("owner") REFERENCES "account" ("id") ON DELETE SET NULL)'


@_registered(_values("place, text", f"(0, '{_ACCOUNT_TEXT}')", """(1, 'CREATE INDEX "account_owner_idx" ON "account" ("owner") WHERE owner IS NOT NULL')"""))
def create_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(i, x.sql) for i, x in enumerate(create_table(_ACCOUNT, POSTGRESQL))], "place int, text string")


@_registered(_values("id, mail, owed, owner", "(1, 'a@b', 0.0::DOUBLE, NULL)", "(2, NULL, 5.5, 1)"))
def constraints_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, checks, uniques and foreign keys of the store: what breaks one leaves no row."""
    db, t = _empty(spark, _ACCOUNT), TableRef(_ACCOUNT)
    db.exec(insert(t, ["mail"], ("a@b",)))
    db.exec(insert(t, ["owed", "owner"], ("5.50", 1)))
    for bad in (insert(t, ["mail"], ("a@b",)), insert(t, ["owed"], (-1,)), insert(t, ["owner"], (77,)), insert(t, ["mail"], ("x" * 41,))):
        if _refusal(lambda bad=bad: db.exec(bad)) != "ConstraintError":
            raise AssertionError("a broken constraint was not refused")
    return db.read(t).withColumn("owed", F.col("owed").cast("double"))


@_registered("SELECT 'orders' AS table_name, column_name, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN column_type = 'VARCHAR' THEN 'text' WHEN column_type = 'DOUBLE' THEN 'float' ELSE 'time' END AS kind FROM (DESCRIBE orders) UNION ALL SELECT 'nation', column_name, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'integer' ELSE 'text' END FROM (DESCRIBE nation)")
def inspect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = ParquetDirectory(spark, sf_dir)
    return _rows(spark, [(t, x.name, str(x.type.kind)) for t in ("orders", "nation") for x in source.describe(t).columns], "table_name string, column_name string, kind string")


@_registered(_values("column_name, kind, nullable, key", "('n_nationkey', 'integer', false, true)", "('n_name', 'text', false, false)", "('n_regionkey', 'integer', true, false)"))
def inspect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = StoreInspector(_empty(spark, _S_REGION, _S_NATION).provider).table("nation")
    return _rows(spark, [(x.name, str(x.type.kind), x.nullable, x.name in d.primary_key) for x in d.columns], "column_name string, kind string, nullable boolean, key boolean")


@_registered(_values("place, name, of", "(0, 'big', 'all')", "(1, 'leaf', 'all')", "(2, 'x.big', 'all')", "(0, 'leaf', 'included')", "(0, 'big', 'rest')", "(1, 'x.big', 'rest')"))
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables in order, some of them, and all but some; the migration history stays out."""
    store = _empty(spark, replace(_BIG, schema="x"), _BIG, _LEAF).provider
    Runner(store).apply([])
    inspector = StoreInspector(store)
    found = [("all", sweep(inspector)), ("included", sweep(inspector, include=["leaf"])), ("rest", sweep(inspector, exclude=["leaf"]))]
    return _rows(spark, [(i, d.key, of) for of, tables in found for i, d in enumerate(tables)], "place int, name string, of string")


@_registered(_values("asked, refused", "('big', 'AmbiguousTableError')", "('x.big', 'none')", "('nope', 'TableNotFoundError')", "('sweep of nope', 'TableNotFoundError')", "('empty sweep', 'InspectionError')"))
def inspection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [replace(_BIG, schema=x) for x in ("x", "y")]
    inspector, none = (StoreInspector(_empty(spark, *t).provider) for t in (made, []))
    asked = [("big", lambda: inspector.table("big")), ("x.big", lambda: inspector.table("big", "x")), ("nope", lambda: inspector.table("nope")), ("sweep of nope", lambda: sweep(inspector, include=["nope"])), ("empty sweep", lambda: sweep(none))]
    return _rows(spark, [(x, _refusal(f)) for x, f in asked], "asked string, refused string")


@_registered(_values("version, tables", "('before', 1)", "('after', 2)"))
def catalog_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inspector reads one version of the catalogue, whatever comes after."""
    store = _empty(spark, _BIG).provider
    before = StoreInspector(store)
    store.create_table(_LEAF)
    return _rows(spark, [("before", len(before.table_names())), ("after", len(StoreInspector(store).table_names()))], "version string, tables int")


@_registered(_values("said, refused", "('no column', 'ValidationError')", "('two of one name', 'ValidationError')", "('key of an unknown column', 'ValidationError')", "('lists of two lengths', 'ValidationError')", "('relationship without its key', 'ValidationError')", "('nullable key', 'ValidationError')", "('right', 'none')"))
def description_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = s.column("a", I)
    made = [("no column", lambda: s.table("t")), ("two of one name", lambda: s.table("t", a, a)), ("key of an unknown column", lambda: s.table("t", a, primary_key=["b"])), ("lists of two lengths", lambda: s.table("t", a, s.ForeignKeyDef(("a",), "u", ("x", "y")))), ("relationship without its key", lambda: s.table("t", a, s.RelationshipDef("u", "belongs_to", "u", ("a",), ("x",)))), ("nullable key", lambda: s.table("t", s.column("a", I, nullable=True), primary_key=["a"])), ("right", lambda: s.table("t", a, primary_key=["a"]))]
    return _rows(spark, [(x, _refusal(f)) for x, f in made], "said string, refused string")


# -- migrations


def _json(id_: str, up: list[dict], down: list[dict] | None = None) -> Migration:
    return Migration(id_, (("a.up.json", json.dumps(up)),), (("a.down.json", json.dumps(down)),) if down else ())


_M = s.table("extra", s.column("id", I), primary_key=["id"])
_FIRST = _json("001", [{"create_table": _M.to_json()}], [{"drop_table": "extra"}])
_SECOND = _json("002", [{"add_columns": "extra", "columns": [{"name": "x", "type": {"kind": "text"}, "nullable": True}]}], [{"drop_columns": "extra", "columns": ["x"]}])
_clock = lambda: datetime(2024, 1, 1)


@_registered(_values("of, place, id", "('all', 0, '001')", "('all', 1, '002')", "('through', 0, '001')", "('revert', 0, '002')", "('revert', 1, '001')"))
def migrate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    runner, both = Runner(_empty(spark).provider, _clock), [_SECOND, _FIRST]
    found = [("all", runner.plan(both)), ("through", runner.plan(both, "001"))]
    runner.apply(both)
    found.append(("revert", runner.revert_plan(both, steps=2)))
    return _rows(spark, [(of, i, m.id) for of, ms in found for i, m in enumerate(ms)], "of string, place int, id string")


@_registered(_values("id, state, columns", "('001', 'applied', 1)", "('002', 'pending', 1)"))
def migrate_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, both = _empty(spark).provider, [_FIRST, _SECOND]
    runner = Runner(store, _clock)
    runner.apply(both)
    runner.revert(both, steps=1)
    return _rows(spark, [(i, str(x), len(store.definition("extra").columns)) for i, x in runner.status(both)], "id string, state string, columns int")


@_registered(_values("id, state", "('001', 'changed')", "('0015', 'pending')", "('002', 'out_of_order')", "('003', 'unknown')"))
def migrate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    runner, third = Runner(_empty(spark).provider, _clock), replace(_SECOND, id="003", up=(("b.up.json", "[]"),))
    runner.apply([_FIRST, _SECOND, third])
    changed = replace(_FIRST, up=(("a.up.json", "[]"),))
    return _rows(spark, [(i, str(x)) for i, x in runner.status([changed, replace(third, id="0015"), _SECOND])], "id string, state string")


_SUM = hashlib.sha256(b"a.up.json\0" + _FIRST.up[0][1].encode() + b"\0").hexdigest()


@_registered(_values("checksum, history", f"('{_SUM}', '{_SUM}')"))
def migrate_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _empty(spark).provider
    Runner(store, _clock).apply([_FIRST])
    from .migrations.runner import HISTORY_TABLE

    return store.read(HISTORY_TABLE).select(F.lit(_FIRST.checksum).alias("checksum"), F.col("checksum").alias("history"))


@_registered("SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN lower(r_name) ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT r_regionkey + 100, r_name || ';' FROM region WHERE r_regionkey = 4")
def migrate_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL steps are writes of the migration's transaction; of the second migration nothing stays."""
    db = scratch(spark, sf_dir)
    runner = Runner(db.provider, _clock)
    good = Migration("001", (("a.up.sql", "UPDATE region SET r_name = lower(r_name) WHERE r_regionkey < 2; INSERT INTO region SELECT r_regionkey + 100, r_name || ';' FROM region WHERE r_regionkey = 4; DELETE FROM nation; DELETE FROM region WHERE r_regionkey = 3"),))
    runner.apply([good])
    broken = Migration("002", (("a.up.sql", "DELETE FROM region; INSERT INTO region VALUES (1, 'x'), (1, 'y')"),))
    if _refusal(lambda: runner.apply([good, broken])) != "MigrationError":
        raise AssertionError("a broken migration was not refused")
    return db.read(sr)


@_registered(_values("said, refused", "('held', 'TransactionError')", "('free', 'none')"))
def migrate_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _empty(spark).provider
    store.lock_seconds = 0.2
    runner = Runner(store, _clock)
    with store.lock("migrations"):
        held = _refusal(lambda: runner.apply([_FIRST]))
    return _rows(spark, [("held", held), ("free", _refusal(lambda: runner.apply([_FIRST])))], "said string, refused string")


_WIDER = replace(_M, columns=(*_M.columns, s.column("x", X, nullable=True)), indexes=(s.IndexDef(("x",)),))


@_registered(_values("place, step", "(0, 'create_table account')", "(1, 'add_columns extra')", "(2, 'add_indexes extra')"))
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive changes in an order that is always the same."""
    store = _empty(spark, _M).provider
    changes = diff_schemas(StoreInspector(store).tables.values(), [_WIDER, _ACCOUNT])
    Runner(store, _clock).apply([_json("001", [x.up for x in changes])])
    if StoreInspector(store).table("extra") != _WIDER:
        raise AssertionError("the migration does not lead to the desired schema")
    return _rows(spark, [(i, f"{k} {v['name'] if isinstance(v, dict) else v}") for i, x in enumerate(changes) for k, v in [next(iter(x.up.items()))]], "place int, step string")


@_registered(_values("said, refused", "('backfill', 'ManualMigrationError')", "('drop', 'ManualMigrationError')", "('change', 'ManualMigrationError')", "('same', 'none')"))
def diff_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [("backfill", [replace(_M, columns=(*_M.columns, s.column("must", X)))]), ("drop", []), ("change", [replace(_M, columns=(s.column("id", X),))]), ("same", [_M])]
    return _rows(spark, [(x, _refusal(lambda w=w: diff_schemas([_M], w))) for x, w in wanted], "said string, refused string")


@_registered(_values("said, value", "('loaded', '010')", "('undone by', '1')", "('again', 'MigrationError')", "('unpaired', 'MigrationError')"))
def migration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration's folder is written at once and read back; one that is there, or half there, is refused."""
    with tempfile.TemporaryDirectory() as root:
        write = lambda: write_migration(root, "010", "wider", diff_schemas([_M], [_WIDER]))
        folder, loaded = write(), load_directory(root)
        rows = [("loaded", loaded[0].id), ("undone by", str(len(loaded[0].down))), ("again", _refusal(write))]
        (folder / "002_x.up.json").write_text("[]")
        rows.append(("unpaired", _refusal(lambda: load_directory(root))))
    return _rows(spark, rows, "said string, value string")


@_registered(_values("place, name", "(0, 'big')", "(1, 'leaf')"))
def schema_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live schema as JSON, referenced tables first; it leads back to the same tables."""
    store, out = _empty(spark, _BIG, _LEAF).provider, io.StringIO()
    with redirect_stdout(out):
        cli.main(["--store", store.root, "dump"], spark)
    dumped = [s.TableDef.from_json(x) for x in json.loads(out.getvalue())]
    if dumped != [_BIG, _LEAF]:
        raise AssertionError("the dump does not describe the tables")
    return _rows(spark, [(i, d.key) for i, d in enumerate(dumped)], "place int, name string")


@_registered(_values("verb, code, said", "('diff-live', 0, 'create_table extra')", "('diff', 0, '')", "('plan', 0, '001')", "('apply', 0, '001')", "('status', 0, '001 applied')", "('verify', 0, '001 applied')", "('diff-live', 0, '')", "('revert', 0, '001')", "('verify', 1, '001 pending')"))
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = _empty(spark).provider, []
    with tempfile.TemporaryDirectory() as root:
        schema = Path(root) / "schema.json"
        schema.write_text(json.dumps([_M.to_json()]))
        for verb, *more in (["diff-live", "--schema", str(schema)], ["diff", "--schema", str(schema), "--id", "001", "--name", "extra"], ["plan"], ["apply"], ["status"], ["verify"], ["diff-live", "--schema", str(schema)], ["revert", "--steps", "1"], ["verify"]):
            out = io.StringIO()
            with redirect_stdout(out):
                code = cli.main(["--store", store.root, verb, "--migrations", f"{root}/m", *more], spark)
            said = " ".join(out.getvalue().split())
            rows.append((verb, code, "" if verb == "diff" else said))
    return _rows(spark, rows, "verb string, code int, said string")


@_registered(_values("place, step", "(0, 'create_table account')", "(1, 'add_indexes big')"))
def diff_of_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference to a schema that is given as DDL text; the store's own tables, dumped as DDL, differ in nothing."""
    store, out = _empty(spark, replace(_BIG, columns=(s.column("id", I), s.column("name", s.text())))).provider, io.StringIO()
    with tempfile.TemporaryDirectory() as root, redirect_stdout(out):
        path = Path(root) / "schema.sql"
        cli.main(["--store", store.root, "dump", "--dialect", "postgresql"], spark)
        path.write_text(out.getvalue())
        if cli.main(["--store", store.root, "diff-live", "--schema", str(path)], spark) or out.getvalue() != path.read_text():
            raise AssertionError("a dumped schema differs from its store")
        said = out.getvalue()
        path.write_text(f"{said} CREATE INDEX by_name ON big (name); " + "; ".join(x.sql for x in create_table(_ACCOUNT, POSTGRESQL)))
        cli.main(["--store", store.root, "diff-live", "--schema", str(path)], spark)
    return _rows(spark, list(enumerate(out.getvalue()[len(said) :].split("\n")[:-1])), "place int, step string")


# -- generated code


@_registered("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def generated_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row classes, tables and a relationship loader that were generated from descriptions."""
    child = replace(_S_NATION, relationships=(s.RelationshipDef("region", "belongs_to", "region", ("n_regionkey",), ("r_regionkey",)),)).validate()
    with tempfile.TemporaryDirectory() as root:
        path, source = Path(root) / "made.py", store_module([_S_REGION, child])
        if not (write_module(path, source) and check_module(path, source) and not write_module(path, source)):
            raise AssertionError("a written module is not up to date")
    made = _module(source)
    db = scratch(spark, sf_dir)
    rows = select_from(made.nation).all(db)
    owners = made.nation_region(db, rows)
    return _rows(spark, [(x.n_nationkey, x.n_name, owners[x.n_regionkey].r_name) for x in rows], "n_nationkey long, n_name string, r_name string")


@_registered("SELECT n_name FROM nation WHERE n_regionkey = 2")
def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions from a settings file."""
    with tempfile.TemporaryDirectory() as root:
        path = Path(root) / "settings.json"
        path.write_text(json.dumps({"out": "made_store.py", "queries_out": "made_queries.py", "include": ["nation"], "queries": [{"function": "of_region", "sql": 'SELECT n_name FROM nation WHERE n_regionkey = {{bind "key" nation.n_regionkey}}'}]}))
        written = Settings.load(path).write([NATION])
        module = _module(next(Path(x).read_text() for x in written if Path(x).name == "made_queries.py"))
    db = database(spark, sf_dir)
    db.register(NATION)
    return db.sql_frame(module.of_region(2))


# -- streams


@_registered("SELECT n_nationkey, lower(n_name) AS title FROM nation WHERE n_regionkey > 1")
def stream_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateless SELECT on a stream of files, run until it has read what is there."""
    root = scratch.root(spark)
    ParquetDirectory(spark, sf_dir).read(NATION).select(*(F.col(x.name).cast(x.type.spark()) for x in NATION.columns)).write.parquet(f"{root}/in/nation")
    made = select(nation, n("n_nationkey"), project(lower(n("n_name")), "title"), where=greater(n("n_regionkey"), 1))
    stream = Database(spark, StreamDirectory(spark, f"{root}/in")).frame(made)
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("n_nationkey long, title string").parquet(f"{root}/out")
