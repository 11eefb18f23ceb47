"""Statements on Spark: null logic against DuckDB, decoding, terminals, hooks."""

import dataclasses
import itertools
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import Row

from tessera.errors import DecodeError, HookError, MultipleRowsError, NoRowsError, QueryError, ValidationError
from tessera.operators.builder import Table, decode_from, dynamic_select, select_from
from tessera.operators.database import Database, Hook
from tessera.operators.decode import DynamicRow, UInt64, convert, decode, snake_case
from tessera.operators.relations import load_belongs_to, load_has_many
from tessera.plans import schema as s
from tessera.plans.nodes import Projection, TableRef, and_, asc, bind, count_all, desc, equal, func, greater, in_, in_select, is_null, like, max_, negate, not_in, not_in_select, or_, project, scalar, select, sum_

A = s.table("a", s.column("id", s.integer()), s.column("x", s.integer(), nullable=True), s.column("t", s.text(), nullable=True), primary_key=["id"])
a = TableRef(A)
ROWS = [(1, 1, "ab"), (2, None, "a%b"), (3, 3, None), (4, 1, "AB"), (5, 9, "")]


class Memory:
    def __init__(self, spark):
        self.frame = spark.createDataFrame(ROWS, A.struct())

    def read(self, definition):
        return self.frame


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark, Memory(spark))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("create table a (id bigint, x bigint, t varchar)")
    con.executemany("insert into a values (?, ?, ?)", ROWS)
    return con


SETS = {"empty": ("x > 100", greater(a["x"], 100)), "plain": ("x = 1", equal(a["x"], 1)), "null": ("x IS NULL", is_null(a["x"])), "mixed": ("id <> 3", or_(negate(equal(a["id"], 3)), equal(a["id"], 77)))}


@pytest.mark.parametrize("name,negated", list(itertools.product(SETS, (False, True))))
def test_membership_is_three_valued(db, duck, name, negated):
    said, condition = SETS[name]
    make = not_in_select if negated else in_select
    e = make(a["x"], select(a, a["x"], where=condition))
    op = "NOT IN" if negated else "IN"
    sub = f"x {op} (SELECT x FROM a WHERE {said})"
    made = select(a, a["id"], project(e, "m"), project(is_null(e), "n"), where=or_(e, negate(e), is_null(e)), order=(asc(a["id"]),))
    assert [tuple(r.values) for r in db.all(made)] == duck.execute(f"SELECT id, {sub} m, ({sub}) IS NULL n FROM a ORDER BY id").fetchall()
    assert [r["id"] for r in db.all(select(a, a["id"], where=e, order=(asc(a["id"]),)))] == [r[0] for r in duck.execute(f"SELECT id FROM a WHERE {sub} ORDER BY id").fetchall()]
    grouped = db.all(select(a, project(e, "m"), project(count_all(), "n"), group_by=(e,)))
    assert sorted((str(r["m"]), r["n"]) for r in grouped) == sorted((str(m), n) for m, n in duck.execute(f"SELECT {sub} m, count(*) FROM a GROUP BY 1").fetchall())


def test_lists_like_and_order(db, duck):
    assert [r["id"] for r in db.all(select(a, a["id"], where=not_in(a["x"], 1, None)))] == []
    assert [r["id"] for r in db.all(select(a, a["id"], where=in_(a["x"], a["id"], 9), order=(asc(a["id"]),)))] == [1, 3, 5]
    assert [r["id"] for r in db.all(select(a, a["id"], where=like(a["t"], "a\\%b")))] == [2]
    assert [r["id"] for r in db.all(select(a, a["id"], where=like(a["t"], "\\a_")))] == [1]
    with pytest.raises(ValidationError):
        db.all(select(a, a["id"], where=like(a["t"], "a\\")))
    assert [r["x"] for r in db.all(select(a, a["x"], order=(asc(a["x"]), asc(a["id"]))))] == [None, 1, 1, 3, 9]
    assert [r["id"] for r in db.all(select(a, a["id"], order=(desc(bind(1)), desc(a["id"])), limit=2))] == [5, 4]
    assert [r["id"] for r in db.all(select(a, a["id"], order=(desc(in_select(a["id"], select(a, a["x"]))), asc(a["id"])), limit=1))] == [1]
    with pytest.raises(QueryError):
        db.all(select(a, a["x"], distinct=True, order=(asc(a["id"]),)))
    with pytest.raises(QueryError):
        db.all(select(a, a["id"], a["x"], group_by=(a["x"],)))
    with pytest.raises(QueryError):
        db.all(select(a, project(scalar(select(a, a["id"])), "v")))
    assert db.one(select(a, project(func("listagg", a["t"]).with_distinct(), "v"), where=equal(a["id"], 1)))["v"] == "ab"
    got = db.all(select(a, a["x"], project(func("collect_list", a["id"]), "ids"), group_by=(a["x"],), order=(asc(a["x"]),)))
    assert [sorted(r["ids"]) for r in got] == [[2], [1, 4], [3], [5]]


@dataclasses.dataclass
class Out:
    id: int
    x: int | None
    T: str | None = dataclasses.field(metadata={"column": "t"})


def test_builders_and_terminals(db):
    table = Table(A, Out)
    q = select_from(table)
    assert q.where_equal("id", 1).one(db) == Out(1, 1, "ab")
    assert q.where_in("id", [2, 3]).order_desc("id").all(db) == [Out(3, 3, None), Out(2, None, "a%b")]
    assert len(q.all(db)) == 5 and q.where(greater(a["id"], 100)).all(db) == []
    with pytest.raises(NoRowsError):
        q.where_equal("id", 77).one(db)
    with pytest.raises(MultipleRowsError):
        q.one(db)
    assert q.order_asc("id").count(db) == 5
    for wrong in (q.limit(1), q.offset(1), q.distinct(), q.group_by_columns("id")):
        with pytest.raises(ValidationError):
            wrong.count(db)
    broken = q.where_in("id", []).limit(3)
    with pytest.raises(ValidationError):
        broken.build()
    assert q.limit(2).build().sql != q.build().sql
    seen = []
    hooked = db.with_hooks(Hook(lambda op: seen.append(("before", op.kind)), lambda op, e: seen.append(("after 1", e))), Hook(None, lambda op, e: seen.append(("after 2", e))))
    rows = q.query(hooked)
    assert seen == []
    assert next(rows).id in range(1, 6)
    assert seen == [("before", "query"), ("after 2", None), ("after 1", None)]
    assert dynamic_select(a).select("id").where_equal("id", 4).one(db).as_dict() == {"id": 4}
    assert decode_from(a, Out).project(*(Projection(c) for c in a.columns())).where_equal("id", 1).one(db).T == "ab"
    assert db.all(select(a, project(sum_(a["x"]), "s"), project(max_(a["t"]), "m")))[0].values == (14, "ab")
    dry = dataclasses.replace(db, dry_run=True)
    assert q.all(dry) == [] and list(q.query(dry)) == []

    class Failing:
        def __call__(self, op, e=None):
            raise RuntimeError("no")

    seen.clear()
    chained = db.with_hooks(Hook(lambda op: seen.append("one"), lambda op, e: seen.append(("after one", type(e)))), Hook(before=Failing(), after=lambda op, e: seen.append("never")), Hook(lambda op: seen.append("never")))
    with pytest.raises(HookError) as failed:
        q.all(chained)
    assert isinstance(failed.value.__cause__, RuntimeError) and seen == ["one", ("after one", HookError)]
    with pytest.raises(HookError):
        next(q.query(chained))
    with pytest.raises(ExceptionGroup):
        q.all(db.with_hooks(Hook(after=Failing())))


def test_relations(db):
    table = Table(A, Out)
    parents = [Out(1, None, None), Out(7, None, None), Out(1, None, None)]
    many = load_has_many(db, table, "x", parents, lambda p: p.id, lambda c: c.x)
    assert sorted(c.id for c in many[1]) == [1, 4] and many[7] == []
    owners = load_belongs_to(db, table, "id", [Out(5, 1, None), Out(6, None, None)], lambda r: r.x, lambda c: c.id)
    assert owners == {1: Out(1, 1, "ab")}
    assert load_has_many(db, table, "x", [], lambda p: p.id, lambda c: c.x) == {}


def test_decoding():
    assert convert(3, float) == 3.0 and convert(1, bool) is True and convert(b"x", str) == "x" and convert("x", bytes) == b"x"
    assert convert(Decimal("1.50"), str) == "1.50" and convert(Decimal(2**64 - 1), UInt64) == 2**64 - 1
    assert convert("2024-01-02 03:04:05", datetime) == datetime(2024, 1, 2, 3, 4, 5)
    assert convert(None, int | None) is None
    for value, kind in ((None, int), (2**63, int), (-1, UInt64), (1.5, int), ("x", int), (True, int), ("soon", datetime)):
        with pytest.raises(DecodeError):
            convert(value, kind)
    assert decode(Row("id", "x", "t", "more")(1, 2, "3", 4), Out) == Out(1, 2, "3")
    with pytest.raises(DecodeError):
        decode(Row("id", "x")(1, 2), Out)
    with pytest.raises(DecodeError):
        DynamicRow(("a", "a"), (1, 2))
    with pytest.raises(DecodeError):
        DynamicRow(("a",), (1,))["b"]
    assert [snake_case(x) for x in ("UserID", "createdAt", "HTTPCode")] == ["user_id", "created_at", "http_code"]


def test_pushdown(spark, tmp_path):
    from tessera.sources import ParquetDirectory

    spark.createDataFrame(ROWS, A.struct()).write.parquet(f"{tmp_path}/a.parquet")
    frame = Database(spark, ParquetDirectory(spark, str(tmp_path))).frame(select(a, a["id"], where=and_(greater(a["x"], 1), equal(a["id"], 3))))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "ReadSchema: struct<id:bigint,x:bigint>" in plan
