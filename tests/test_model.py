"""Descriptions, statements that are refused, and their counterparts that are accepted."""

import pytest

from tessera.errors import CapabilityError, ValidationError
from tessera.plans import schema as s
from tessera.plans.ddl import parse_ddl
from tessera.plans.dialect import MYSQL, POSTGRESQL, SPARK, SQLITE
from tessera.plans.nodes import (
    Compare, Delete, Function, Logical, Membership, TableRef, and_, asc, avg, bind, call, coalesce, count, count_all, delete, desc, equal, excluded, func, greater, in_, in_select,
    inner_join, insert, is_null, left_join, like, lower, max_, min_, negate, not_in_select, or_, project, scalar, select, set_, sum_, update, upsert, default_insert,
)
from tessera.plans.render import create_table, precompiled, render
from tessera.plans.templates import parse

USERS = s.table("users", s.column("id", s.integer()), s.column("email", s.text()), primary_key=["id"])
ORDERS = s.table("orders", s.column("id", s.integer()), s.column("user_id", s.integer()), s.column("amount", s.float_()), s.column("made", s.integer(), generated="id * 2", stored=True), primary_key=["id"])
u, o = TableRef(USERS), TableRef(ORDERS)


def test_types_and_tables_refuse_contradictions():
    def bad(*parts, **kw):
        with pytest.raises(ValidationError):
            s.table("t", *parts, **kw)

    for t in (s.decimal(0, 0), s.ColumnType(s.Kind.DECIMAL, precision=5), s.decimal(3, 4), s.text(-1), s.ColumnType(s.Kind.TEXT, fixed=True), s.ColumnType(s.Kind.TEXT, unsigned=True), s.ColumnType(s.Kind.BOOLEAN, precision=1)):
        bad(s.column("a", t))
    i = s.integer()
    bad()
    bad(s.column("a", i), s.column("a", i))
    bad(s.column("1a", i))
    bad(s.column("a", i, generated="1"))
    bad(s.column("a", i, generated="1", stored=True, default="1"))
    bad(s.column("a", i, identity=s.Identity.ALWAYS, default="1"))
    bad(s.column("a", i, identity=s.Identity.ALWAYS, nullable=True))
    bad(s.column("a", s.text(), identity=s.Identity.ALWAYS))
    bad(s.column("a", i), primary_key=["b"])
    bad(s.column("a", i, nullable=True), primary_key=["a"])
    bad(s.column("a", i), s.UniqueDef(()))
    bad(s.column("a", i), s.UniqueDef(("a", "a")))
    bad(s.column("a", i), s.CheckDef(" "))
    bad(s.column("a", i), s.UniqueDef(("a",), "k"), s.CheckDef("a > 0", "k"))
    bad(s.column("a", i), s.ForeignKeyDef(("a",), "x", ("p", "q")))
    bad(s.column("a", i), s.ForeignKeyDef(("a",), "x", ("p",), on_delete=s.Action.SET_NULL))
    bad(s.column("a", i), s.RelationshipDef("r", "belongs_to", "x", ("a",), ("p",)))
    assert s.TableDef.from_json(ORDERS.to_json()) == ORDERS
    with pytest.raises(CapabilityError):
        s.decimal(40, 2).spark()
    assert s.integer(unsigned=True).spark().simpleString() == "decimal(20,0)"


@pytest.mark.parametrize(
    "make",
    [
        lambda: select(u),
        lambda: select(u, u["nope"]),
        lambda: select(u, o["id"]),
        lambda: select(u, u["id"], joins=(inner_join(u, equal(u["id"], 1)),)),
        lambda: select(u, u["id"], joins=(inner_join(o.as_("users"), equal(u["id"], 1)),)),
        lambda: select(u, u["id"], joins=(left_join(o, equal(TableRef(USERS, "x")["id"], 1)),)),
        lambda: select(u, u["id"], limit=-1),
        lambda: select(u, u["id"], offset=-1),
        lambda: select(u, u["id"], limit=True),
        lambda: select(u, u["id"], where=equal(count_all(), 1)),
        lambda: select(u, u["id"], where=greater(coalesce(max_(u["id"]), 0), 1)),
        lambda: select(u, u["id"], count_all()),
        lambda: select(u, sum_(max_(u["id"]))),
        lambda: select(u, sum_(coalesce(max_(u["id"]), 0))),
        lambda: select(u, u["id"], having=greater(u["id"], 1)),
        lambda: select(u, count_all(), having=greater(u["id"], 1)),
        lambda: select(u, count_all(), order=(asc(u["id"]),)),
        lambda: select(u, u["id"], order=(asc(count_all()),)),
        lambda: select(u, count_all(), group_by=(bind(1),)),
        lambda: select(u, count_all(), group_by=(max_(u["id"]),)),
        lambda: select(u, u["id"], where=in_(u["id"])),
        lambda: select(u, u["id"], where=in_(u["id"], scalar(select(o, max_(o["id"]))))),
        lambda: select(u, u["id"], where=in_select(u["id"], select(o, o["id"], o["user_id"]))),
        lambda: select(u, project(u["id"], "not a name")),
        lambda: select(u, Function("COUNT", (u["id"],), star=True)),
        lambda: select(u, Function("COUNT", (), star=True, distinct=True)),
        lambda: select(u, Function("SUM", (), star=True)),
        lambda: select(u, call("COALESCE", u["id"])),
        lambda: select(u, lower(u["email"]).with_distinct()),
        lambda: select(u, func("drop table", u["id"])),
        lambda: call("NULLIF", u["id"], 1),
        lambda: select(u, u["id"], where=Logical("AND", (equal(u["id"], 1),))),
        lambda: select(u, u["id"], where=Compare(u["id"], "~", bind(1))),
        lambda: select(u, excluded(u["id"])),
        lambda: insert(u, ["id"], (1, 2)),
        lambda: insert(u, ["id", "id"], (1, 2)),
        lambda: insert(u, ["id"], (u["id"],)),
        lambda: insert(u, ["id"], (scalar(select(o, max_(o["id"]))),)),
        lambda: insert(u, ["id"]),
        lambda: insert(o, ["made"], (1,)),
        lambda: insert(u.as_("x"), ["id"], (1,)),
        lambda: update(u, set_(u["id"], 1)).validate(),
        lambda: update(u, set_(u["id"], 1), where=equal(u["id"], 1), all_rows=True).validate(),
        lambda: update(u, set_(u["id"], 1), set_(u["id"], 2), all_rows=True).validate(),
        lambda: update(u, set_(o["id"], 1), all_rows=True).validate(),
        lambda: update(u, all_rows=True).validate(),
        lambda: Delete(u).validate(),
        lambda: delete(u, where=in_select(u["id"], select(o, o["id"]))).validate(),
        lambda: upsert(insert(u, ["id"], (1,))),
        lambda: upsert(insert(u, ["id"], (1,)).with_returning(u["id"]), [u["id"]]),
        lambda: upsert(insert(u, ["id"], (1,)), [u["id"], u["id"]]),
        lambda: upsert(insert(u, ["id"], (1,)), [o["id"]]),
        lambda: insert(u, ["id"], (1,)).with_returning(count_all()),
    ],
)
def test_refused(make):
    with pytest.raises(ValidationError):
        make()


def test_accepted():
    select(u, u["id"], joins=(inner_join(u.as_("x"), equal(u["id"], u.as_("x")["id"])),))
    select(TableRef(s.in_schema(USERS, "a")), TableRef(s.in_schema(USERS, "a"))["id"], joins=(inner_join(TableRef(s.in_schema(USERS, "b")), equal(TableRef(s.in_schema(USERS, "b"))["id"], 1)),))
    select(u, coalesce(max_(u["id"]), 0), having=greater(count_all(), 0), order=(desc(min_(u["id"])),))
    select(o, o["user_id"], group_by=(o["user_id"],), order=(desc(sum_(o["amount"])),), having=in_(count_all(), 1, 2))
    select(u, count(u["id"]).with_distinct(), group_by=(is_null(u["email"]),))
    upsert(insert(u, ["id", "email"], (1, "a")), [u["id"]], set_(u["email"], coalesce(excluded(u["email"]), u["email"])))


def test_rendering():
    made = select(u, u["id"], project(lower(u["email"]), "mail"), joins=(left_join(o, equal(o["user_id"], u["id"])),), where=and_(in_(u["id"], 1, 2), or_(negate(like(u["email"], "a%")), not_in_select(u["id"], select(o, o["user_id"], where=equal(o["amount"], 3.5))))), order=(desc(u["id"]),), limit=5, offset=6)
    got = render(made, POSTGRESQL)
    assert got.sql == 'SELECT "users"."id", LOWER("users"."email") AS "mail" FROM "users" LEFT JOIN "orders" ON ("orders"."user_id" = "users"."id") WHERE (("users"."id" IN ($1, $2)) AND ((NOT ("users"."email" LIKE $3)) OR ("users"."id" NOT IN (SELECT "orders"."user_id" FROM "orders" WHERE ("orders"."amount" = $4))))) ORDER BY "users"."id" DESC LIMIT $5 OFFSET $6'
    assert got.args == (1, 2, "a%", 3.5, 5, 6)
    assert "`users`.`id` IN (?, ?)" in render(made, MYSQL).sql
    assert render(select(u, u["id"], offset=2), SQLITE).sql.endswith(" LIMIT -1 OFFSET ?")
    page = select(u, u["id"], where=in_select(u["id"], select(o, o["id"], limit=1)))
    with pytest.raises(CapabilityError):
        render(page, MYSQL)
    up = upsert(insert(u, ["id", "email"], (1, "a")), [u["id"]], set_(u["email"], excluded(u["email"])))
    assert render(up, POSTGRESQL).sql == 'INSERT INTO "users" ("id", "email") VALUES ($1, $2) ON CONFLICT ("id") DO UPDATE SET "email" = EXCLUDED."email"'
    free = upsert(insert(u, ["id", "email"], (1, "a")), [], set_(u["email"], excluded(u["email"])))
    assert render(free, MYSQL).sql.endswith("ON DUPLICATE KEY UPDATE `email` = VALUES(`email`)")
    # its clause can neither keep to the named key nor do nothing
    for refused in (up, upsert(insert(u, ["id"], (1,)), [u["id"]])):
        with pytest.raises(CapabilityError):
            render(refused, MYSQL)
    assert render(upsert(insert(u, ["id"], (1,)), [u["id"]]), SQLITE).sql.endswith('ON CONFLICT ("id") DO NOTHING')
    assert render(default_insert(u), POSTGRESQL).sql == 'INSERT INTO "users" DEFAULT VALUES'
    with pytest.raises(CapabilityError):
        render(up.with_returning(u["id"]), MYSQL)
    with pytest.raises(CapabilityError):
        render(upsert(insert(u, ["id"], (1,)), [], set_(u["email"], "x")), SQLITE)
    with pytest.raises(CapabilityError):
        render(select(u, u["id"], where=in_(u["id"], *range(40000))), SQLITE)
    with pytest.raises(ValidationError):
        precompiled("  ")


def test_create_table_text():
    d = s.table("t", s.column("id", s.integer(), identity=s.Identity.ALWAYS), s.column("n", s.text(5), nullable=True), s.column("d", s.decimal(6, 2), default="0"), s.CheckDef("d >= 0", "pos"), s.IndexDef(("n",), predicate="n IS NOT NULL"), s.ForeignKeyDef(("n",), "x", ("k",), on_delete=s.Action.SET_NULL), primary_key=["id"])
    table, index = create_table(d, POSTGRESQL)
    assert table.sql == 'CREATE TABLE "t" ("id" BIGINT GENERATED ALWAYS AS IDENTITY NOT NULL, "n" VARCHAR(5), "d" NUMERIC(6,2) NOT NULL DEFAULT 0, PRIMARY KEY ("id"), CONSTRAINT "pos" CHECK (d >= 0), FOREIGN KEY ("n") REFERENCES "x" ("k") ON DELETE SET NULL)'
    assert index.sql == 'CREATE INDEX "t_n_idx" ON "t" ("n") WHERE n IS NOT NULL'
    for dialect in (MYSQL, SPARK):
        with pytest.raises(CapabilityError):
            create_table(d, dialect)
    with pytest.raises(CapabilityError):
        create_table(s.table("t", s.column("a", s.integer()), s.ExclusionDef("a WITH =")), POSTGRESQL)
    with pytest.raises(CapabilityError):
        create_table(s.table("t", s.column("a", s.integer(unsigned=True))), POSTGRESQL)


def test_templates():
    t = parse("q", 'SELECT * FROM users WHERE id = {{bind "id" users.id}} OR email = {{ bind "mail" users.email }} OR id + 1 = {{bind "id"}}')
    assert t.parameters == ("id", "mail")
    assert t.compile(POSTGRESQL).sql.endswith("id = $1 OR email = $2 OR id + 1 = $1")
    got = t.compile(SPARK).bind({"id": 3, "mail": "x"})
    assert got.args == (3, "x", 3)
    with pytest.raises(ValidationError):
        t.compile().bind({"id": 3})
    with pytest.raises(ValidationError):
        t.compile().bind({"id": 3, "mail": "x", "more": 1})
    assert "def q(id: int, mail: str) -> Statement:" in t.compile().python_source({"users": USERS})
    for wrong in ("{{if x}}", "SELECT {{bind id}}", "SELECT {{", " "):
        with pytest.raises(ValidationError):
            parse("q", wrong)
    assert avg(u["id"]).aggregates and not func("avg", u["id"]).aggregates
    assert isinstance(in_(u["id"], 1), Membership)


def test_ddl_text_reads_back():
    full = s.table("t", s.column("id", s.integer(), identity=s.Identity.ALWAYS), s.column("n", s.text(5), nullable=True), s.column("f", s.text(3, fixed=True), default="'a,)'' b'"), s.column("d", s.decimal(6, 2), default="(1 + 2) * 3"), s.column("u", s.uuid()), s.column("at", s.time(), nullable=True), s.column("ok", s.boolean(), default="NULL", nullable=True), s.column("x", s.float_()), s.column("j", s.json_()), s.column("b", s.bytes_()), s.column("twice", s.decimal(6, 2), nullable=True, generated="d * (2)", stored=True), s.CheckDef("d >= 0 AND (n <> ')')", "pos"), s.UniqueDef(("n", "f")), s.UniqueDef(("f",), "only"), s.IndexDef(("n",), predicate="n IS NOT NULL"), s.IndexDef(("x",), "by_x", unique=True), s.ForeignKeyDef(("n",), "x", ("k",), schema="app", name="far", on_delete=s.Action.SET_NULL, on_update=s.Action.CASCADE), schema="app", primary_key=["id"])
    plain = s.table("p", s.column("id", s.integer()), s.column("big", s.integer(unsigned=True), nullable=True), s.column("said", s.text()), primary_key=["id"])
    assert parse_ddl("".join(f"{x.sql};\n" for x in create_table(full, POSTGRESQL))) == [full]
    assert parse_ddl(";".join(x.sql for x in create_table(plain, MYSQL))) == [plain]
    (made,) = parse_ddl("""-- a comment; with a semicolon
        create table if not exists people (id serial primary key, mail varchar(40) unique default 'a;b' not null /* must */,
            boss int references people (id) on delete set null, born timestamp with time zone check (born > '1900-01-01'), constraint c check (id > 0));
        CREATE UNIQUE INDEX IF NOT EXISTS "by_boss" ON people (boss) WHERE boss > 0""")
    assert made == s.table("people", s.column("id", s.integer(), identity=s.Identity.BY_DEFAULT), s.column("mail", s.text(40), default="'a;b'"), s.column("boss", s.integer(), nullable=True), s.column("born", s.time(), nullable=True), s.UniqueDef(("mail",)), s.CheckDef("born > '1900-01-01'"), s.CheckDef("id > 0", "c"), s.IndexDef(("boss",), "by_boss", True, "boss > 0"), s.ForeignKeyDef(("boss",), "people", ("id",), on_delete=s.Action.SET_NULL), primary_key=["id"])
    assert parse_ddl(" ;; ") == []
    for wrong in ("DROP TABLE t", "CREATE TABLE t (a INT", "CREATE TABLE t (a POINT)", "CREATE TABLE t (a INT STRANGE)", "CREATE TABLE t (a INT) ENGINE x", "CREATE INDEX i ON t (a)", "CREATE TABLE t (a INT); CREATE TABLE t (a INT)", "CREATE VIEW v AS SELECT 1", "CREATE TABLE t (a NUMERIC)", "CREATE TABLE t (a INT, CONSTRAINT x b INT)", "CREATE TABLE t (a INT DEFAULT)", "CREATE TABLE t (a INT CHECK (a > 0)"):
        with pytest.raises(ValidationError):
            parse_ddl(wrong)
