"""Writes, constraints, transactions, inspection, migrations, generated code."""

import dataclasses
import json
import types
from datetime import datetime

import pytest

from tessera import cli
from tessera.codegen import check_module, query_module, store_module, write_module
from tessera.codegen.settings import Settings
from tessera.errors import AmbiguousTableError, CapabilityError, ConstraintError, DecodeError, InspectionError, ManualMigrationError, MigrationError, TableNotFoundError, TransactionError, ValidationError
from tessera.migrations import Migration, Runner, diff_schemas, load_directory, write_migration
from tessera.operators.builder import Table, delete_from
from tessera.operators.database import Database
from tessera.operators.typed import insert_returning, insert_rows, update_columns, update_row, update_rows, update_where
from tessera.operators.writes import insert_frame
from tessera.plans import schema as s
from tessera.plans.nodes import TableRef, default_insert, delete, equal, excluded, greater, insert, lower, project, set_, update, upper, upsert
from tessera.plans.templates import parse
from tessera.sources import Store
from tessera.sources.catalog import SparkInspector, StoreInspector, sweep

I, X = s.integer(), s.text()
P = s.table("p", s.column("id", I), s.column("name", s.text(5)), s.UniqueDef(("name",)), s.CheckDef("id < 1000", "small"), primary_key=["id"])
C = s.table("c", s.column("id", I, identity=s.Identity.ALWAYS), s.column("p_id", I, nullable=True), s.column("u", s.integer(unsigned=True), default="7"), s.column("d", s.decimal(6, 2), nullable=True), s.column("twice", I, nullable=True, generated="p_id * 2", stored=True), s.ForeignKeyDef(("p_id",), "p", ("id",), on_delete=s.Action.CASCADE, on_update=s.Action.CASCADE), primary_key=["id"])
p, c = TableRef(P), TableRef(C)


@pytest.fixture
def db(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create_table(P)
    store.create_table(C)
    return Database(spark, store)


def rows(db, t, *columns):
    return sorted(tuple(r) for r in db.read(t).select(*columns).collect())


def test_writes_and_constraints(db):
    assert db.exec(insert(p, ["id", "name"], (1, "a"), (2, "b"))) == 2
    got = db.query_write_all(insert(c, ["p_id", "d"], (1, "1.50"), (None, None)).with_returning(c["id"], c["u"], c["twice"], project(c["d"], "e")))
    assert [[str(v) for v in r.values] for r in got] == [["1", "7", "2", "1.50"], ["2", "7", "None", "None"]]
    for bad in (
        insert(p, ["id", "name"], (1, "z")),
        insert(p, ["id", "name"], (3, "a")),
        insert(p, ["id", "name"], (3, "c"), (3, "d")),
        insert(p, ["id", "name"], (3, "toolong")),
        insert(p, ["id"], (3,)),
        insert(p, ["id", "name"], (5000, "x")),
        insert(c, ["p_id"], (99,)),
        insert(c, ["u"], (-1,)),
        update(p, set_(p["name"], "a"), where=equal(p["id"], 2)),
        update(c, set_(c["p_id"], 99), where=equal(c["id"], 1)),
    ):
        with pytest.raises(ConstraintError):
            db.exec(bad)
    with pytest.raises(ValidationError):
        db.exec(insert(c, ["d"], ("1.234",)))
    assert rows(db, p, "id", "name") == [(1, "a"), (2, "b")]
    assert db.exec(update(p, set_(p["id"], 10), set_(p["name"], upper(p["name"])), where=equal(p["id"], 1))) == 1
    assert rows(db, p, "id", "name") == [(2, "b"), (10, "A")]
    assert rows(db, c.__class__(C), "id", "twice")[0] == (1, 20)
    old = db.query_write_one(delete(p, where=equal(p["id"], 10)).with_returning(p["name"]))
    assert old["name"] == "A" and [r[0] for r in rows(db, c, "id")] == [2]
    with pytest.raises(ValidationError):
        db.exec(insert(p, ["id", "name"], (4, "q")).with_returning(p["id"]))
    with pytest.raises(ValidationError):
        db.query_write(insert(p, ["id", "name"], (4, "q")))
    lazy = db.query_write(insert(p, ["id", "name"], (4, "q")).with_returning(p["id"]))
    assert len(rows(db, p, "id")) == 1
    assert next(lazy)["id"] == 4 and len(rows(db, p, "id")) == 2
    with pytest.raises(ValidationError):
        db.query_write_all(insert(p, ["id", "name"], (True, "q")).with_returning(p["id"]))


def test_upserts(db):
    db.exec(insert(p, ["id", "name"], (1, "a"), (2, "b")))
    up = upsert(insert(p, ["id", "name"], (1, "x"), (3, "y")), [p["id"]], set_(p["name"], lower(excluded(p["name"])))).with_returning(p["id"])
    assert sorted(r["id"] for r in db.query_write_all(up)) == [1, 3]
    assert rows(db, p, "id", "name") == [(1, "x"), (2, "b"), (3, "y")]
    with pytest.raises(ConstraintError):
        db.exec(upsert(insert(p, ["id", "name"], (7, "q"), (7, "r")), [p["id"]], set_(p["name"], "z")))
    assert db.exec(upsert(insert(p, ["id", "name"], (1, "n"), (8, "m"), (8, "k")), [p["id"]])) == 1
    assert (8, "m") in rows(db, p, "id", "name")
    with pytest.raises(ConstraintError):
        db.exec(upsert(insert(p, ["id", "name"], (9, "b")), [p["id"]]))
    db.exec(default_insert(c))
    with pytest.raises(ValidationError):
        db.exec(upsert(insert(c, ["p_id"], (1,)), [c["p_id"]]))


def test_transactions(db):
    tx = db.begin()
    tx.exec(insert(p, ["id", "name"], (1, "a")))
    assert rows(tx, p, "id") == [(1,)] and rows(db, p, "id") == []
    with pytest.raises(TransactionError):
        tx.begin()
    other = db.begin()
    other.exec(insert(p, ["id", "name"], (2, "b")))
    tx.commit()
    with pytest.raises(TransactionError):
        other.commit()
    tx.rollback()
    with pytest.raises(TransactionError):
        tx.exec(insert(p, ["id", "name"], (3, "c")))
    for act in (db.commit, db.rollback):
        with pytest.raises(TransactionError):
            act()
    assert rows(db, p, "id") == [(1,)]
    db.provider.vacuum()
    assert rows(db, p, "id") == [(1,)]


@dataclasses.dataclass
class PRow:
    id: int
    name: str


@dataclasses.dataclass
class CRow:
    id: int
    p_id: int | None
    u: int
    d: str | None
    twice: int | None


def test_typed_writes(db):
    t, child = Table(P, PRow), Table(C, CRow)
    assert insert_rows(db, t, [PRow(1, "a"), PRow(2, "b")]) == 2
    got = insert_returning(db, child, [CRow(0, 1, 5, "2.00", 0)], default_columns=("u",))
    assert got == [CRow(1, 1, 7, "2.00", 2)]
    assert insert_returning(db, child, [CRow(0, 0, 0, None, 0)] * 2, default_columns=("p_id", "u", "d"))[1].id == 3
    assert update_row(db, t, PRow(2, "z")) == 1
    assert update_columns(db, t, PRow(1, "y"), "name") == 1
    assert update_where(db, t, PRow(0, "w"), greater(p["id"], 1), "name") == 1
    assert rows(db, p, "id", "name") == [(1, "y"), (2, "w")]
    for wrong in (("id",), ("nope",)):
        with pytest.raises(ValidationError):
            update_columns(db, t, PRow(1, "y"), *wrong)
    with pytest.raises(ValidationError):
        update_columns(db, child, CRow(1, 1, 1, None, 1), "twice")
    with pytest.raises(ValidationError):
        insert_rows(db, t, [PRow(1, "a")], default_columns=("nope",))
    with pytest.raises(ValidationError):
        Table(P, CRow)
    assert delete_from(t).where_equal("id", 2).exec(db) == 1
    with pytest.raises(ValidationError):
        delete_from(t).exec(db)
    assert delete_from(t).allow_all().exec(db) == 1
    assert rows(db, c, "id") == [(2,), (3,)]
    n = insert_frame(db, C, db.spark.range(5).selectExpr("cast(null as bigint) as p_id"))
    assert n == 5 and len({r[0] for r in rows(db, c, "id")}) == 7
    with pytest.raises(CapabilityError):
        db.provider.create_table(s.table("e", s.column("a", I), s.ExclusionDef("a WITH =")))
    with pytest.raises(ValidationError):
        db.provider.create_table(P)


def test_foreign_key_actions(db):
    q = s.table("q", s.column("id", I), s.column("p_id", I, nullable=True), s.ForeignKeyDef(("p_id",), "p", ("id",), on_delete=s.Action.SET_NULL), primary_key=["id"])
    r = s.table("r", s.column("id", I), s.column("p_id", I, nullable=True, default="1"), s.ForeignKeyDef(("p_id",), "p", ("id",), on_delete=s.Action.RESTRICT), primary_key=["id"])
    for d in (q, r):
        db.provider.create_table(d)
    db.exec(insert(p, ["id", "name"], (1, "a"), (2, "b")))
    db.exec(insert(TableRef(q), ["id", "p_id"], (1, 2)))
    db.exec(insert(TableRef(r), ["id", "p_id"], (1, 1)))
    db.exec(delete(p, where=equal(p["id"], 2)))
    assert rows(db, TableRef(q), "id", "p_id") == [(1, None)]
    with pytest.raises(ConstraintError):
        db.exec(delete(p, all_rows=True))
    with pytest.raises(ValidationError):
        db.provider.create_table(s.table("z", s.column("a", X), s.ForeignKeyDef(("a",), "c", ("d",))))


def test_inspection(spark, db):
    db.provider.create_table(s.in_schema(P, "other"))
    inspector = StoreInspector(db.provider)
    assert inspector.table_names() == ["c", "other.p", "p"] and inspector.table_names("other") == ["p"]
    assert inspector.table("c") == C
    with pytest.raises(AmbiguousTableError):
        inspector.table("p")
    with pytest.raises(TableNotFoundError):
        inspector.table("nope")
    assert [d.key for d in sweep(inspector, exclude=["c"])] == ["other.p", "p"]
    with pytest.raises(ValidationError):
        sweep(inspector, include=["c"], exclude=["c"])
    with pytest.raises(InspectionError):
        sweep(inspector, exclude=["c", "p", "other.p"])
    spark.sql("CREATE TABLE live (a INT, b STRING, c DECIMAL(5,1)) USING parquet")
    spark.range(1).createOrReplaceTempView("a_view")
    live = SparkInspector(spark)
    assert "live" in live.table_names() and "a_view" not in live.table_names()
    assert [x.type.kind for x in live.table("live").columns] == [s.Kind.INTEGER, s.Kind.TEXT, s.Kind.DECIMAL]
    spark.sql("DROP TABLE live")


def test_migrations(spark, db, tmp_path):
    m1 = Migration("001", (("a.up.json", json.dumps([{"create_table": s.table("m", s.column("id", I), primary_key=["id"]).to_json()}])),), (("a.down.json", '[{"drop_table": "m"}]'),))
    m2 = Migration("002", (("a.up.json", json.dumps([{"add_columns": "m", "columns": [{"name": "x", "type": {"kind": "text"}, "default": "'d'"}]}])),), (("a.down.json", '[{"drop_columns": "m", "columns": ["x"]}]'),))
    runner = Runner(db.provider, clock=lambda: datetime(2024, 1, 1))
    assert [m.id for m in runner.plan([m2, m1])] == ["001", "002"]
    assert runner.apply([m2, m1], through="001") == ["001"]
    assert [str(x) for _, x in runner.status([m1, m2])] == ["applied", "pending"]
    db.exec(insert(TableRef(s.table("m", s.column("id", I), primary_key=["id"])), ["id"], (1,)))
    assert runner.apply([m1, m2]) == ["002"] and runner.apply([m1, m2]) == []
    assert rows(db, TableRef(db.provider.definition("m")), "id", "x") == [(1, "d")]
    changed = dataclasses.replace(m1, up=(("a.up.json", m1.up[0][1] + " "),))
    assert dict(runner.status([changed, m2]))["001"] == "changed"
    assert dict(runner.status([m1]))["002"] == "unknown"
    late = dict(runner.status([m1, m2, Migration("0015", m1.up)]))
    assert (late["001"], late["0015"], late["002"]) == ("applied", "pending", "out_of_order")
    for wrong in ([changed, m2], [m1], [m1, m2, Migration("0015", m1.up)], [m1, m1]):
        with pytest.raises(MigrationError):
            runner.plan(wrong)
    with pytest.raises(MigrationError):
        runner.revert([m1, m2])
    assert runner.revert([m1, m2], steps=1) == ["002"]
    broken = Migration("003", (("a.up.json", '[{"drop_table": "m"}, {"nope": 1}]'),))
    with pytest.raises(MigrationError):
        runner.apply([m1, broken])
    assert "m" in StoreInspector(db.provider).table_names()
    assert runner.revert([m1, m2], through="001") == ["001"]

    n = s.table("n", s.column("id", I), s.column("p_id", I), s.ForeignKeyDef(("p_id",), "p", ("id",)), primary_key=["id"])
    wider = dataclasses.replace(P, columns=(*P.columns, s.column("more", X, nullable=True)))
    changes = diff_schemas([P, C], [n, wider, C])
    assert [next(iter(x.up)) for x in changes] == ["add_columns", "create_table"]
    for wrong in ([C], [P, C, dataclasses.replace(n, columns=n.columns)][:1], [dataclasses.replace(P, columns=(*P.columns, s.column("must", X))), C], [dataclasses.replace(P, checks=()), C]):
        with pytest.raises(ManualMigrationError):
            diff_schemas([P, C], wrong)
    folder = write_migration(tmp_path / "migrations", "010", "wider", changes)
    with pytest.raises(MigrationError):
        write_migration(tmp_path / "migrations", "010", "wider", changes)
    loaded = load_directory(tmp_path / "migrations")
    assert loaded[0].id == "010" and loaded[0].down
    root = db.provider.root
    assert cli.main(["--store", root, "apply", "--migrations", str(tmp_path / "migrations")], spark) == 0
    assert cli.main(["--store", root, "verify", "--migrations", str(tmp_path / "migrations")], spark) == 0
    assert cli.main(["--store", root, "revert", "--migrations", str(tmp_path / "migrations"), "--steps", "1"], spark) == 0
    assert cli.main(["--store", root, "verify", "--migrations", str(tmp_path / "migrations")], spark) == 1
    (folder / "002_x.up.json").write_text("[]")
    with pytest.raises(MigrationError):
        load_directory(tmp_path / "migrations")


def test_generated_code(db, tmp_path):
    d = dataclasses.replace(C, relationships=(s.RelationshipDef("parent", "belongs_to", "p", ("p_id",), ("id",)),)).validate()
    source = store_module([P, d])
    assert write_module(tmp_path / "gen.py", source) and not write_module(tmp_path / "gen.py", source) and check_module(tmp_path / "gen.py", source)
    made = types.ModuleType("gen")
    exec(source, made.__dict__)
    assert made.p.definition == P and made.c.definition == d
    assert insert_rows(db, made.p, [made.P(1, "a")]) == 1
    got = insert_returning(db, made.c, [made.C(0, 1, 2, None, None)])
    assert made.c_parent(db, got) == {1: made.P(1, "a")}
    queries = types.ModuleType("queries")
    exec(query_module([parse("by_id", 'SELECT name FROM p WHERE id = {{bind "id" p.id}}')], [P]), queries.__dict__)
    db.register(P)
    assert db.query_rendered_one(queries.by_id(1))["name"] == "a"
    with pytest.raises(ValidationError):
        store_module([P, s.in_schema(P, "x")])
    pair = s.table("pair", s.column("a", I), s.column("class", X), primary_key=["a", "class"])
    part = s.table("part", s.column("id", I), s.column("pa", I, nullable=True), s.column("pc", X, nullable=True), s.ForeignKeyDef(("pa", "pc"), "pair", ("a", "class")), s.RelationshipDef("whole", "belongs_to", "pair", ("pa", "pc"), ("a", "class")), primary_key=["id"])
    pair = dataclasses.replace(pair, relationships=(s.RelationshipDef("parts", "has_many", "part", ("a", "class"), ("pa", "pc")),)).validate()
    made = types.ModuleType("pairs")
    exec(store_module([pair, part]), made.__dict__)
    db.provider.create_table(pair)
    db.provider.create_table(part)
    pairs = [made.Pair(1, "x"), made.Pair(1, "y"), made.Pair(2, "x")]
    insert_rows(db, made.pair, pairs)
    insert_rows(db, made.part, parts := [made.Part(1, 1, "x"), made.Part(2, 1, "x"), made.Part(3, 2, "x"), made.Part(4, 1, None)])
    assert made.part_whole(db, parts) == {(1, "x"): pairs[0], (2, "x"): pairs[2]}
    assert {k: sorted(x.id for x in v) for k, v in made.pair_parts(db, pairs).items()} == {(1, "x"): [1, 2], (1, "y"): [], (2, "x"): [3]}
    with pytest.raises(ValidationError):
        store_module([part])


def test_generation_settings(db, spark, tmp_path, capsys):
    root, path = db.provider.root, tmp_path / "settings.json"
    (tmp_path / "by_id.sql").write_text('SELECT name FROM p WHERE id = {{bind "id" p.id}}')
    said = {"out": "store.py", "queries_out": "queries.py", "include": ["p"], "row_names": {"p": "Person"}, "queries": [{"function": "by_id", "file": "by_id.sql"}, {"function": "every", "sql": "SELECT id FROM p"}]}
    run = lambda *more: cli.main(["--store", root, "generate", "--settings", str(path), *more], spark)
    path.write_text(json.dumps(said))
    assert run("--check") == 1 and run() == 0 and run("--check") == 0
    assert "class Person:" in (tmp_path / "store.py").read_text() and "c = Table" not in (tmp_path / "store.py").read_text()
    assert "def by_id(id: int)" in (tmp_path / "queries.py").read_text() and "def every()" in (tmp_path / "queries.py").read_text()
    assert run("--out", str(tmp_path / "other.py")) == 0 and (tmp_path / "other.py").exists()
    # a file that was not generated is kept, and then nothing is written
    (tmp_path / "store.py").write_text("mine = 1\n")
    (tmp_path / "queries.py").unlink()
    assert run() == 1 and (tmp_path / "store.py").read_text() == "mine = 1\n" and not (tmp_path / "queries.py").exists()
    (tmp_path / "store.py").unlink()
    how = Settings.load(path)
    assert sorted(how.plan([P]).values()) == ["create", "create"] and len(how.write([P])) == 2
    assert sorted(how.plan([P]).values()) == ["keep", "keep"]
    for wrong in ({"nope": 1}, {"root": "/"}, {"out": None}, {"queries_out": None}, {"include": ["zz"]}, {"exclude": ["c"]}, {"row_names": {"zz": "Z"}}, {"queries": [{"function": "f"}]}, {"queries": [{"function": "f", "sql": "SELECT 1"}] * 2}):
        path.write_text(json.dumps(said | wrong))
        assert run() == 1, wrong
    capsys.readouterr()


def test_migration_lock(db):
    store, migration = db.provider, Migration("001", (("a.up.json", json.dumps([{"create_table": s.table("m", s.column("id", I), primary_key=["id"]).to_json()}])),))
    runner = Runner(store)
    store.lock_seconds = 0.3
    with store.lock("migrations"), pytest.raises(TransactionError):
        runner.apply([migration])
    assert runner.apply([migration]) == ["001"]
    broken = Migration("002", (("a.up.json", '[{"nope": 1}]'),))
    with pytest.raises(MigrationError):
        runner.apply([migration, broken])
    assert not store.files.exists(f"{store.root}/migrations.lock")


def _sql(id_, text):
    return Migration(id_, (("a.up.sql", text),))


def test_sql_migrations_stay_in_the_transaction(spark, db):
    m = s.table("m", s.column("id", I), s.column("said", X, nullable=True), s.CheckDef("id >= 0"), primary_key=["id"])
    db.provider.create_table(m)
    q = s.table("m", s.column("id", I), schema="other", primary_key=["id"])
    db.provider.create_table(q)
    t, runner = TableRef(m), Runner(db.provider)
    db.exec(insert(t, ["id", "said"], (1, "one"), (2, "two")))
    before = {k: v["parts"] for k, v in db.provider.manifest()["tables"].items()}
    broken = ["INSERT INTO m VALUES (3, 'x'); SELECT nope FROM m", "INSERT INTO m VALUES (1, 'dup')", "UPDATE m SET id = -1 WHERE id = 1", "DELETE FROM m; INSERT INTO nowhere VALUES (1)", "CREATE TABLE z (a INT)", "DROP VIEW m", "INSERT OVERWRITE m VALUES (5, 'x')", "DELETE FROM m WHERE id IN (SELECT 1)", "UPDATE m SET nope = 1", "INSERT INTO m VALUES (7)"]
    for i, text in enumerate(broken):
        with pytest.raises(MigrationError):
            runner.apply([_sql(f"{i:03}", text)])
        assert rows(db, t, "id", "said") == [(1, "one"), (2, "two")], text
        assert {k: v["parts"] for k, v in db.provider.manifest()["tables"].items() if k in before} == before
    good = """
        -- a comment; with a semicolon
        INSERT INTO m (id, said) VALUES (3, 'a;b'), (4, 'it''s');  /* another; one */
        UPDATE m SET said = upper(said) WHERE m.id >= 2 AND id < 4;
        INSERT INTO `other.m` SELECT id * 10 FROM m WHERE id > 2;
        DELETE FROM m AS x WHERE x.id = 1;
        SELECT count(*) FROM m
    """
    assert runner.apply([_sql("900", good)]) == ["900"]
    assert rows(db, t, "id", "said")[0] == (2, "TWO") and rows(db, t, "id", "said")[1] == (3, "A;B") and len(rows(db, t, "id")) == 3
    assert rows(db, TableRef(q), "id") == [(30,), (40,)]
    assert not [v for v in spark.catalog.listTables() if v.name in ("m", "other.m")]


def test_returning_is_checked_before_the_commit(db):
    @dataclasses.dataclass
    class Wide:
        id: int
        name: str

    @dataclasses.dataclass
    class Wrong:
        name: int

    table = TableRef(P)
    db.exec(insert(table, ["id", "name"], (1, "a"), (2, "b")))
    for cls, returned in ((Wide, ["id"]), (Wrong, ["name"]), (None, ["id", "id"])):
        with pytest.raises(DecodeError):
            db.query_write_all(delete(table, all_rows=True).with_returning(*(table[c] for c in returned)), cls)
        assert len(rows(db, table, "id")) == 2
    assert sorted(r.name for r in db.query_write_all(delete(table, all_rows=True).with_returning(table["id"], table["name"]), Wide)) == ["a", "b"]
    assert rows(db, table, "id") == []


def test_only_touched_parts_are_written(db):
    table = TableRef(P)
    for i in range(4):
        db.exec(insert(table, ["id", "name"], (10 * i, f"n{i}"), (10 * i + 1, f"m{i}")))

    def parts():
        return db.provider.manifest()["tables"]["p"]["parts"]

    first = parts()
    assert db.exec(update(table, set_(table["name"], "new"), where=equal(table["id"], 10))) == 1
    assert [p for p in first if p not in parts()] == [first[1]] and len(parts()) == 5
    assert db.exec(update(table, set_(table["name"], "x"), where=equal(table["id"], 999))) == 0 and db.exec(delete(table, where=equal(table["id"], 999))) == 0
    second = parts()
    assert len(second) == 5
    assert db.exec(delete(table, where=equal(table["id"], 20))) == 1
    assert [p for p in second if p not in parts()] == [first[2]]
    third = parts()
    db.exec(upsert(insert(table, ["id", "name"], (30, "up"), (77, "in")), [table["id"]], set_(table["name"], excluded(table["name"]))))
    assert [p for p in third if p not in parts()] == [first[3]] and first[0] in parts()
    fourth, want = parts(), rows(db, table, "id", "name")
    person = Table(P, dataclasses.make_dataclass("Person", [("id", int), ("name", str)]))
    assert update_rows(db, person, [person.row(1, "r1"), person.row(0, "r0"), person.row(55, "none")]) == 2
    assert [p for p in fourth if p not in parts()] == [first[0]] and len(parts()) == len(fourth) + 1
    got = rows(db, table, "id", "name")
    assert got[:2] == [(0, "r0"), (1, "r1")] and got[2:] == want[2:]
    with pytest.raises(ConstraintError):
        update_rows(db, person, [person.row(1, "a"), person.row(1, "b")])
    n = len(parts())
    assert db.provider.compact("p") == n and len(parts()) == 1 and rows(db, table, "id", "name") == got
    assert db.provider.compact("p") == 0


def test_indexes_are_added(db):
    q = s.table("q", s.column("id", I), s.column("name", X), primary_key=["id"])
    db.provider.create_table(q)
    table = TableRef(q)
    db.exec(insert(table, ["id", "name"], (1, "a"), (2, "a")))
    plain, unique = dataclasses.replace(q, indexes=(s.IndexDef(("name",)),)), dataclasses.replace(q, indexes=(s.IndexDef(("id", "name"), unique=True),))
    wrong = dataclasses.replace(q, indexes=(s.IndexDef(("name",), unique=True),))
    runner = Runner(db.provider)
    for i, wanted in enumerate((plain, unique, wrong)):
        (change,) = diff_schemas([q], [wanted])
        m = Migration(f"00{i}", (("a.up.json", json.dumps([change.up])),), (("a.down.json", json.dumps([change.down])),))
        if wanted is wrong:
            with pytest.raises(MigrationError):
                runner.apply([m])
        else:
            runner.apply([m])
            assert db.provider.definition("q").indexes == wanted.indexes
            runner.revert([m], steps=1)
        assert db.provider.definition("q").indexes == ()
    with pytest.raises(ManualMigrationError):
        diff_schemas([plain], [q])
