"""One query for each operator of the statement model, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .migrations import Migration, Runner
from .operators.builder import Table, decode_from, delete_from, dynamic_select, select_from
from .operators.database import Database, counting
from .operators.relations import related
from .operators.typed import insert_rows
from .operators.writes import insert_frame
from .plans import schema as s
from .plans.nodes import (
    Bound, Select, TableRef, abs_, and_, asc, avg, bind, coalesce, compare, count, count_all, default_insert, delete, desc, equal, excluded, func, greater, greater_or_equal,
    in_, in_select, inner_join, insert, is_not_null, is_null, left_join, less, less_or_equal, like, lower, max_, min_, negate, not_equal, not_in, not_in_select, or_, project, scalar, select, set_, sum_, update, upper, upsert,
)
from .plans.render import precompiled
from .plans.templates import parse
from .sources import ParquetDirectory, Store


def _described(name: str, key: tuple[str, ...], **columns: s.ColumnType) -> s.TableDef:
    return s.table(name, *(s.column(c, t, nullable=c not in key) for c, t in columns.items()), primary_key=key)


I, X, D, M = s.integer(), s.text(), s.float_(), s.time()
REGION = _described("region", ("r_regionkey",), r_regionkey=I, r_name=X)
NATION = _described("nation", ("n_nationkey",), n_nationkey=I, n_name=X, n_regionkey=I)
CUSTOMER = _described("customer", ("c_custkey",), c_custkey=I, c_name=X, c_nationkey=I, c_acctbal=D, c_mktsegment=X)
SUPPLIER = _described("supplier", ("s_suppkey",), s_suppkey=I, s_name=X, s_nationkey=I, s_acctbal=D)
PART = _described("part", ("p_partkey",), p_partkey=I, p_name=X, p_brand=X, p_type=X, p_size=I, p_retailprice=D)
ORDERS = _described("orders", ("o_orderkey",), o_orderkey=I, o_custkey=I, o_orderstatus=X, o_totalprice=D, o_orderdate=M, o_orderpriority=X)
LINEITEM = _described("lineitem", (), l_orderkey=I, l_partkey=I, l_suppkey=I, l_linenumber=I, l_quantity=D, l_extendedprice=D, l_discount=D, l_tax=D, l_returnflag=X, l_linestatus=X, l_shipdate=M)
EVENTS = _described("events", ("event_id",), event_id=I, ts=M, user_id=I, event_type=X, value=D, props=X)

region, nation, customer, supplier, part, orders, lineitem, events = map(TableRef, (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS))
n, r, c, su, p, o, li = nation.col, region.col, customer.col, supplier.col, part.col, orders.col, lineitem.col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    return Database(spark, ParquetDirectory(spark, sf_dir))


def _add(name: str, made: Select, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: database(spark, sf_dir).frame(made)
    ORACLES[name] = sql


def _registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__.strip("_")] = f
        if sql:
            ORACLES[f.__name__.strip("_")] = sql
        return f

    return put


# -- scans and projections
_add("scan_project", select(nation, n("n_nationkey"), n("n_name")), "SELECT n_nationkey, n_name FROM nation")
_add("project_alias", select(region, project(r("r_name"), "title")), "SELECT r_name AS title FROM region")
_add("select_all_columns", select(nation, *nation.columns()), "SELECT * FROM nation")

# -- comparisons
for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _make = {"=": equal, "<>": not_equal, ">": greater, ">=": greater_or_equal, "<": less, "<=": less_or_equal}[_op]
    _add(f"where_{_name}", select(part, p("p_partkey"), p("p_size"), where=_make(p("p_size"), 25)), f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25")
_add("where_compare", select(orders, o("o_orderkey"), where=compare(o("o_orderstatus"), "<>", "F")), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
_add("where_like", select(customer, c("c_custkey"), c("c_name"), where=like(c("c_name"), "%1_")), "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_'")
_add("where_not_like", select(customer, c("c_custkey"), where=negate(like(c("c_name"), "%1%"))), "SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%1%'")
_add("where_and", select(lineitem, li("l_orderkey"), li("l_linenumber"), where=and_(greater(li("l_quantity"), 40), equal(li("l_returnflag"), "R"), less(li("l_discount"), 0.05))), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R' AND l_discount < 0.05")
_add("where_or", select(lineitem, li("l_orderkey"), li("l_linenumber"), where=or_(greater(li("l_quantity"), 48), equal(li("l_linenumber"), 7))), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 48 OR l_linenumber = 7")
_add("where_not", select(lineitem, li("l_orderkey"), li("l_quantity"), where=negate(less(li("l_quantity"), 45))), "SELECT l_orderkey, l_quantity FROM lineitem WHERE NOT l_quantity < 45")
_add("nested_predicates", select(lineitem, li("l_orderkey"), li("l_linenumber"), where=or_(and_(equal(li("l_returnflag"), "A"), greater(li("l_quantity"), 45)), negate(or_(equal(li("l_linestatus"), "O"), less(li("l_tax"), 0.07))))), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity > 45) OR NOT (l_linestatus = 'O' OR l_tax < 0.07)")

# -- NULL: customers joined to large orders, of which many have none
_big = left_join(orders, and_(equal(o("o_custkey"), c("c_custkey")), greater(o("o_totalprice"), 400000.0)))
_big_sql = "FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000"
_add("is_null", select(customer, c("c_custkey"), joins=(_big,), where=is_null(o("o_orderkey"))), f"SELECT c_custkey {_big_sql} WHERE o_orderkey IS NULL")
_add("is_not_null", select(customer, c("c_custkey"), o("o_orderkey"), joins=(_big,), where=is_not_null(o("o_orderkey"))), f"SELECT c_custkey, o_orderkey {_big_sql} WHERE o_orderkey IS NOT NULL")
_add("null_three_valued", select(customer, c("c_custkey"), project(or_(greater(o("o_totalprice"), 450000.0), less(c("c_acctbal"), 0.0)), "flag"), joins=(_big,)), f"SELECT c_custkey, o_totalprice > 450000 OR c_acctbal < 0 AS flag {_big_sql}")

# -- membership
_add("in_list", select(orders, o("o_orderkey"), where=in_(o("o_orderpriority"), "1-URGENT", "2-HIGH")), "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
_add("in_list_columns", select(lineitem, li("l_orderkey"), li("l_partkey"), where=in_(li("l_linenumber"), li("l_quantity"), 1)), "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber IN (l_quantity, 1)")
_add("not_in_list", select(orders, o("o_orderkey"), where=not_in(o("o_orderstatus"), "F", "P")), "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
_add("not_in_list_null", select(orders, o("o_orderkey"), where=not_in(o("o_orderstatus"), "F", None)), "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', NULL)")
_urgent = select(orders, o("o_custkey"), where=and_(equal(o("o_orderpriority"), "1-URGENT"), greater(o("o_totalprice"), 300000.0)))
_urgent_sql = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000"
_nulls = select(orders, func("NULLIF", o("o_custkey"), 1), )
_nulls_sql = "SELECT NULLIF(o_custkey, 1) FROM orders"
_add("in_select", select(customer, c("c_custkey"), where=in_select(c("c_custkey"), _urgent)), f"SELECT c_custkey FROM customer WHERE c_custkey IN ({_urgent_sql})")
_add("not_in_select", select(customer, c("c_custkey"), where=not_in_select(c("c_custkey"), _urgent)), f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({_urgent_sql})")
_add("not_in_select_null", select(customer, c("c_custkey"), where=not_in_select(c("c_custkey"), _nulls)), f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({_nulls_sql})")
_add("in_select_limited", select(customer, c("c_custkey"), where=in_select(c("c_custkey"), select(orders, o("o_custkey"), order=(asc(o("o_orderkey")),), limit=20))), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 20)")
_add("in_select_projected", select(customer, c("c_custkey"), project(in_select(c("c_custkey"), _urgent), "urgent"), project(not_in_select(c("c_custkey"), _nulls), "absent")), f"SELECT c_custkey, c_custkey IN ({_urgent_sql}) AS urgent, c_custkey NOT IN ({_nulls_sql}) AS absent FROM customer")
_add("in_select_order", select(customer, c("c_custkey"), order=(desc(in_select(c("c_custkey"), _urgent)), asc(c("c_custkey")))), f"SELECT c_custkey FROM customer ORDER BY CASE WHEN c_custkey IN ({_urgent_sql}) THEN 0 ELSE 1 END, c_custkey")
_add("in_select_group", select(customer, project(in_select(c("c_custkey"), _urgent), "urgent"), project(count_all(), "n"), group_by=(in_select(c("c_custkey"), _urgent),)), f"SELECT c_custkey IN ({_urgent_sql}) AS urgent, count(*) AS n FROM customer GROUP BY 1")

# -- scalar subqueries
_most = select(orders, max_(o("o_totalprice")))
_add("scalar_subquery_where", select(orders, o("o_orderkey"), where=equal(o("o_totalprice"), scalar(_most))), "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
_add("scalar_subquery_projection", select(region, r("r_name"), project(scalar(select(nation, count_all())), "nations")), "SELECT r_name, (SELECT count(*) FROM nation) AS nations FROM region")
_add("scalar_subquery_group", select(orders, project(greater(o("o_totalprice"), scalar(select(orders, avg(o("o_orderkey"))))), "above"), project(count_all(), "n"), group_by=(greater(o("o_totalprice"), scalar(select(orders, avg(o("o_orderkey"))))),)), "SELECT o_totalprice > (SELECT avg(o_orderkey) FROM orders) AS above, count(*) AS n FROM orders GROUP BY 1")
_add("scalar_subquery_having", select(customer, c("c_nationkey"), project(count_all(), "n"), group_by=(c("c_nationkey"),), having=greater(count_all(), scalar(select(nation, count_all())))), "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM nation)")
_add("scalar_subquery_on", select(nation, n("n_name"), r("r_name"), joins=(left_join(region, and_(equal(n("n_regionkey"), r("r_regionkey")), less(r("r_regionkey"), scalar(select(region, max_(r("r_regionkey"))))))),)), "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < (SELECT max(r_regionkey) FROM region)")
_add("scalar_subquery_empty", select(region, r("r_name"), project(scalar(select(nation, n("n_name"), where=less(n("n_nationkey"), 0))), "none")), "SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey < 0) AS none FROM region")

# -- joins
_add("inner_join", select(nation, n("n_name"), r("r_name"), joins=(inner_join(region, equal(n("n_regionkey"), r("r_regionkey"))),)), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("left_join", select(customer, c("c_custkey"), o("o_orderkey"), joins=(_big,)), f"SELECT c_custkey, o_orderkey {_big_sql}")
_add("left_join_anti", select(customer, c("c_custkey"), joins=(left_join(orders, and_(equal(o("o_custkey"), c("c_custkey")), equal(o("o_orderstatus"), "P"))),), where=is_null(o("o_orderkey"))), "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
_n2 = nation.as_("other")
_add("theta_join", select(nation, n("n_nationkey"), project(_n2.col("n_nationkey"), "larger"), joins=(inner_join(_n2, and_(less(n("n_nationkey"), _n2.col("n_nationkey")), not_equal(n("n_regionkey"), _n2.col("n_regionkey")))),)), "SELECT a.n_nationkey, b.n_nationkey AS larger FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
_add("self_join", select(nation, n("n_name"), project(_n2.col("n_name"), "neighbour"), joins=(inner_join(_n2, equal(n("n_regionkey"), _n2.col("n_regionkey"))),)), "SELECT a.n_name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_add("multi_join", select(orders, o("o_orderkey"), c("c_name"), n("n_name"), r("r_name"), joins=(inner_join(customer, equal(o("o_custkey"), c("c_custkey"))), inner_join(nation, equal(c("c_nationkey"), n("n_nationkey"))), left_join(region, equal(n("n_regionkey"), r("r_regionkey")))), where=greater(o("o_totalprice"), 350000.0)), "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 350000")
_add("join_subquery_on", select(supplier, su("s_suppkey"), n("n_name"), joins=(inner_join(nation, and_(equal(su("s_nationkey"), n("n_nationkey")), in_select(n("n_regionkey"), select(region, r("r_regionkey"), where=in_(r("r_name"), "ASIA", "EUROPE"))))),)), "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))")

# -- aggregates
_add("count_all", select(lineitem, project(count_all(), "n")), "SELECT count(*) AS n FROM lineitem")
_add("count_col", select(customer, project(count(o("o_orderkey")), "n"), joins=(_big,)), f"SELECT count(o_orderkey) AS n {_big_sql}")
_add("count_distinct", select(lineitem, project(count(li("l_suppkey")).with_distinct(), "n")), "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
_add("sum", select(lineitem, project(sum_(li("l_quantity")), "q"), project(sum_(li("l_linenumber")), "l")), "SELECT sum(l_quantity) AS q, CAST(sum(l_linenumber) AS BIGINT) AS l FROM lineitem")
_add("sum_distinct", select(lineitem, project(sum_(li("l_quantity")).with_distinct(), "q")), "SELECT sum(DISTINCT l_quantity) AS q FROM lineitem")
_add("min", select(orders, project(min_(o("o_totalprice")), "least"), project(min_(o("o_orderpriority")), "first")), "SELECT min(o_totalprice) AS least, min(o_orderpriority) AS first FROM orders")
_add("max", select(orders, project(max_(o("o_totalprice")), "most"), project(max_(o("o_orderdate")), "last")), "SELECT max(o_totalprice) AS most, max(o_orderdate) AS last FROM orders")
_add("min_max_distinct", select(orders, project(min_(o("o_orderkey")).with_distinct(), "least"), project(max_(o("o_orderkey")).with_distinct(), "most")), "SELECT min(DISTINCT o_orderkey) AS least, max(DISTINCT o_orderkey) AS most FROM orders")
_add("avg", select(lineitem, project(avg(li("l_quantity")), "q")), "SELECT avg(l_quantity) AS q FROM lineitem")
_add("avg_distinct", select(lineitem, project(avg(li("l_quantity")).with_distinct(), "q")), "SELECT avg(DISTINCT l_quantity) AS q FROM lineitem")
_add("agg_empty_input", select(orders, project(count_all(), "n"), project(max_(o("o_totalprice")), "most"), where=less(o("o_orderkey"), 0)), "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderkey < 0")
_add("agg_implicit_having", select(orders, project(count_all(), "n"), having=greater(max_(o("o_orderkey")), 10)), "SELECT count(*) AS n FROM orders HAVING max(o_orderkey) > 10")
_add("agg_implicit_order", select(orders, project(count_all(), "n"), order=(desc(max_(o("o_orderkey"))),)), "SELECT count(*) AS n FROM orders")
_add("group_by", select(lineitem, li("l_returnflag"), li("l_linestatus"), project(count_all(), "n"), project(sum_(li("l_quantity")), "q"), project(avg(li("l_quantity")), "a"), group_by=(li("l_returnflag"), li("l_linestatus"))), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, avg(l_quantity) AS a FROM lineitem GROUP BY 1, 2")
_add("group_by_expr", select(customer, project(lower(c("c_mktsegment")), "segment"), project(less(c("c_acctbal"), 0.0), "debt"), project(count_all(), "n"), group_by=(lower(c("c_mktsegment")), less(c("c_acctbal"), 0.0))), "SELECT lower(c_mktsegment) AS segment, c_acctbal < 0 AS debt, count(*) AS n FROM customer GROUP BY 1, 2")
_add("group_by_join", select(customer, n("n_name"), project(count(c("c_custkey")), "n"), joins=(inner_join(nation, equal(c("c_nationkey"), n("n_nationkey"))),), group_by=(n("n_name"),)), "SELECT n_name, count(c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("having_agg", select(orders, o("o_custkey"), project(count_all(), "n"), group_by=(o("o_custkey"),), having=and_(greater(count_all(), 12), greater(max_(o("o_totalprice")), 100000.0))), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 100000")
_add("having_key", select(orders, o("o_orderstatus"), project(count_all(), "n"), group_by=(o("o_orderstatus"),), having=not_equal(o("o_orderstatus"), "P")), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 HAVING o_orderstatus <> 'P'")
_add("order_by_agg_unprojected", select(orders, o("o_custkey"), group_by=(o("o_custkey"),), order=(desc(count_all()), asc(o("o_custkey")))), "SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey")
_add("agg_escape_hatch", select(orders, project(func("bool_or", equal(o("o_orderstatus"), "P")), "some"), project(func("bool_and", greater(o("o_totalprice"), 0.0)), "every")), "SELECT bool_or(o_orderstatus = 'P') AS some, bool_and(o_totalprice > 0) AS every FROM orders")

# -- distinct, order, page
_add("distinct", select(orders, o("o_orderstatus"), o("o_orderpriority"), distinct=True), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_add("distinct_order", select(orders, o("o_custkey"), distinct=True, order=(desc(o("o_custkey")),)), "SELECT DISTINCT o_custkey FROM orders ORDER BY 1 DESC")
_add("distinct_join_page", select(customer, n("n_name"), joins=(inner_join(nation, equal(c("c_nationkey"), n("n_nationkey"))),), distinct=True, order=(asc(n("n_name")),), limit=5, offset=3), "SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY 1 LIMIT 5 OFFSET 3")
_add("order_multi", select(orders, o("o_orderkey"), o("o_orderstatus"), order=(asc(o("o_orderstatus")), desc(o("o_totalprice")), asc(o("o_orderkey")))), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
_add("order_constant", select(orders, o("o_orderkey"), order=(desc(bind(1)), asc(o("o_orderkey")))), "SELECT o_orderkey FROM orders ORDER BY o_orderkey")
_add("limit", select(orders, o("o_orderkey"), order=(asc(o("o_orderkey")),), limit=7), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7")
_add("offset", select(region, r("r_regionkey"), order=(asc(r("r_regionkey")),), offset=2), "SELECT r_regionkey FROM region ORDER BY 1 OFFSET 2")
_add("limit_offset", select(orders, o("o_orderkey"), order=(asc(o("o_orderkey")),), limit=7, offset=11), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7 OFFSET 11")
_add("topk", select(orders, o("o_orderkey"), o("o_totalprice"), where=equal(o("o_orderstatus"), "O"), order=(desc(o("o_totalprice")), asc(o("o_orderkey"))), limit=10), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")

# -- functions
_add("coalesce", select(customer, c("c_custkey"), project(coalesce(o("o_orderkey"), -1), "k"), joins=(_big,)), f"SELECT c_custkey, coalesce(o_orderkey, -1) AS k {_big_sql}")
_add("lower", select(part, p("p_partkey"), project(lower(p("p_brand")), "b")), "SELECT p_partkey, lower(p_brand) AS b FROM part")
_add("upper", select(part, p("p_partkey"), project(upper(p("p_name")), "b")), "SELECT p_partkey, upper(p_name) AS b FROM part")
_add("abs", select(supplier, su("s_suppkey"), project(abs_(su("s_acctbal")), "b")), "SELECT s_suppkey, abs(s_acctbal) AS b FROM supplier")
_add("func_nullif", select(part, p("p_partkey"), project(func("NULLIF", p("p_size"), 1), "x")), "SELECT p_partkey, NULLIF(p_size, 1) AS x FROM part")
_add("func_length", select(part, p("p_partkey"), project(func("length", p("p_name")), "x")), "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS x FROM part")
_add("scalar_over_agg", select(part, p("p_brand"), project(coalesce(max_(func("NULLIF", p("p_size"), 50)), 0), "x"), group_by=(p("p_brand"),)), "SELECT p_brand, coalesce(max(NULLIF(p_size, 50)), 0) AS x FROM part GROUP BY 1")


# -- builders, terminals, static SQL
@dataclass(frozen=True)
class Region:
    r_regionkey: int
    r_name: str | None


@dataclass(frozen=True)
class NationName:
    n_name: str


REGIONS = Table(REGION, Region)


@_registered("SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (1, 2, 3) AND r_name <> 'ASIA'")
def typed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_from(REGIONS).where_in("r_regionkey", [1, 2, 3]).where(not_equal(REGIONS["r_name"], "ASIA")).frame(database(spark, sf_dir))


@_registered("SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 3")
def decode_other_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_from(nation, NationName).select("n_name").order_desc("n_nationkey").limit(3).frame(database(spark, sf_dir))


@_registered("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey <> 7 GROUP BY 1 HAVING count(*) > 4")
def dynamic_select_(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dynamic_select(nation).select("n_regionkey").project(project(count_all(), "n")).where(not_equal(n("n_nationkey"), 7)).group_by_columns("n_regionkey").having(greater(count_all(), 4))
    return made.frame(database(spark, sf_dir))


@_registered("SELECT count(*) AS count FROM orders WHERE o_totalprice > 200000")
def count_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).frame(counting(select(orders, o("o_orderkey"), where=greater(o("o_totalprice"), 200000.0), order=(asc(o("o_orderkey")),))))


@_registered("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def one_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = database(spark, sf_dir).one(select(orders, o("o_orderkey"), o("o_orderstatus"), where=equal(o("o_orderkey"), 7)))
    return spark.createDataFrame([row.values], "o_orderkey long, o_orderstatus string")


@_registered("SELECT event_type, count(*) AS n FROM events WHERE user_id < 50 AND event_type <> 'view' GROUP BY 1")
def named_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.register(EVENTS)
    made = parse("by_type", 'SELECT event_type, count(*) AS n FROM events WHERE user_id < {{bind "user"}} AND event_type <> {{bind "type" events.event_type}} GROUP BY event_type')
    return db.sql_frame(made.compile().bind({"user": 50, "type": "view"}))


@_registered("SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 2")
def rendered_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    db.register(EVENTS)
    return db.sql_frame(precompiled("SELECT event_type, value, place FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= ?", 2))


@_registered("SELECT o_custkey AS parent, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def has_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    parents = db.frame(select(customer, c("c_custkey")))
    return related(db, orders, "o_custkey", parents, "c_custkey").select(F.col("o_custkey").alias("parent"), "o_orderkey")


@_registered("SELECT DISTINCT n_nationkey, n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def belongs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    rows = db.frame(select(supplier, su("s_nationkey")))
    return related(db, nation, "n_nationkey", rows, "s_nationkey").select("n_nationkey", "n_name")


# -- writes, on a fresh store that holds copies of region and nation
_S_REGION = s.table("region", s.column("r_regionkey", I), s.column("r_name", X), s.UniqueDef(("r_name",)), s.CheckDef("r_regionkey >= 0"), primary_key=["r_regionkey"])
_S_NATION = s.table("nation", s.column("n_nationkey", I), s.column("n_name", s.text(40)), s.column("n_regionkey", I, nullable=True), s.ForeignKeyDef(("n_regionkey",), "region", ("r_regionkey",), on_delete=s.Action.CASCADE), primary_key=["n_nationkey"])
_NOTE = s.table("note", s.column("id", I, identity=s.Identity.ALWAYS), s.column("title", X, default="'untitled'"), s.column("size", I, default="3"), s.column("twice", I, generated="size * 2", stored=True), primary_key=["id"])
sr, sn, note = map(TableRef, (_S_REGION, _S_NATION, _NOTE))


def _store_root(spark: SparkSession) -> str:
    """A new folder that executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tessera-store-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, sf_dir: str) -> Database:
    store = Store(spark, _store_root(spark))
    db = Database(spark, store)
    tx = db.begin()
    for d in (_S_REGION, _S_NATION, _NOTE):
        tx.transaction.create_table(d)
    for d in (_S_REGION, _S_NATION):
        insert_frame(tx, d, ParquetDirectory(spark, sf_dir).read(d).select(*(x.name for x in d.columns)))
    tx.commit()
    return db


def _returned(db: Database, w) -> DataFrame:
    from .operators.writes import execute

    return execute(db, w.validate())[1]


@_registered("SELECT * FROM (VALUES (100, 'ATLANTIS')) t(r_regionkey, title)")
def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    return _returned(db, insert(sr, ["r_regionkey", "r_name"], (100, "ATLANTIS")).with_returning(sr["r_regionkey"], project(sr["r_name"], "title")))


@_registered("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (100, 'ATLANTIS'), (101, 'mu')")
def insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    insert_rows(db, Table(_S_REGION, Region), [Region(100, "ATLANTIS"), Region(101, "mu")])
    return db.read(sr)


@_registered("SELECT * FROM (VALUES (1, 'untitled', 3, 6), (2, 'x', 3, 6), (3, 'y', 10, 20)) t(id, title, size, twice)")
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    db.exec(default_insert(note))
    db.exec(insert(note, ["title"], ("x",)))
    db.exec(insert(note, ["title", "size"], (lower(Bound("Y")), 10)))
    return db.read(note)


@_registered("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey % 1 + 2 ELSE n_regionkey END AS n_regionkey FROM nation")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    db.exec(update(sn, set_(sn["n_name"], lower(sn["n_name"])), set_(sn["n_regionkey"], 2), where=equal(sn["n_regionkey"], 1)))
    return db.read(sn)


@_registered("SELECT n_nationkey, n_name, NULL::INTEGER AS n_regionkey FROM nation")
def update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    db.exec(update(sn, set_(sn["n_regionkey"], None), all_rows=True))
    return db.read(sn)


@_registered("SELECT n_nationkey, lower(n_name) AS title FROM nation WHERE n_nationkey < 3")
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    return _returned(db, update(sn, set_(sn["n_name"], lower(sn["n_name"])), where=less(sn["n_nationkey"], 3)).with_returning(sn["n_nationkey"], project(sn["n_name"], "title")))


@_registered("SELECT * FROM nation WHERE n_regionkey <> 2")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    delete_from(sn).where_equal("n_regionkey", 2).exec(db)
    return db.read(sn)


@_registered("SELECT n_name FROM nation WHERE n_nationkey IN (1, 4)")
def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    return _returned(db, delete_from(sn).where_in("n_nationkey", [1, 4]).returning(sn["n_name"]).statement())


@_registered("SELECT * FROM nation WHERE n_regionkey <> 0")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    db.exec(delete(sr, where=equal(sr["r_regionkey"], 0)))
    return db.read(sn)


@_registered("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'NEW' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'NINE'")
def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    db.exec(upsert(insert(sr, ["r_regionkey", "r_name"], (1, "new"), (9, "NINE")), [sr["r_regionkey"]], set_(sr["r_name"], upper(excluded(sr["r_name"])))))
    return db.read(sr)


@_registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'NINE'")
def upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    db.exec(upsert(insert(sr, ["r_regionkey", "r_name"], (1, "new"), (9, "NINE"), (9, "TEN")), [sr["r_regionkey"]]))
    return db.read(sr)


@_registered("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'NINE'")
def tx_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    tx = db.begin()
    tx.exec(insert(sr, ["r_regionkey", "r_name"], (9, "EIGHT")))
    tx.exec(update(sr, set_(sr["r_name"], "NINE"), where=equal(sr["r_regionkey"], 9)))
    tx.commit()
    return db.read(sr)


@_registered("SELECT r_regionkey, r_name FROM region")
def tx_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = scratch(spark, sf_dir)
    tx = db.begin()
    tx.exec(delete(sr, all_rows=True))
    tx.rollback()
    return db.read(sr)


@_registered("SELECT * FROM (VALUES ('001', 'applied'), ('002', 'pending')) t(id, state)")
def migrate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    store = scratch(spark, sf_dir).provider
    made = s.table("extra", s.column("id", I), primary_key=["id"])
    migrations = [Migration("002", (("a.up.json", json.dumps([{"add_columns": "extra", "columns": [{"name": "x", "type": {"kind": "text"}, "nullable": True}]}])),)), Migration("001", (("a.up.json", json.dumps([{"create_table": made.to_json()}])),))]
    runner = Runner(store, clock=lambda: datetime(2024, 1, 1))
    runner.apply(migrations, through="001")
    return spark.createDataFrame([(i, str(x)) for i, x in runner.status(migrations)], "id string, state string")


scratch.root = _store_root
FLAGSHIP = "topk"

from . import queries_store  # noqa: E402, F401  (it registers its queries here)
