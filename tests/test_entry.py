"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 90 and set(sql) <= set(queries)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r["o_totalprice"] for r in rows] == sorted((r["o_totalprice"] for r in rows), reverse=True)
