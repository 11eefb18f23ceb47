"""Curated functions with their arity; any other name goes to Spark as it is."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: name: (least arguments, most arguments or None)
CURATED: dict[str, tuple[int, int | None]] = {"COUNT": (1, 1), "SUM": (1, 1), "MIN": (1, 1), "MAX": (1, 1), "AVG": (1, 1), "COALESCE": (2, None), "LOWER": (1, 1), "UPPER": (1, 1), "ABS": (1, 1)}
AGGREGATES = frozenset(("COUNT", "SUM", "MIN", "MAX", "AVG"))
#: Names that Spark resolves to aggregates without saying so by their class. Statements place them like scalars.
SPARK_AGGREGATES = frozenset("any any_value array_agg bit_and bit_or bit_xor bool_and bool_or collect_list collect_set corr count_if every first first_value kurtosis last last_value listagg median mode percentile percentile_approx skewness some std stddev stddev_pop stddev_samp string_agg var_pop var_samp variance".split())


@lru_cache(maxsize=1024)
def spark_aggregate(name: str) -> bool:
    """Whether Spark computes an uncurated function over groups, by its registry."""
    if name.lower() in SPARK_AGGREGATES:
        return True
    spark = SparkSession.getActiveSession()
    if spark is None:
        return False
    try:
        said = " ".join(r[0] for r in spark.sql(f"DESCRIBE FUNCTION `{name}`").collect())
    except PySparkException:
        return False  # unknown names are refused by Spark where they stand
    found = re.search(r"Class: (\S+)", said)
    return bool(found and (".aggregate." in found[1] or name.lower().endswith("_agg")))


def aggregate_column(name: str, argument: str | None, distinct: bool) -> Column:
    """An aggregate over a column of the pre-projected input; no argument means all rows."""
    if argument is None:
        return F.count("*")
    if not distinct:
        return {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}[name](argument)
    if name == "COUNT":
        return F.count_distinct(F.col(argument))
    if name == "SUM":
        return F.sum_distinct(F.col(argument))
    return F.expr(f"{name.lower()}(DISTINCT `{argument}`)")


def scalar_column(name: str, arguments: list[Column]) -> Column:
    known = {"COALESCE": F.coalesce, "LOWER": F.lower, "UPPER": F.upper, "ABS": F.abs}
    return known[name](*arguments) if name in known else F.call_function(name, *arguments)
