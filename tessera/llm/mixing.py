"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every source gets a target number of words. As often as its words go wholly into the target, all
its documents are taken; the rest of the target is taken from the documents whose hash lies below
a threshold. The threshold is found without sorting documents: words are summed by source and by
the first hex digits of the hash, the prefix sums of these buckets show in which one the budget
ends, and only the documents of that bucket are summed again by the next digits, four times three
digits in all. The thresholds of larger budgets include those of smaller ones. The last bucket
(12 equal digits) is taken whole if at least half of it goes into the budget.

Targets: sources in code point order, null last, weigh the given weights, repeating; they share
the words of all sources, no target exceeds ``most`` times its source's words, and what a capped
source cannot take is shared again by weight.

Defined cases: null text has no words. Sources without words have target 0. The hash is that of
source, id and text, so reruns agree; null ids and texts hash like empty ones. Rows alike in all
three are numbered and the number is hashed with them, so that of many copies as many are taken as
the budget asks for; which of them is left open. Other columns are ignored by ``mix_plan`` and kept
by ``apply_mix``, which refuses columns named like its own. Sources are told apart in one task, one
row a source; everything else is spread by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, cut

WEIGHTS, MOST, LEVELS, DIGITS = (5, 2, 1), 3, 4, 3
#: Source rows that may be broadcast.
SMALL = 100_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, source: Column, text: Column) -> Column:
    told = F.concat(F.coalesce(F.octet_length(source).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(source, F.lit("")))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), told, F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))


def number_copies(rows: DataFrame, repeated: DataFrame | None, h: str) -> DataFrame:
    """``rows`` whose hash ``h`` differs between copies too; ``repeated`` are the hashes that several rows have.

    Copies are numbered within the partitions they are read in, after those of the partitions before.
    """
    if repeated is None:
        return rows
    names = rows.columns
    known = broadcast_if_small(repeated, repeated.count(), SMALL)
    placed = rows.withColumn("__mix_part", F.spark_partition_id())
    many = cut(placed.join(known, h, "left_semi"))
    own = Window.partitionBy(h, "__mix_part")
    before = Window.partitionBy(h).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.groupBy(h, "__mix_part").agg(F.count("*").alias("__mix_k")).withColumn("__mix_k", F.coalesce(F.sum("__mix_k").over(before), F.lit(0)))
    starts = cut(starts)
    many = many.withColumn("__mix_i", F.row_number().over(own.orderBy("__mix_part"))).join(broadcast_if_small(starts, starts.count(), SMALL), [h, "__mix_part"])
    k = F.col("__mix_i") - 1 + F.col("__mix_k")
    many = many.withColumn(h, F.when(k == 0, F.col(h)).otherwise(F.md5(F.concat(F.col(h), k.cast("string")).cast("binary"))))
    return rows.join(known, h, "left_anti").select(*names).unionByName(many.select(*names))


def repeated_hashes(sizes: DataFrame) -> DataFrame | None:
    """The hashes h of several rows, or None; rows are counted by a shorter hash, as most stand alone."""
    some = cut(sizes.groupBy(F.xxhash64("h").alias("x")).agg(F.count("*").alias("n"), F.min("h").alias("h")).where("n > 1").select("h"))
    return None if some.isEmpty() else some


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of (source, size) rows; windows run over one row a source.

    The capped sources are those with the least words for their weight, so one pass in that order finds them.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("weight").over(rest))
    free = level.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(all_)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return free.select("source", "source_size", target.alias("target"))


def mix_thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, times (that all its documents are taken), cutoff and whole.

    A document is taken once more if its hash starts below the cutoff, or with it where ``whole``.
    ``sizes`` has (source, h, size).
    """
    plan = source_targets(sizes, weights, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = cut(plan.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")))
    n = plan.count()
    edge = plan.select("source", "budget", F.lit(0).cast("long").alias("under"), F.lit("").alias("cutoff"))
    for level in range(1, LEVELS + 1):
        old, new = DIGITS * (level - 1), DIGITS * level
        known = broadcast_if_small(edge.select(F.col("source").alias("s"), F.col("cutoff").alias("c"), "budget", "under"), n, SMALL)
        inside = sizes.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, old) == F.col("c")))
        buckets = inside.groupBy("source", F.substring("h", 1, new).alias("cutoff")).agg(F.sum("size").alias("size"), F.first("budget").alias("budget"), F.first("under").alias("under"))
        running = Window.partitionBy("source").orderBy("cutoff").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("under", F.col("under") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        ends = buckets.where(F.col("under") <= F.col("budget")).groupBy("source").agg(F.max(F.struct("cutoff", "under", "size", "budget")).alias("x"))
        edge = cut(ends.select("source", "x.*"))
    whole = F.col("under") + F.col("size") / 2 <= F.col("budget")
    edge = edge.select(F.col("source").alias("s"), "cutoff", whole.alias("whole"))
    return cut(plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "times", "cutoff", "whole"))


def copies_of(h: Column) -> Column:
    head = F.substring(h, 1, LEVELS * DIGITS)
    return F.col("times") + F.coalesce((head < F.col("cutoff")) | ((head == F.col("cutoff")) & F.col("whole")), F.lit(False)).cast("int")


def _hash(docs: DataFrame) -> Column:
    return hash_of(docs["doc_id"], docs["source"].cast("string"), docs["text"])


def _sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, source, size, h) of every row, no two with one h, and the hashes that several rows had."""
    sizes = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), _hash(docs).alias("h")))
    repeated = repeated_hashes(sizes)
    return sizes if repeated is None else cut(number_copies(sizes, repeated, "h")), repeated


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of documents."""
    sizes, _ = _sizes(docs)
    found = mix_thresholds(sizes, weights, most)
    found = broadcast_if_small(found.withColumnRenamed("source", "s"), found.count(), SMALL)
    out = sizes.join(found, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies_of(F.col("h"))).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    if taken := {c for c in docs.columns if c.startswith("__mix_")}:
        raise ValueError(f"the rows already have columns named {sorted(taken)}")
    sizes, repeated = _sizes(docs)
    found = mix_thresholds(sizes.select("source", "h", "size"), weights, most)
    found = broadcast_if_small(found.select(F.col("source").alias("__mix_s"), "times", "cutoff", "whole"), found.count(), SMALL)
    packed = docs.select(F.struct("*").alias("__mix_row"), F.col("source").cast("string").alias("__mix_source"), _hash(docs).alias("__mix_h"))
    packed = number_copies(packed, None if repeated is None else repeated.withColumnRenamed("h", "__mix_h"), "__mix_h")
    out = packed.join(found, F.col("__mix_source").eqNullSafe(F.col("__mix_s")))
    out = out.withColumn("__mix_n", copies_of(F.col("__mix_h"))).where("__mix_n > 0")
    return out.select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("__mix_copy")).select("__mix_row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(CAST(strlen(source) AS VARCHAR), '-') || ':' || coalesce(source, '') || coalesce(text, '')) AS h0,
    row_number() OVER (PARTITION BY h0) - 1 AS copy, left(CASE WHEN copy = 0 THEN h0 ELSE md5(h0 || copy) END, 12) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM t GROUP BY source
), o AS (
  SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l,
    row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS i FROM s
), f AS (SELECT arg_min(l, i) AS l FROM o WHERE l * w < 3 * n
), g AS (SELECT source, n, CASE WHEN f.l IS NULL THEN CAST(3 * n AS DOUBLE) ELSE least(CAST(3 * n AS DOUBLE), f.l * w) END AS target FROM o, f
), b AS (
  SELECT source, h, sum(size) AS k, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM t GROUP BY source, h
)
SELECT t.doc_id, t.size, g.n AS source_size, g.target,
  CAST(t.size * CASE WHEN g.n = 0 THEN 0 ELSE floor(target / n) + CASE WHEN u + k / 2 <= target - floor(target / n) * n THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source JOIN b ON t.source IS NOT DISTINCT FROM b.source AND t.h = b.h
"""
