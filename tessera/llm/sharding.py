"""Contiguous shards of near equal bytes, from global prefix sums of sizes.

Rows are range-partitioned and sorted by the given order once. The bytes and rows of every
partition (one driver row a partition) give each partition its global offset, so each task can
number its own rows. The cuts stand at equal shares of all bytes: a row belongs to the shard that
holds its middle byte, so a cut is never further than half a row from its target.

Defined cases: null text has no bytes, and every row weighs one more than its bytes. Null ids
sort first. Rows with equal ids keep the order in which they are read; no group of them has to fit
one task. An empty table gives no rows. Input columns keep their values; new columns named like
existing ones are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut

_SIZE, _TIE, _PART, _INDEX = "__shard_size", "__shard_tie", "__shard_part", "__shard_index"


def shard_by_bytes(rows: DataFrame, size: Column, order_by: tuple[str, ...] = ("doc_id",), shards: int = 8) -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard)."""
    if taken := {"shard", "slot"} & set(rows.columns):
        raise ValueError(f"the rows already have columns named {sorted(taken)}")
    keyed = rows.withColumns({_SIZE: size.cast("long"), _TIE: F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(*order_by, _TIE).sortWithinPartitions(*order_by, _TIE)
    dealt = cut(dealt.withColumn(_PART, F.spark_partition_id()))
    sums = dealt.groupBy(_PART).agg(F.sum(_SIZE).alias("b"), F.count("*").alias("n")).collect()
    offsets, total, count = {}, 0, 0
    for r in sorted(sums, key=lambda r: r[_PART]):
        offsets[r[_PART]] = (total, count)
        total, count = total + r["b"], count + r["n"]
    cuts = np.array([-(-2 * total * s // shards) for s in range(1, shards)], np.int64)
    names = [c for c in rows.columns]
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(_INDEX, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(_SIZE).to_numpy()
            at = at or offsets[batch.column(_PART)[0].as_py()]
            end = at[0] + np.cumsum(sizes)
            shard = np.searchsorted(cuts, 2 * end - sizes, side="right").astype(np.int32)
            index = at[1] + np.arange(len(sizes))
            at = (int(end[-1]), at[1] + len(sizes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shard), pa.array(index)], [*names, "shard", _INDEX])

    numbered = dealt.mapInArrow(number, schema)
    first = {r["shard"]: r["i"] for r in numbered.groupBy("shard").agg(F.min(_INDEX).alias("i")).collect()}
    start = F.element_at(F.array(*(F.lit(first.get(s, 0)).cast("long") for s in range(shards))), F.col("shard") + 1)
    return numbered.select(*(F.col(f"`{c}`") for c in names), "shard", (F.col(_INDEX) - start).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    done = shard_by_bytes(slim, F.col("size"), ("doc_id",), shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) + 1 AS size FROM documents
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, sum(size) OVER () AS total FROM t
), s AS (
  SELECT *, CAST(least(7, (2 * e - size) * 8 // (2 * total)) AS INTEGER) AS shard FROM p
), b AS (
  SELECT list(c ORDER BY k) AS crc FROM (
    SELECT k, list_reduce(list_prepend(CAST(k AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(k))
)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST(('0x' || h) AS BIGINT))), lambda c, v: xor(c // 256, crc[(xor(c, v) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, b
"""
