"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts are lower-cased and cut into tokens (runs of letters and digits). A seed is the hash of the
tokens at the set places of a fixed mask; places that the mask leaves out may hold any token, so a
substituted token there does not hide a match. The seeds of all windows of the benchmark are
joined with those of all windows of the corpus. Around each hit the two texts are compared token
by token on the hit's diagonal: an overlap is verified where at least ``WINDOW`` - ``MISSES`` of
``WINDOW`` successive tokens are equal. The masks were chosen so that *every* such overlap holds a
hit of one of them (tests prove it over all placements of the misses), so no overlap is lost.

The benchmark's seeds are broadcast if the bytes of their counted rows keep within ``SMALL``; a
larger benchmark is joined by a shuffle on the seed. A seed carries the ``_NEAR`` tokens around it and no
more, so a row has one bounded size however long its item is. Long texts are cut into stretches of
``STRETCH`` tokens with enough of their neighbours to see every window.

Defined cases: null or empty texts on either side match nothing. Items of fewer tokens than
``WINDOW`` - ``MISSES`` match where all of their tokens stand in a row, those of fewer than
``SHORTEST`` match nothing. In the report, repeated rows of an id are one document, as are rows with a
null id; ``decontaminated`` judges every row by its own text. Other columns are ignored by the report
and kept by ``decontaminated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The set places of each mask.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
WINDOW, MISSES = 12, 2
STRETCH = 1024
#: Bytes of a benchmark's seed rows that may be broadcast.
SMALL = 64 << 20

_SPAN = max(m[-1] for m in MASKS) + 1
_SIDE = WINDOW - 1
_NEAR = _SPAN + 2 * _SIDE
#: The fewest tokens of an item that can be matched: those that the shorter mask spans.
SHORTEST = min(m[-1] for m in MASKS) + 1
#: A seed row holds its neighbours and a few numbers, and stands in a hash table.
_ROW_BYTES = 8 * _NEAR + 96


def _tokens(text):
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, part, seed, and at (0-based in part) of the seeds that start from place ``low`` up to ``high``, exclusive.

    Every expression has generated code, so ``part`` is only referred to, and copied for no seed.
    """
    places = F.when(F.col("low") < F.col("high"), F.sequence(F.col("low"), F.col("high") - 1))
    placed = rows.select(*keep, "part", F.explode(places).alias("at"))
    token = {o: F.get("part", F.col("at") + o) for m in MASKS for o in m}
    seeds = [F.when(token[m[-1]].isNotNull(), F.xxhash64(F.lit(i), *(token[o] for o in m))) for i, m in enumerate(MASKS)]
    return placed.select(*keep, "part", "at", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _around(name: str) -> list:
    """The tokens around a seed as ``name``_near, and how many of them stand before it as ``name``_back."""
    back = F.least(F.col("at"), F.lit(_SIDE))
    return [back.alias(f"{name}_back"), F.slice("part", F.col("at") - back + 1, F.lit(_NEAR)).alias(f"{name}_near")]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched) of every verified overlap; matched is the most equal tokens in a window."""
    items = benchmark.select(F.col("item_id"), _tokens(F.col("text")).alias("part"))
    items = items.select("item_id", "part", F.lit(0).alias("low"), F.size("part").alias("high"), F.least(F.size("part"), F.lit(WINDOW - MISSES)).alias("need"))
    index = _seeds(items.where(F.col("high") >= SHORTEST), ["item_id", "need"]).select("seed", "item_id", "need", *_around("item")).distinct()
    rows = index.count()
    whole = docs.select(F.col("doc_id"), _tokens(F.col("text")).alias("t"))
    starts = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1, F.lit(STRETCH)))
    cut = whole.select("doc_id", "t", F.explode(starts).alias("s"))
    before = F.least(F.col("s"), F.lit(_SIDE))
    parts = cut.select("doc_id", F.slice("t", F.col("s") - before + 1, F.lit(STRETCH + 2 * (_SIDE + _SPAN))).alias("part"), before.alias("low"))
    parts = parts.select("doc_id", "part", "low", F.least(F.size("part"), F.col("low") + STRETCH).alias("high"))
    seeds = _seeds(parts, ["doc_id"])
    if rows * _ROW_BYTES <= SMALL:
        hits, at, tokens = seeds.join(F.broadcast(index), "seed"), F.col("at"), "part"
    else:
        hits, at, tokens = seeds.select("seed", "doc_id", *_around("doc")).join(index, "seed"), F.col("doc_back"), "doc_near"
    back = F.least(at, F.col("item_back"), F.lit(_SIDE))
    x, y = F.slice(tokens, at - back + 1, F.lit(_NEAR)), F.slice("item_near", F.col("item_back") - back + 1, F.lit(_NEAR))
    near = hits.select("doc_id", "item_id", "need", x.alias("x"), y.alias("y"))
    equal = F.zip_with("x", "y", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    # exploded, as a filter on a generated column stays above the join, which keeps its generated code
    same = near.select("doc_id", "item_id", "need", F.explode(F.array(equal)).alias("same")).where(F.aggregate("same", F.lit(0), lambda a, x: a + x) >= F.col("need"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same")), lambda i: F.aggregate(F.slice("same", i, WINDOW), F.lit(0), lambda a, x: a + x)))
    return same.select("doc_id", "item_id", "need", best.alias("matched")).where(F.col("matched") >= F.col("need")).groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no overlap with the benchmark; rows are told apart by hashes of their text."""
    if taken := {"__leak_1", "__leak_2"} & set(docs.columns):
        raise ValueError(f"the rows already have columns named {sorted(taken)}")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    found = overlaps(docs.select(F.struct(*keys).alias("doc_id"), "text"), benchmark).select(F.col("doc_id.col1").alias("__leak_1"), F.col("doc_id.col2").alias("__leak_2")).distinct()
    return docs.join(found, (keys[0] == found["__leak_1"]) & (keys[1] == found["__leak_2"]), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS q, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t, least(len(t), 10) AS need FROM benchmark
), x AS (SELECT doc_id, r, unnest(t) AS w, unnest(range(len(t))) AS i FROM d
), y AS (SELECT item_id, q, need, unnest(t) AS w, unnest(range(len(t))) AS j FROM b WHERE need >= 6
), m AS (
  SELECT doc_id, item_id, need, count(*) OVER (PARTITION BY r, q, i - j ORDER BY j RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM x JOIN y USING (w)
)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS matched FROM m WHERE n >= need GROUP BY doc_id, item_id
"""
