"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors form classes; one vector of each is compared. All are scaled to length one and
turned into the basis of the principal components (eigenvectors of their second moments, which
leaves products as they are). Vectors are laid into tiles of bounded size by the signs of their
leading coordinates, and neighbouring tiles into blocks. Two blocks meet in a task, and there two
tiles are compared, only if the products of their boxes of leading coordinates, with the norms of
the rest, could reach the threshold. Within a pair of tiles the products of the leading dimensions
are accumulated first, in lots; after each lot the product of the suffix norms bounds what the rest
can add, and pairs that cannot reach the threshold any more stop there. Pairs that stay are decided
by the cosine of the vectors as given (scaled to length one), in double precision.

A vector is sent once for each block that its own may meet. Blocks grow with the square root of the
rows up to ``BLOCK_MOST`` vectors, so what is sent grows with rows to the power of 1.5 up to there,
and beyond with rows times rows / ``BLOCK_MOST`` unless boxes rule blocks out. The driver sees a box
a block and one row a cell.

A task writes at most a link count and one connecting edge a vector, never its list of pairs.

Defined cases: null vectors, vectors of norm zero, and vectors with null or non-finite components
link with nothing. Shorter vectors count as if filled up with zeros. Rows with a null id take part;
their component is the smallest non-null id they reach, and null if there is none, and they are not
kept. Repeated rows are vectors of their own that link with each other. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import broadcast_if_small, cut

THRESHOLD, LEADS, TILE = 0.9, (16, 32), 4096
#: Vectors of a block: a multiple of the square root of all, between a tile and a bound for memory.
BLOCK_GROWTH, BLOCK_MOST = 64, 131_072
#: Rows of small tables (a row a cell, or a pair of blocks) that may be broadcast.
SMALL = 500_000
#: What float32 products of unit vectors may be off by.
_SLACK = 1e-5


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0, where=np.isfinite(x)).clip(1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)).clip(1e-300)


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), width))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width), pa.int32()), pa.array(np.tile(np.arange(width), width), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def principal_basis(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors (columns) of the second moments of the unit vectors, the strongest first; width squared numbers reach the driver."""
    sums = vectors.select("embedding").mapInArrow(_moments(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((width, width))
    total[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def _cells(basis: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(basis)
        for batch in batches:
            x = _unit(_matrix(batch.column(1), width)) @ basis[:, :bits]
            cell = (x > 0) @ (1 << np.arange(bits)[::-1]) if bits else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], ["cid", "embedding", "many", "cell"])

    return run


def box_of(x: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Bounds of the leading coordinates of turned vectors, and the greatest norm of the rest."""
    return x[:, :lead].min(axis=0), x[:, :lead].max(axis=0), float(np.sqrt((x[:, lead:] ** 2).sum(axis=1)).max())


def _boxes(basis: np.ndarray, lead: int):
    """(block, box) of each run of a block's rows in the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            x = _unit(_matrix(batch.column(1), len(basis))) @ basis
            found = np.unique(block).tolist()
            boxes = [pickle.dumps(box_of(x[block == t], lead)) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(boxes, pa.binary())], ["block", "box"])

    return run


def _joined(lead: int):
    """One box of all boxes of a block."""

    def run(table: pa.Table) -> pa.Table:
        boxes = [pickle.loads(x.as_buffer()) for x in table.column("box")]
        low, high = (f(np.array([b[k] for b in boxes]), axis=0) for k, f in ((0, np.min), (1, np.max)))
        return pa.table([table.column("block").slice(0, 1), pa.array([pickle.dumps((low, high, max(b[2] for b in boxes)))], pa.binary())], ["block", "box"])

    return run


def reachable(boxes: list[tuple[np.ndarray, np.ndarray, float]], threshold: float) -> list[list[int]]:
    """For each box the boxes that may hold a vector close enough to one of its own."""
    low, high, rest = (np.array([b[k] for b in boxes]) for k in range(3))
    out = []
    for a, b, r in boxes:
        most = np.maximum(np.maximum(a * low, a * high), np.maximum(b * low, b * high)).sum(axis=1) + r * rest
        out.append(np.flatnonzero(most >= threshold - _SLACK).tolist())
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, leads: tuple[int, ...] = LEADS, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors a and b whose cosine reaches the threshold; of one tile with itself only i < j."""
    ra, rb = a @ basis, b @ basis
    i = j = None
    for lead in (*[k for k in leads if k < len(basis)], len(basis)):
        if lead == len(basis):
            break
        sa = np.sqrt(np.maximum((ra[:, lead:] ** 2).sum(axis=1), 0))
        sb = np.sqrt(np.maximum((rb[:, lead:] ** 2).sum(axis=1), 0))
        if i is None:
            part = (ra[:, :lead].astype(np.float32)) @ (rb[:, :lead].astype(np.float32)).T
            part += sa.astype(np.float32)[:, None] * sb.astype(np.float32)[None, :]
            i, j = np.nonzero(part >= threshold - _SLACK)
            if same:
                i, j = i[i < j], j[i < j]
        else:
            keep = np.concatenate([np.zeros(0, bool), *((np.einsum("ij,ij->i", ra[i[k : k + 65536], :lead], rb[j[k : k + 65536], :lead]) + sa[i[k : k + 65536]] * sb[j[k : k + 65536]]) >= threshold - _SLACK for k in range(0, len(i), 65536))])
            i, j = i[keep], j[keep]
        if not len(i):
            return i, j
    if i is None:
        i, j = np.nonzero(a @ b.T >= threshold - _SLACK)
        if same:
            i, j = i[i < j], j[i < j]
    keep = np.concatenate([np.zeros(0, bool), *((a[i[k : k + 65536]] * b[j[k : k + 65536]]).sum(axis=1) >= threshold for k in range(0, len(i), 65536))])
    return i[keep], j[keep]


def _compare(basis: np.ndarray, threshold: float, lead: int):
    def run(table: pa.Table) -> pa.Table:
        """Of two blocks, or one with itself: link counts, and edges that connect what the links connect."""
        table = table.take(pa.compute.sort_indices(table, [("tile", "ascending")]))
        tile = table.column("tile").to_numpy()
        x = _unit(_matrix(table.column("embedding"), len(basis)))
        cid, many, block = (table.column(c).to_numpy() for c in ("cid", "many", "block"))
        edge = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
        tiles = [np.arange(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        near = reachable([box_of(x[t] @ basis, lead) for t in tiles], threshold)
        apart = block[0] != block[-1]
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        links = np.zeros(len(x), np.int64)
        left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, others in enumerate(near) if one or apart else ():
            for b in others:
                if b < a or apart and block[tiles[a][0]] == block[tiles[b][0]]:
                    continue
                for k in range(0, len(tiles[a]), 2048):
                    own = tiles[a][k : k + 2048]
                    for m in range(k if a == b else 0, len(tiles[b]), 2048):
                        other = tiles[b][m : m + 2048]
                        i, j = close_pairs(x[own], x[other], basis, threshold, same=a == b and k == m)
                        i, j = own[i], other[j]
                        np.add.at(links, i, many[j])
                        np.add.at(links, j, many[i])
                        if len(i):
                            left, right = _forest(len(x), np.concatenate((left, i)), np.concatenate((right, j)))
        some = np.flatnonzero(links)
        return pa.table([pa.array(np.concatenate((cid[some], cid[left]))), pa.array(np.concatenate((np.full(len(some), -1), cid[right]))), pa.array(np.concatenate((links[some], np.zeros(len(left), np.int64))))], ["a", "b", "n"])

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the first node of their component, in place of the edges (i, j)."""
    label, last = np.arange(n), None
    while last is None or (label != last).any():
        last = label.copy()
        np.minimum.at(label, i, last[j])
        np.minimum.at(label, j, last[i])
        label = np.minimum(label, label[label])
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    given = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("embedding"))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("embedding", F.when(F.col("usable"), F.transform("embedding", lambda x: x + F.lit(0.0))))
    rows = rows.withColumns({"s1": F.when(F.col("usable"), F.xxhash64("embedding")), "s2": F.when(F.col("usable"), F.xxhash64(F.lit(17), F.col("embedding")))})
    classes = rows.where("usable").groupBy("s1", "s2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    found = _links(classes, n, width, threshold, tile) if n else None
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = connected(found.where("b >= 0").select("a", "b")).select(F.col("node").alias("cid"), "root")
    known = classes.select("s1", "s2", "cid", "least", "many").join(links, "cid", "left").join(roots, "cid", "left")
    known = cut(known.select("s1", "s2", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    first = cut(known.groupBy("root").agg(F.min("least").alias("component_id")))
    known = cut(known.join(first, "root").select("s1", "s2", "n_links", "component_id"))
    out = rows.select("vec_id", "s1", "s2").join(known, ["s1", "s2"], "left")
    component = F.when(F.col("s1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(classes: DataFrame, n: int, width: int, threshold: float, tile: int) -> DataFrame:
    spark = classes.sparkSession
    basis = principal_basis(classes, width)
    bits = min(width, max(0, (-(-n // tile) - 1).bit_length()))
    placed = cut(classes.select("cid", "embedding", "many").mapInArrow(_cells(basis, bits), "cid long, embedding array<double>, many long, cell long"))
    # one row a cell: cells are at most twice as many as tiles of the wanted size
    cells, tiles = [], 0
    for cell, size in sorted(placed.groupBy("cell").agg(F.count("*").alias("n")).collect()):
        cells.append((cell, tiles, -(-size // tile)))
        tiles += cells[-1][2]
    together = max(1, min(BLOCK_MOST, int(BLOCK_GROWTH * n**0.5)) // tile)
    known = broadcast_if_small(spark.createDataFrame(cells, "cell long, start long, parts long"), len(cells), SMALL)
    number = (F.col("start") + F.pmod(F.xxhash64("cid"), F.col("parts"))).cast("int")
    placed = placed.join(known, "cell").withColumn("tile", number).withColumn("block", F.floor(F.col("tile") / together).cast("int"))
    placed = placed.select("block", "embedding", "tile", "cid", "many")
    lead = min(LEADS[0], width)
    boxes = placed.mapInArrow(_boxes(basis, lead), "block int, box binary").groupBy("block").applyInArrow(_joined(lead), "block int, box binary")
    got = {r["block"]: pickle.loads(r["box"]) for r in boxes.collect()}
    order = sorted(got)
    near = reachable([got[t] for t in order], threshold)
    partners = spark.createDataFrame([(t, [order[k] for k in ks]) for t, ks in zip(order, near, strict=True)], "block int, others array<int>")
    partners = broadcast_if_small(partners, sum(map(len, near)), SMALL)
    dealt = placed.join(partners, "block").withColumn("other", F.explode("others"))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tile", "cid", "many", "embedding")
    return cut(dealt.groupBy("i", "j").applyInArrow(_compare(basis, threshold, lead), "a long, b long, n long"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.r AS a, y.r AS b FROM u x JOIN u y ON x.r <> y.r AND list_cosine_similarity(x.e, y.e) >= 0.9
), c(r, z) AS (
  SELECT r, r FROM v UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.z
), k AS (SELECT c.r, min(o.vec_id) AS component_id FROM c JOIN v o ON o.r = c.z GROUP BY 1
), n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept
FROM v JOIN k USING (r) LEFT JOIN n USING (r)
"""
