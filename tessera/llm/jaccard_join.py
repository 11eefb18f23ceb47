"""Exact n-gram Jaccard self-join by prefix filters under several global token orders.

A document's tokens are its distinct word shingles. If two sets of n tokens reach similarity t,
they share one of the first n - ceil(t n) + 1 tokens under *every* global order of the tokens. The
orders here: rarest first (by corpus frequency), and two pseudo-random orders that also put the
tokens of a single document first. A pair is a candidate if it shares prefix tokens under all of
them; candidates are then verified on their whole sets. Any order is exact; frequency only makes
the prefixes selective, so boilerplate that many documents share stands at the end of them.

How it runs:

1. One pass hashes the shingles of every document (numpy over Arrow batches) and sends them, as
   packed arrays by range of hash, to tasks that count in how many documents each occurs. A token
   that many documents of a chunk hold is counted in the chunk and sent as one number, while the
   chunk keeps its holders, so no token makes a range of hashes large. Only tokens of two documents
   or more return to their documents, in one row per document.
2. Documents with equal sets form a class with one representative. For every token of the rarest
   first prefixes, the holders are compared with the smallest holder (as many pairs as postings).
   A group of near copies is connected by this, at linear cost.
3. Where a token's holders still lie in several components, its holders are compared in blocks of
   bounded size, whole, so no link can be missed and no list of pairs is written. Tokens with common
   holders are taken together, as long as these are a few blocks. Where shared tokens chain more
   documents than that together, each token's holders are compared by themselves, a pair at its
   first common token only, so the work is that of the tokens and not the square of the chain.

Defined cases: null text, empty text and text without words have no shingles and link with
nothing. A null doc_id is a row like any other; a component's id is its smallest non-null doc_id.
Repeated rows are documents of their own with equal sets. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .scratch import cut, drop_shuffles
from .words import U, hashed, mix, pieces, releasing

_LOW = 40
_STEP = (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
#: Of tokens and prefixes. The second and third prefix only rule pairs out, so their low 32 bits do: a chance match leaves a pair to be verified.
_KINDS = (np.int64, np.int64, np.int32, np.int32)
BLOCK_ROWS, BLOCK_TOKENS = 1024, 4_000_000
#: Blocks of documents up to which the holders of connected tokens are compared together.
WIDE = 8
#: From so many holders in a chunk on, a token is counted there. The mark stands for its holders.
HOT, _MARK = 64, 65535

_DOC = "node long, doc_id long, key long, n int, s1 long, s2 long, toks array<long>, pre1 array<long>, pre2 array<int>, pre3 array<int>"


def shingle_sets(column, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow text column.

    With fewer than ``k`` words the whole sequence counts as one shingle.
    """
    words, at = hashed(column)
    code = mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    roll = np.zeros(max(0, len(words) - k + 1), U)
    for i in range(k):
        roll += words[i : i + len(roll)] * code[i]
    roll = mix(roll)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(roll[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            few = words[a:b]
            out.append(mix(np.sum(few * code[: b - a], dtype=U, keepdims=True) ^ U(b - a)) if b > a else few)
    return out


def _scan(k: int, bits: int, chunk_bytes: int):
    """Rows (bucket, chunk, payload): packed postings by range of hash, and the document rows of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, text in pieces(batch.column(1), chunk_bytes):
                chunk = (part << 20) | seq
                seq += 1
                ids, key = batch.column(0).slice(first, len(text)), batch.column(2).slice(first, len(text))
                sets = shingle_sets(text, k)
                signs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                known: dict[bytes, int] = {}
                lead = np.array([known.setdefault(s, i) for i, s in enumerate(signs)]) == np.arange(len(signs))
                size = np.array([len(s) for s in sets], np.int32)
                kept = [s for s, one in zip(sets, lead, strict=True) if one]
                tokens = (np.concatenate(kept) if kept else np.zeros(0, U)) >> U(64 - _LOW - bits)
                owner = np.repeat(np.flatnonzero(lead).astype(np.uint16), size[lead])
                order = np.argsort(tokens, kind="stable")
                tokens, owner, weight, hot = _counted_here(tokens[order], owner[order])
                bound = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=U) << U(_LOW))
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                rows = [(-1 - chunk % (1 << bits), pickle.dumps((ids.fill_null(0).to_numpy(), nulls, key.to_numpy(), size, b"".join(signs), lead, hot)))]
                for bucket in np.flatnonzero(np.diff(bound)).tolist():
                    own = slice(bound[bucket], bound[bucket + 1])
                    low, marked = tokens[own], owner[own] == _MARK
                    rows.append((bucket, pickle.dumps(((low >> U(32)).astype(np.uint8), low.astype(np.uint32), owner[own], weight[own][marked]))))
                for i in range(0, len(rows), 4096):
                    some = rows[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([r[1] for r in some], pa.binary())], ["bucket", "chunk", "payload"])

    return run


def _counted_here(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Sorted postings with those of each token of many holders as one with a mark, what each stands for, and (token, bounds, holders) of those."""
    edge = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True]))) if len(tokens) else np.zeros(1, np.int64)
    run = np.diff(edge)
    hot = run >= HOT
    inside = np.repeat(hot, run)
    kept = (tokens[edge[:-1][hot]], np.concatenate(([0], np.cumsum(run[hot]))), owner[inside])
    first = ~inside
    first[edge[:-1]] = True
    weight = np.ones(len(tokens), np.uint32)
    weight[edge[:-1][hot]] = run[hot]
    owner = np.where(inside, np.uint16(_MARK), owner)
    return tokens[first], owner[first], weight[first], kept


def _count(table: pa.Table) -> pa.Table:
    """Of one range of hashes: to each chunk, its postings of tokens that two chunk rows or more hold."""
    chunks, payloads = table.column("chunk").to_numpy(), table.column("payload")
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        return table.select(["chunk", "payload"]).add_column(1, "bucket", pa.array([-1] * table.num_rows, pa.int32()))
    bucket = table.column("bucket")[0].as_py()
    high, low, owner, weight, size = [], [], [], [], []
    for x in payloads:
        h, lo, o, w = pickle.loads(x.as_buffer())
        each = np.ones(len(o), np.int64)
        each[o == _MARK] = w
        high.append(h), low.append(lo), owner.append(o), weight.append(each), size.append(len(o))
    token = np.concatenate(high).astype(U) << U(32) | np.concatenate(low)
    owner, chunk = np.concatenate(owner), np.repeat(np.arange(len(chunks)), size)
    order = np.argsort(token, kind="stable")
    token = token[order]
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    many = np.repeat(np.add.reduceat(np.concatenate(weight)[order], edge[:-1]), np.diff(edge))
    shared = many >= 2
    token, owner, chunk, many = token[shared], owner[order][shared], chunk[order][shared], np.minimum(many[shared], 2**32 - 1).astype(np.uint32)
    order = np.argsort(chunk, kind="stable")
    bound = np.searchsorted(chunk[order], np.arange(len(chunks) + 1))
    rows = [(int(chunks[i]), pickle.dumps((owner[own], token[own], many[own]))) for i in range(len(chunks)) if len(own := order[bound[i] : bound[i + 1]])]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "bucket", "payload"])


def prefixes(tokens: np.ndarray, df: np.ndarray, n: int, percent: int) -> list[np.ndarray]:
    """The shared tokens in the prefix of a set under each order.

    ``tokens`` are those of the set's ``n`` that other documents hold too; the others come first in every order.
    """
    length = n - -(-percent * n // 100) + 1 - (n - len(tokens))
    if length <= 0:
        return []
    return [tokens[order[:length]] for order in (np.lexsort((tokens, df)), *(np.argsort(mix(tokens * step)) for step in _STEP))]


def _gather(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one chunk: a row per document, with its shared tokens if its prefix holds any."""
        chunk = table.column("chunk")[0].as_py()
        owner, token, many = [np.zeros(0, np.uint16)], [np.zeros(0, U)], [np.zeros(0, np.uint32)]
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload"), strict=True):
            if bucket < 0:
                ids, nulls, key, size, signs, lead, hot = pickle.loads(payload.as_buffer())
            else:
                o, t, m = pickle.loads(payload.as_buffer())
                owner.append(o), token.append(t | U(bucket << _LOW)), many.append(m)
        owner, token, many = map(np.concatenate, (owner, token, many))
        if (marked := owner == _MARK).any():
            at = np.searchsorted(hot[0], token[marked])
            held = np.concatenate([hot[2][hot[1][i] : hot[1][i + 1]] for i in at.tolist()])
            run = np.diff(hot[1])[at]
            owner = np.concatenate((owner[~marked], held))
            token, many = (np.concatenate((x[~marked], np.repeat(x[marked], run))) for x in (token, many))
        order = np.argsort(owner, kind="stable")
        token, many = token[order], many[order]
        bound = np.searchsorted(owner[order], np.arange(len(size) + 1))
        lists: list[list] = [[], [], [], []]
        for i, n in enumerate(size.tolist()):
            own = token[bound[i] : bound[i + 1]]
            found = prefixes(own, many[bound[i] : bound[i + 1]], n, percent) if lead[i] and len(own) else []
            for to, x, kind in zip(lists, [own, *found] if found else [None] * 4, _KINDS, strict=True):
                to.append(None if x is None else x.astype(kind))
        sign = np.frombuffer(signs, np.int64).reshape(-1, 2)
        node = (chunk << 16) + np.arange(len(size), dtype=np.int64)
        arrays = [pa.array(node), pa.array(ids, mask=nulls), pa.array(key), pa.array(size), pa.array(sign[:, 0]), pa.array(sign[:, 1]), *(pa.array(x, pa.list_(pa.from_numpy_dtype(kind))) for x, kind in zip(lists, _KINDS, strict=True))]
        return pa.table(arrays, [c.split()[0] for c in _DOC.split(", ")])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    size = [len(s) for s in sets]
    if not sum(size):
        return out
    token, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    start, run = edge[:-1], np.diff(edge)
    for length in np.unique(run[(run > 1) & (run <= 24)]).tolist():
        held = owner[start[run == length][:, None] + np.arange(length)]
        for i in range(length - 1):
            for j in range(i + 1, length):
                out += np.bincount(held[:, i] * m + held[:, j], minlength=m * m).astype(np.int32).reshape(m, m) if m <= 64 else _scatter(held[:, i], held[:, j], m)
    wide = np.flatnonzero(run > 24)
    for i in range(0, len(wide), 2048):
        some = wide[i : i + 2048]
        x = np.zeros((m, len(some)), np.float32)
        at = np.concatenate([np.arange(start[w], start[w] + run[w]) for w in some])
        x[owner[at], np.repeat(np.arange(len(some)), run[some])] = 1
        out += np.triu((x @ x.T).astype(np.int32), 1)
    return out + out.T


def _scatter(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, m), np.int32)
    np.add.at(out, (i, j), 1)
    return out


def _first_common(x: np.ndarray, y: np.ndarray) -> int:
    return np.intersect1d(x, y, assume_unique=True)[0]


def _block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one block (or two against each other): edges that connect what its links connect."""
        cand = table.column("cand").to_numpy()
        a: list[int] = []
        b: list[int] = []
        order = np.argsort(cand, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], cand[order][1:] != cand[order][:-1], [True]))) if len(cand) else np.zeros(1, np.int64)
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            rows = table.take(pa.array(order[low:high]))
            own = rows.column("own")[0].as_py()
            node, root, n, side = (rows.column(x).to_numpy().astype(np.int64) for x in ("node", "root", "n", "side"))
            columns = {x: [np.asarray(v.values) for v in rows.column(x).combine_chunks()] if rows.num_rows else [] for x in ("toks", "pre1", "pre2", "pre3")}
            open_ = np.triu(root[:, None] != root[None, :], 1)
            if len(set(side.tolist())) > 1:
                open_ &= side[:, None] != side[None, :]
            open_ &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
            for x in ("pre1", "pre2", "pre3"):
                if open_.any():
                    open_ &= _overlaps(columns[x]) > 0
            i, j = np.nonzero(open_)
            if own is not None and len(i):
                first = np.array([_first_common(columns["pre1"][x], columns["pre1"][y]) for x, y in zip(i, j, strict=True)])
                i, j = i[first == own], j[first == own]
            if len(i) <= 4 * len(node):
                inter = np.array([len(np.intersect1d(columns["toks"][x], columns["toks"][y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
            else:
                inter = _overlaps(columns["toks"])[i, j].astype(np.int64)
            ok = 100 * inter >= percent * (n[i] + n[j] - inter)
            i, j = i[ok], j[ok]
            label, last = np.arange(len(node)), None
            while last is None or (label != last).any():
                last = label.copy()
                np.minimum.at(label, i, last[j])
                np.minimum.at(label, j, last[i])
                label = np.minimum(label, label[label])
            moved = np.flatnonzero(label != np.arange(len(node)))
            a += node[moved].tolist()
            b += node[label[moved]].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def text_key(text: Column) -> Column:
    """A hash of the text as it stands."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bits: int | None = None) -> DataFrame:
    """A row per document: its size, a 128-bit signature of its set, and its shared tokens with their prefixes where these can lead to a link."""
    spark = docs.sparkSession
    if bits is None:
        bits = max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    chunk_bytes = min(64 << 20, max(4 << 20, 512 << bits))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("key"))
    packed = slim.mapInArrow(releasing(_scan(k, bits, chunk_bytes)), "bucket int, chunk long, payload binary")
    # stored here, the first shuffle, which is the largest, is gone before the next one and its result are written
    shared = cut(packed.groupBy("bucket").applyInArrow(releasing(_count), "chunk long, bucket int, payload binary"))
    del packed
    drop_shuffles(spark)
    return shared.groupBy("chunk").applyInArrow(releasing(_gather(percent)), _DOC)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; see the module's text."""
    return _components(docs, id_col, text_col, k, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of every component: that of the smallest id, then of the smallest text hash.

    Rows without words link with nothing and stay. Columns named like this function's own are refused.
    """
    if taken := {"__lose_id", "__lose_key"} & set(docs.columns):
        raise ValueError(f"the rows already have columns named {sorted(taken)}")
    rows = cut(_components(docs, id_col, text_col, k, percent).where("n > 0").select("doc_id", "key", "root"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select("root", F.col("x.doc_id").alias("best_id"), F.col("x.key").alias("best_key"))
    best = cut(best)
    marked = rows.join(best, "root").select("doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("best_key"))).alias("best"))
    each = cut(marked.groupBy("doc_id", "key").agg(F.max("best").alias("best"), F.count("*").alias("many")))
    losers = each.where("not best").select(F.col("doc_id").alias("__lose_id"), F.col("key").alias("__lose_key"))
    kept = docs.join(losers, _same_row(docs, losers, id_col, text_col), "left_anti")
    repeated = each.where("best and many > 1").select(F.col("doc_id").alias("__lose_id"), F.col("key").alias("__lose_key"))
    if repeated.isEmpty():
        return kept
    # rows of one id and text can't be told apart by a join: one of each stays, and all others as they are
    repeated = cut(repeated)
    single = docs.join(repeated, _same_row(docs, repeated, id_col, text_col), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, _same_row(kept, repeated, id_col, text_col), "left_anti").unionByName(single)


def _same_row(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> Column:
    return docs[id_col].cast("long").eqNullSafe(rows["__lose_id"]) & (text_key(docs[text_col]) == rows["__lose_key"])


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """doc_id, key, n, root and component_id of every row."""
    spark = docs.sparkSession
    table = cut(document_sets(docs, id_col, text_col, k, percent))
    drop_shuffles(spark)
    classes = cut(table.where("n > 0").groupBy("s1", "s2").agg(F.min("node").alias("rep"), F.min("doc_id").alias("least")))
    sets = table.where("toks is not null").join(classes.select(F.col("rep").alias("node")), "node", "left_semi").select("node", "n", "toks", "pre1", "pre2", "pre3")
    held = cut(sets.select("node", F.explode("pre1").alias("token")))
    lists = cut(held.groupBy("token").agg(F.min("node").alias("c"), F.count("*").alias("many")).where("many > 1").select("token", "c"))
    held = held.join(lists.select("token"), "token", "left_semi")
    stars = held.join(lists, "token").where("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
    roots = cut(connected(_verified(stars, sets, percent)))
    drop_shuffles(spark)
    more = _open_links(spark, held, lists, sets, roots, percent)
    if more is not None:
        # a node's edge to its root connects what the links before it did
        roots = cut(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    classes = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("s1", "s2", "least", F.coalesce("root", "rep").alias("root"))
    first = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut(classes.join(first, "root").select("s1", "s2", "root", "component_id"))
    return table.select("doc_id", "key", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", "key", "n", "root", "component_id")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` that share prefix tokens under the other orders too and are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"), F.col("pre2").alias("a2"), F.col("pre3").alias("a3"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"), F.col("pre2").alias("b2"), F.col("pre3").alias("b3"))
    inter = F.size(F.array_intersect("ta", "tb")).cast("long")
    both = pairs.join(left, "a").join(right, "b").where(f"100L * least(na, nb) >= {percent} * greatest(na, nb)").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
    return both.select("a", "b", "na", "nb", inter.alias("inter")).where(f"100 * inter >= {percent} * (na + nb - inter)").select("a", "b")


def _blocks(tokens: Column) -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(tokens) / BLOCK_TOKENS)).cast("int")


def _open_links(spark: SparkSession, held: DataFrame, lists: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame | None:
    """Edges for the links that remain between components which share a prefix token."""
    marked = held.join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
    marked = cut(marked)
    still = cut(marked.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("node").alias("c")).where("r1 <> r2").select("token", "c"))
    opened = cut(marked.join(still, "token").select("node", "root", "c").distinct())
    if opened.isEmpty():
        return None
    groups = connected(opened.select(F.col("c").alias("a"), F.col("node").alias("b")))
    groups = cut(groups.withColumnRenamed("root", "cand"))
    members = cut(opened.select("node", "root").distinct().join(groups, "node").withColumn("own", F.lit(None).cast("long")))
    docs = sets.select("node", "n", "toks", "pre1", "pre2", "pre3")
    sized = members.join(docs.select("node", F.size("toks").alias("tokens")), "node").groupBy("cand").agg(_blocks(F.col("tokens")).alias("blocks"))
    wide = cut(sized.where(F.col("blocks") > WIDE).select("cand"))
    if not wide.isEmpty():
        tokens = still.join(groups.withColumnRenamed("node", "c"), "c").join(wide, "cand", "left_semi").select("token")
        alone = marked.join(tokens, "token").select("node", "root", F.col("token").alias("cand"), F.col("token").alias("own"))
        members = members.join(wide, "cand", "left_anti").select("node", "root", "cand", "own").unionByName(alone)
    members = cut(members.join(docs, "node"))
    blocks = members.groupBy("cand").agg(_blocks(F.size("toks")).alias("blocks"))
    total = members.agg(F.count("*"), F.sum(F.size("toks"))).first()
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total[0] / BLOCK_ROWS), ceil((total[1] or 0) / BLOCK_TOKENS))
    dealt = members.join(blocks, "cand").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("share", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cand"), F.lit(shares))).otherwise(F.col("cand"))).withColumn("i", F.when(F.col("blocks") == 1, -1).otherwise(F.least("side", "other"))).withColumn("j", F.greatest("side", "other"))
    return cut(dealt.groupBy("share", "i", "j").applyInArrow(releasing(_block(percent)), "a long, b long"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, r, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM t)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (
  SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n u ON u.r = a JOIN n v ON v.r = b WHERE 100 * k >= 80 * (u.n + v.n - k)
), c(r, z) AS (
  SELECT r, r FROM t UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.z
)
SELECT t.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, CAST(min(o.doc_id) AS BIGINT) AS component_id
FROM t LEFT JOIN n USING (r) JOIN c ON c.r = t.r JOIN t o ON o.r = c.z GROUP BY t.r, t.doc_id
"""
