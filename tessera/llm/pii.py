"""Information-theoretic sanitisation of personal data.

Protected entities are email addresses, IP addresses, card numbers and phone numbers, found by
pattern and check. Masking them is not enough if other terms give them away, so the corpus tells
how strongly a term reveals an entity: with shares over all distinct texts, the pointwise mutual
information PMI(t; e) = ln(p(t, e) / (p(t) p(e))) is compared with what the entity itself carries,
IC(e) = -ln p(e). A term discloses e if PMI reaches ``alpha`` * IC(e), which says that seeing the
term narrows the texts down to nearly those of e. Terms are all words, numbers and handles of the
texts that hold the entity, wherever they stand. Rare entities share their texts with many rare
terms by chance, so PMI alone does not decide: were the running words of the table dealt at random,
the chance that so many of the occurrences of t fall into the texts of e is at most
exp(-n(t) KL(n(t, e) / n(t) || size(e) / size)) (Chernoff), and that times the number of distinct
terms must not exceed ``level``, so that less than ``level`` terms an entity are expected by chance.
A term that stands once beside an entity that stands once tells nothing; one that stands in its only
text several times, and hardly elsewhere, does. Disclosing terms are generalised to their kind in
the documents that hold the entity, as the entities themselves are.

All counts are of whole distinct texts, so exact copies of a text say nothing new: copies share one
vote; occurrences are counted over the distinct lines of a text. Near copies are distinct texts. Terms are counted over the whole table, joined to the terms of each text that holds an entity,
and only then paired with its entities; a pair is left out before only where the term stands in more
texts than PMI could allow for any entity.

Defined cases: null and empty texts have no spans. Repeated rows count each. Matches of a kind do
not overlap; matches of different kinds may. A term never overlaps an entity. Other columns are
ignored by ``find_spans`` and kept by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, cut

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA, LEVEL = 0.8, 0.05
#: Copied texts whose numbers of copies may be broadcast.
SMALL = 2_000_000
#: Distinct terms that a task counts before it hands them on.
HELD = 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")
_PLAIN = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ in linear time."""
    out, over, last = [], 0, 0
    at = text.find("@")
    while at >= 0:
        low = max(over, last)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and at >= over and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            over = m.end()
        last = at + 1
        at = text.find("@", last)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities of a text, by start and then kind; code points."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _PLAIN.sub("", m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_PLAIN.sub("", m[0])) <= 15]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """What makes two matches the same entity."""
    a, k, b = span
    value = text[a:b]
    return f"{KINDS[k]}:" + (value.lower() if k == 0 else value if k == 1 else _PLAIN.sub("", value))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the words of a text that overlap no span."""
    starts = [s[0] for s in spans]
    reach = max((b - a for a, _, b in spans), default=0)
    for m in _WORD.finditer(text):
        near = spans[bisect_left(starts, m.start() - reach) : bisect_left(starts, m.end())]
        if not any(a < m.end() and m.start() < b for a, _, b in near):
            yield m.start(), m.end(), m[0].lower()


def _counted(text: str) -> Counter[str]:
    """How often each term stands in the distinct lines of a text; no entity crosses lines."""
    text = "\n".join(dict.fromkeys(text.split("\n")))
    if spans := base_spans(text):
        return Counter(t for _, _, t in _terms(text, spans))
    return Counter(map(str.lower, _WORD.findall(text)))


_FOUND = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, s1 long, s2 long, text string, key long, size long, found array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("base", pa.string()), ("s1", pa.int64()), ("s2", pa.int64()), ("text", pa.string()), ("key", pa.int64()), ("size", pa.int64()), ("found", pa.list_(pa.int64()))])
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            some, rows = batch.slice(i, 1024), []
            for doc_id, text, key, other in zip(*(some.column(c).to_pylist() for c in range(4)), strict=True):
                text = text or ""
                spans = base_spans(text)
                n = Counter(k for _, k, _ in spans)
                found = sorted({_hash(entity(text, s)) for s in spans})
                said = written(spans)
                rows.append({"row": row, "doc_id": doc_id, **{f"n_{KINDS[k]}": n[k] for k in range(4)}, "base_sha256": hashlib.sha256(said.encode()).hexdigest(), "base": said, "s1": key, "s2": other, "text": text if spans else None, "key": key if text else None, "size": _counted(text).total() if spans else None, "found": found or None})
                row += 1
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _corpus_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, times) of many texts at a time: texts that hold a term, and its occurrences. A copy counts as its share of the copies."""

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.float64()), pa.array(list(times.values()), pa.float64())], ["term", "n", "times"])

    n: dict[str, float] = {}
    times: dict[str, float] = {}
    for batch in batches:
        for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            share = 1 / copies
            for term, k in _counted(text).items():
                n[term] = n.get(term, 0) + share
                times[term] = times.get(term, 0) + k * share
            if len(n) >= HELD:
                yield told()
                n.clear()
                times.clear()
    yield told()


def _text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term, own) of each text."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = _counted(text)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.int64()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["key", "term", "own"])


def disclosing_terms(docs: DataFrame, scanned: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """(e, term) pairs where the term discloses the entity; ``docs`` and ``scanned`` as find_spans makes them."""
    texts = cut(scanned.where("key is not null").groupBy("key").agg(F.count("*").alias("copies")))
    total = float(texts.count())
    copied = texts.where("copies > 1")
    own = scanned.where("found is not null").dropDuplicates(["key"])
    held = cut(own.select("key", "size", F.explode("found").alias("e")))
    entities = held.groupBy("e").agg(F.count("*").alias("n_entity"), F.sum("size").alias("size"))
    most = entities.agg(F.max("n_entity")).first()[0]
    if not most:
        return held.select("e", F.lit("").alias("term")).limit(0)
    shared = docs.where("text <> ''").join(broadcast_if_small(copied, copied.count(), SMALL), "key", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    counted = shared.mapInArrow(_corpus_terms, "term string, n double, times double").select(F.xxhash64("term").alias("t"), "n", "times")
    counted = cut(counted.groupBy("t").agg(F.round(F.sum("n")).cast("long").alias("n_term"), F.round(F.sum("times")).cast("long").alias("times")))
    kinds, words = counted.agg(F.count("*"), F.sum("times")).first()
    if not kinds:
        return held.select("e", F.lit("").alias("term")).limit(0)
    # PMI >= alpha * IC needs n_term <= n_both * (total / n_entity) ** (1 - alpha), and n_both <= n_entity
    rare = counted.where(F.col("n_term") <= 1 + most**alpha * total ** (1 - alpha))
    pairs = own.select("key", "text").mapInArrow(_text_terms, "key long, term string, own long").withColumn("t", F.xxhash64("term"))
    pairs = pairs.join(rare, "t").join(held.drop("size"), "key").groupBy("e", "term").agg(F.count("*").alias("n_both"), F.sum("own").alias("own"), F.first("n_term").alias("n_term"), F.first("times").alias("times"))
    pairs = pairs.join(entities, "e")
    told = F.log(F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col("n_term")))
    carried = F.log(F.lit(total) / F.col("n_entity"))
    pairs = pairs.where((carried > 0) & (told >= alpha * carried)).withColumn("q", F.col("own") / F.col("times")).withColumn("s", F.col("size") / F.lit(float(words)))
    apart = F.col("q") * F.log(F.col("q") / F.col("s")) + F.when(F.col("q") < 1, (1 - F.col("q")) * F.log((1 - F.col("q")) / (1 - F.col("s")))).otherwise(0.0)
    return cut(pairs.where((F.col("q") > F.col("s")) & (F.col("times") * apart >= log(kinds / level))).select("e", "term"))


def _add_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, texts, terms = (batch.column(c).to_pylist() for c in ("base", "text", "terms"))
        out = []
        for said, text, own in zip(base, texts, terms, strict=True):
            if own and text:
                spans, own = base_spans(text), set(own)
                said = written(sorted(spans + [(a, 4, b) for a, b, t in _terms(text, spans) if t in own]))
            out.append(said)
        columns = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "s1", "s2"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], [*columns, "spans"])


def _found(docs: DataFrame, alpha: float, level: float) -> DataFrame:
    """doc_id, counts and digest of the entities, all spans, and two hashes of the text, of every row of (doc_id, text)."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("other"))
    scanned = cut(slim.mapInArrow(_scan, _FOUND))
    risky = disclosing_terms(slim, scanned, alpha, level)
    each = risky.groupBy("e").agg(F.collect_list("term").alias("terms"))
    held = scanned.where("found is not null").select("row", F.explode("found").alias("e")).distinct()
    terms = held.join(each, "e").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    out = scanned.drop("found", "key", "size").join(terms, "row", "left")
    return out.mapInArrow(_add_terms, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, s1 long, s2 long, spans string")


def find_spans(docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """doc_id, counts and digest of the entities, and all spans, of every row of documents."""
    return _found(docs.select("doc_id", "text"), alpha, level).drop("s1", "s2")


def redact(text: str, spans: str) -> str:
    """The text with each span generalised to its kind, like ``[EMAIL]``; overlapping spans become one."""
    out, over = [], 0
    for part in spans.split(",") if spans else []:
        kind, a, b = part.split(":")
        a, b = int(a), int(b)
        if a >= over:
            out += [text[over:a], f"[{kind.upper()}]"]
        over = max(over, b)
    return "".join(out) + text[over:]


def sanitise(docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """``docs`` with their entities and disclosing terms generalised.

    Spans depend on the text alone, so rows get them by two hashes of their text; ids need not be unique or given.
    """
    if taken := {"__pii_1", "__pii_2", "__pii_spans"} & set(docs.columns):
        raise ValueError(f"the rows already have columns named {sorted(taken)}")
    text = F.col("text").cast("string")
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    found = _found(docs.select("text", F.lit(None).cast("long").alias("doc_id")), alpha, level).where("spans <> ''")
    found = found.dropDuplicates(["s1", "s2"]).select(F.col("s1").alias("__pii_1"), F.col("s2").alias("__pii_2"), F.col("spans").alias("__pii_spans"))
    keyed = docs.withColumns({"__pii_1": keys[0], "__pii_2": keys[1]})
    joined = keyed.join(found, ["__pii_1", "__pii_2"], "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__pii_spans")
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not (t and s) else redact(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("__pii_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return joined.mapInArrow(run, schema)


#: The base columns alone; what terms disclose has no SQL. Matches are marked with code point 1, which the texts must not hold.
BASE_ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
), s AS (
  SELECT r, 0 AS k, 'email' AS name, regexp_replace(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', chr(1) || '\0' || chr(1), 'g') AS y FROM t
  UNION ALL SELECT r, 1, 'ip', regexp_replace(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', chr(1) || '\0' || chr(1), 'g') FROM t
  UNION ALL SELECT r, 2, 'card', regexp_replace(x, '[0-9]([\x20-]?[0-9])+', chr(1) || '\0' || chr(1), 'g') FROM t
  UNION ALL SELECT r, 3, 'phone', regexp_replace(x, '\+[0-9][\x20().0-9-]+[0-9]', chr(1) || '\0' || chr(1), 'g') FROM t
), p AS (SELECT r, k, name, string_split(y, chr(1)) AS parts FROM s
), m AS (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM p WHERE len(parts) > 1
), v AS (
  SELECT r, k, name, parts[i] AS v, CAST(list_sum(list_transform(parts[:i - 1], lambda z: length(z))) AS BIGINT) AS a, regexp_replace(parts[i], '[^0-9]', '', 'g') AS d FROM m
), f AS (
  SELECT r, k, name, a, a + length(v) AS b FROM v WHERE CASE k
    WHEN 1 THEN list_max(list_transform(string_split(v, '.'), lambda z: CASE WHEN length(ltrim(z, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(z, '0') AS INTEGER) END)) <= 255
    WHEN 2 THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse(d)[j] AS INTEGER) ELSE 2 * CAST(reverse(d)[j] AS INTEGER) - CASE WHEN CAST(reverse(d)[j] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 3 THEN length(d) BETWEEN 10 AND 15 ELSE true END
), g AS (
  SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN g USING (r)
"""
