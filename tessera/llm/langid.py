"""Language identification by segmentation-marginalised unigram models.

Each language has probabilities for the pieces of one fixed public vocabulary. The probability of
a word is the sum over *all* its segmentations into pieces, found by a forward algorithm; a text's
is the product over its words (runs of non-blank bytes, A-Z lower-cased, with the blank that a
piece may start with in front). Every single byte is a piece as well, so each word has a
segmentation. Piece probabilities are fitted by expectation maximisation with the matching
backward pass. Bayes' rule with the languages' shares gives the prediction and its probability.

Learning reads only the text and the non-null language of rows that the caller marks, and of these
a sample of about ``sample_rows`` distinct texts a language, at least one, drawn by a hash of the
text: a documented bound on the labelled rows that fit the classifier. Scoring covers whole texts of
all rows, and sums over whole words however long they are: those of more than 32 bytes (sentences, in
scripts without blanks) go through the same recursion in a window that moves along them. Only learning
cuts such words, into stretches of about 32 bytes that end between characters.

Defined cases: null text or a text without a letter gives ``und`` with score 0; so does everything
if no labelled row can be learned from. Ties go to the smaller language name. Repeated rows are
judged alike. Other columns are ignored. Digits tell no language and part words like blanks do, so all
letters beside them count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut
from .words import U, WordRows, hash_spans, lower_ascii, pieces, raw, releasing, spans

UNKNOWN = "und"
_STRETCH, _SCALE = 32, 32.0
#: Long words that are scored together, and their places at a time.
_ROWS, _CELLS = 1024, 8192


def vocabulary(path: str) -> list[bytes]:
    """The distinct pieces of a sentencepiece model as bytes (word start as a blank), then all single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found[model.id_to_piece(i).replace("▁", " ").encode()] = None
    return [*(x for x in found if 1 < len(x) <= _STRETCH), *(bytes([i]) for i in range(256))]


@dataclass
class Pieces:
    """Lookup of pieces by hash."""

    keys: np.ndarray
    ids: np.ndarray
    count: int
    longest: int
    maybe: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Pieces:
        end = np.cumsum([len(x) for x in words])
        keys = hash_spans(np.frombuffer(b"".join(words), np.uint8), end - [len(x) for x in words], end)
        order = np.argsort(keys)
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys & U((1 << 20) - 1)).astype(np.int64)] = True
        return cls(keys[order], order, len(words), max(map(len, words)), maybe)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash; ``count`` where there is none."""
        out = np.full(len(hashes), self.count, np.int32)
        some = np.flatnonzero(self.maybe[(hashes & U((1 << 20) - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, hashes[some]), self.count - 1)
            out[some] = np.where(self.keys[at] == hashes[some], self.ids[at], self.count)
        return out


def stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut into stretches of about 32 bytes, at most 35, between characters: the word of each, its start and end."""
    parts = -(-(end - start) // _STRETCH)
    word = np.repeat(np.arange(len(start)), parts)
    k = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = start[word] + k * _STRETCH
    for _ in range(3):  # bytes that go on with a character
        low -= (k > 0) & ((data[low] & 0xC0) == 0x80) if len(low) else 0
    high = np.concatenate((low[1:], end[-1:]))
    last = np.concatenate((word[1:] != word[:-1], [True])) if len(word) else np.zeros(0, bool)
    high[last] = end[word[last]]
    return word, low, high


def lattices(known: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
    """By length, and in lots of bounded size: the rows of stretches, and found[i][j] = pieces of bytes i to j of each.

    ``first`` marks stretches that start a word; these have a blank in front.
    """
    length = end - start + first
    for size in np.unique(length).tolist():
        every = np.flatnonzero(length == size)
        for lot in range(0, len(every), 16384):
            rows = every[lot : lot + 16384]
            text = np.full((len(rows), size), 32, np.uint8)
            own = first[rows]
            for flag in (0, 1):
                some = np.flatnonzero(own == flag)
                text[some, flag:] = data[start[rows[some]][:, None] + np.arange(size - flag)]
            flat, base = text.ravel(), np.arange(len(rows)) * size
            found: list[dict[int, np.ndarray]] = [{} for _ in range(size)]
            for span in range(1, min(known.longest, size) + 1):
                low = (base[:, None] + np.arange(size - span + 1)).ravel()
                ids = known.find(_windows(flat, low, span)).reshape(len(rows), -1)
                for i in range(size - span + 1):
                    if span == 1 or (ids[:, i] < known.count).any():
                        found[i][i + span] = ids[:, i]
            yield rows, size, found


def _windows(flat: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
    """Hashes of equal length, overlapping spans; the same as hash_spans gives."""
    from .words import _codes, _power, mix

    up = _power("up", span)
    out = np.zeros(len(low), U)
    codes = _codes()[flat]
    for k in range(span):
        out += codes[low + k] * up[k]
    return mix(out + U(span))


def forward(size: int, found, table: np.ndarray, rows: int) -> list[np.ndarray]:
    """alpha[j]: the summed probability of all segmentations of the first j bytes, times 32**j, for each row and language."""
    alpha = [np.ones((rows, table.shape[1]))] + [np.zeros((rows, table.shape[1])) for _ in range(size)]
    for i in range(size):
        for j, ids in found[i].items():
            alpha[j] += alpha[i] * table[ids] * _SCALE ** (j - i)
    return alpha


def long_scores(known: Pieces, table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each word, a blank in front, for each language.

    Like ``forward``, but only the last ``known.longest`` sums are held, and scaled again every few bytes; the
    memory does not depend on how long words are.
    """
    n, g, reach = len(start), table.shape[1], known.longest
    size = end - start + 1
    step = max(8, _CELLS // n)
    out, log_scale = np.zeros((n, g)), np.zeros((n, g))
    held = np.zeros((n, reach, g))  # sums at the last places, the newest last
    held[:, -1] = 1
    scale = _SCALE ** np.arange(reach, 0, -1)[:, None]
    for low in range(0, int(size.max()), step):
        width = min(step, int(size.max()) - low)
        # bytes from reach - 1 before the first place that is filled here
        place = np.arange(low - reach + 1, low + width)[None, :]
        real = (place >= 1) & (place < size[:, None])
        text = np.where(real, data[np.minimum(start[:, None] + np.maximum(place, 1) - 1, len(data) - 1)], 32).astype(np.uint8)
        flat, base = text.ravel(), np.arange(n)[:, None] * text.shape[1]
        ids = np.full((n, width, reach), known.count, np.int32)  # pieces of span reach - k that end at each place
        for span in range(1, reach + 1):
            first = np.arange(reach - span, reach - span + width)
            found = known.find(_windows(flat, (base + first).ravel(), span)).reshape(n, width)
            ids[:, :, reach - span] = np.where(low + np.arange(width) + 1 >= span, found, known.count)
        for t in range(width):
            new = (held * table[ids[:, t]] * scale).sum(axis=1)
            held = np.concatenate((held[:, 1:], new[:, None]), axis=1)
            if (low + t) % 8 == 7:
                top = np.maximum(held.max(axis=1), 1e-300)
                held /= top[:, None]
                log_scale += np.log(top)
            done = np.flatnonzero(size == low + t + 1)
            if len(done):
                out[done] = np.log(np.maximum(held[done, -1], 1e-300)) + log_scale[done] - size[done, None] * np.log(_SCALE)
    return out


def expected(size: int, found, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected count of each piece in rows that occur ``weight`` times, under each language."""
    rows = len(weight)
    alpha = forward(size, found, table, rows)
    beta = [np.zeros_like(alpha[0]) for _ in range(size)] + [np.ones_like(alpha[0])]
    for i in range(size - 1, -1, -1):
        for j, ids in found[i].items():
            beta[i] += beta[j] * table[ids] * _SCALE ** (j - i)
    total = np.maximum(alpha[size], 1e-300)
    out = np.zeros_like(table)
    for i in range(size):
        for j, ids in found[i].items():
            share = weight * alpha[i] * table[ids] * _SCALE ** (j - i) * beta[j] / total
            for g in range(table.shape[1]):
                out[:, g] += np.bincount(ids, share[:, g], len(table))
    return out


@dataclass
class LanguageModel:
    """Languages with their log shares, and piece probabilities (a last row of zeros for no piece)."""

    langs: list[str]
    shares: np.ndarray
    known: Pieces
    table: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each word under each language."""
        out = np.zeros((len(start), len(self.langs)))
        long = end - start > _STRETCH
        short = np.flatnonzero(~long)
        for rows, size, found in lattices(self.known, data, start[short], end[short], np.ones(len(short), np.int64)):
            alpha = forward(size, found, self.table, len(rows))[size]
            out[short[rows]] = np.log(np.maximum(alpha, 1e-300)) - size * np.log(_SCALE)
        longs = np.flatnonzero(long)
        longs = longs[np.argsort(end[longs] - start[longs], kind="stable")]
        while len(longs):
            # words of like length together, so that little is filled up
            size = end[longs] - start[longs]
            n = min(_ROWS, int(np.searchsorted(size, 2 * size[0], side="right")))
            out[longs[:n]] = long_scores(self.known, self.table, data, start[longs[:n]], end[longs[:n]])
            longs = longs[n:]
        return out


_seen: dict[str, tuple[WordRows, list]] = {}


def plain(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z, and digits blanks."""
    return np.where((data >= 48) & (data <= 57), np.uint8(32), lower_ascii(data))


def _letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span has a letter of any script."""
    plain = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
    out = plain[end] > plain[start]
    for i in np.flatnonzero(~out).tolist():
        part = data[start[i] : end[i]]
        out[i] = (part >= 128).any() and any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
    return out


def score_texts(model: LanguageModel, column) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of an Arrow column: the index of its language (-1: none) and its probability."""
    data, at = raw(column)
    data = plain(data)
    start, end = spans(data, at)
    bound = np.searchsorted(start, at)
    keys, first, inverse = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
    if model.name not in _seen:
        _seen.clear()
        _seen[model.name] = (WordRows(), [np.zeros((0, len(model.langs) + 1), np.float32)])
    known, values = _seen[model.name]
    if known.count + len(keys) > known.most:
        known.clear()
        values[0] = values[0][:0]
    rows = known.find(keys)
    new = np.flatnonzero(rows < 0)
    if len(new):
        s, e = start[first[new]], end[first[new]]
        fresh = np.concatenate((model.word_scores(data, s, e), _letters(data, s, e)[:, None]), axis=1).astype(np.float32)
        rows[new] = known.add(keys[new])
        values[0] = np.concatenate((values[0], fresh))
    each = values[0][rows][inverse]
    total = np.zeros((len(at) - 1, each.shape[1]))
    filled = np.flatnonzero(np.diff(bound))
    if len(filled):
        total[filled] = np.add.reduceat(each, bound[:-1][filled], axis=0, dtype=np.float64)
    best, score = np.full(len(total), -1), np.zeros(len(total))
    some = np.flatnonzero(total[:, -1] > 0)
    if len(model.langs) and len(some):
        logp = total[some, :-1] + model.shares
        best[some] = logp.argmax(axis=1)
        score[some] = 1 / np.exp(logp - logp.max(axis=1, keepdims=True)).sum(axis=1)
    return best, score


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch's texts."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for i, text in pieces(batch.column(1)):
            own = langs[i : i + len(text)]
            for lang in sorted(set(own)):
                data, at = raw(text.filter(pa.array(own == lang)))
                data = plain(data)
                start, end = spans(data, at)
                _, first, n = np.unique(hash_spans(data, start, end), return_index=True, return_counts=True)
                words = [data[start[k] : end[k]].tobytes() for k in first.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _expect(shared, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        total = np.zeros_like(table)
        for batch in batches:
            own = np.array(batch.column(0).to_pylist(), dtype=object)
            n = batch.column(2).to_numpy().astype(np.float64)
            words = batch.column(1).cast(pa.large_binary())
            _, bounds, data = words.buffers()
            at = np.frombuffer(bounds, np.int64, len(words) + 1 + words.offset)[words.offset :]
            data = np.frombuffer(data, np.uint8)
            word, low, high = stretches(data, at[:-1], at[1:])
            first = np.concatenate(([True], word[1:] != word[:-1])).astype(np.int64) if len(word) else np.zeros(0, np.int64)
            code = np.array([langs.index(x) for x in own], np.int64)
            for rows, size, found in lattices(known, data, low, high, first):
                weight = np.zeros((len(rows), len(langs)))
                weight[np.arange(len(rows)), code[word[rows]]] = n[word[rows]]
                total += expected(size, found, table, weight)
        piece, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, g])], ["g", "piece", "n"])

    return run


def fit(labelled: DataFrame, vocabulary_path: str, sample_rows: int = 500, rounds: int = 3, smoothing: float = 0.05) -> LanguageModel:
    """A model from rows (text, lang); rows without text or language are left out.

    About ``sample_rows`` distinct texts of a language are read, at least one. What reaches the driver is bounded by vocabulary times languages.
    """
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("key"))
    found = rows.groupBy("lang", "key").agg(F.count("*").alias("n")).withColumn("draw", F.pmod("key", F.lit(1 << 30)))
    found = found.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("draw").alias("least")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    langs = sorted(counts)
    known = Pieces.of(vocabulary(vocabulary_path))
    table = np.full((known.count + 1, len(langs)), 1 / known.count)
    table[-1] = 0
    if not langs:
        return LanguageModel([], np.zeros(0), known, table)
    below = F.lit(0)
    for r in found:
        below = F.when(F.col("lang") == r["lang"], F.lit(max(r["least"] + 1, min(1 << 30, (sample_rows << 30) // r["texts"])))).otherwise(below)
    sample = rows.where(F.pmod("key", F.lit(1 << 30)) < below).dropDuplicates(["lang", "key"])
    words = sample.select("lang", "text").mapInArrow(releasing(_word_counts), "lang string, word binary, n long")
    words = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(spark.sparkContext.defaultParallelism, "word"))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((known, table))
        got = words.mapInArrow(releasing(_expect(shared, langs)), "g int, piece int, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).toArrow()
        table = np.full_like(table, smoothing)
        np.add.at(table, (got.column("piece").to_numpy(), got.column("g").to_numpy()), got.column("n").to_numpy())
        table /= table.sum(axis=0)
        table[-1] = 0
    shares = np.log(np.array([counts[x] for x in langs]) / sum(counts.values()))
    return LanguageModel(langs, shares, known, table)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns of every row, and its language and score under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if text_col in keep else [F.col(f"`{text_col}`")]))
    at = slim.columns.index(text_col)
    schema = T.StructType([*slim.schema.fields[: len(keep)], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        said = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, text in pieces(batch.column(at).cast(pa.string()), 2 << 20):
                b, s = score_texts(model, text)
                best.append(b), score.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(said[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score))], [*keep, *names])

    return slim.mapInArrow(releasing(run), schema)


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a probability of at least ``least``."""
    names = ("__lang_pred", "__lang_score")
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"the rows already have columns named {sorted(taken)}")
    rows = predict(docs, model, keep=tuple(docs.columns), names=names)
    return rows.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)


def held_out(doc_id: Column) -> Column:
    """Whether the row's id puts it into the held-out quarter; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_open(docs: DataFrame, vocabulary_path: str | None = None, **how) -> LanguageModel:
    """A model from the documents that aren't held out."""
    path = vocabulary_path or public_tokenizers.path("piece_bpe_32k.model")
    return fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), path, **how)


def identify(docs: DataFrame, vocabulary_path: str | None = None, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that aren't held out."""
    model = fit_open(docs, vocabulary_path, **how)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
