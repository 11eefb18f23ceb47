"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the lowest chunk of every id;
each further level holds the next chunk of those ids that need it. A bitmap beside each level says
which ids go on, and a rank directory (set bits before every 512) finds an id's place on the next
level in constant time. Any id can be read without decoding others.

File format: a table of segments, written as uncompressed Parquet so that any store Spark writes
to can hold it. A segment row holds whole documents in ascending id order: their ids, their token
bounds, where its tokens start, and the code as bytes (``DAC1``, the number of levels, then of each
level its length, its chunks, its bitmap as little-endian 64-bit words and its directory).

Texts are tokenized by words (runs without ASCII blanks): the tokenizers used here drop blanks, so
ids of a text are the ids of its words in order; the tokenizer library encodes each distinct word
a worker meets once. Tokenizers that look beyond a word are refused by ``by_words``.

Defined cases: null text is empty and has the end id alone. Null ids sort first; rows with equal
ids stand in order of their text. An empty table gives an empty file and no rows. Other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_path
from .words import WordRows, hash_spans, pieces, raw, spans

END = 2
_MAGIC, _DIRECTORY, SEGMENT_TOKENS = b"DAC1", 512, 1 << 20
#: Bytes of text that are encoded at once.
PIECE = 4 << 20


def encode(ids: np.ndarray) -> bytes:
    """The directly addressable code of non-negative ids."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        more = rest > 255
        words = np.zeros(-(-len(rest) // 64) * 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        words[: len(packed)] = packed
        sums = np.add.reduceat(more, np.arange(0, len(more), _DIRECTORY), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        levels.append((len(rest), (rest & np.uint64(255)).astype(np.uint8).tobytes(), words.tobytes(), (np.cumsum(sums) - sums).astype("<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint64(8)
    return _MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) + a + b + c for n, a, b, c in levels)


class Codes:
    """Random access to the ids of a code."""

    def __init__(self, data: bytes):
        if bytes(data[:4]) != _MAGIC:
            raise ValueError("not a directly addressable code")
        at, self.levels = 8, []
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            words = -(-n // 64)
            bits = np.frombuffer(data, "<u8", words, at)
            at += 8 * words
            ranks = np.frombuffer(data, "<u4", -(-n // _DIRECTORY), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at one place, by bitmap ranks."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            if not int(bits[word]) >> bit & 1:
                break
            block = i // _DIRECTORY
            whole = bits[block * (_DIRECTORY // 64) : word]
            i = int(ranks[block]) + sum(int(x).bit_count() for x in whole) + (int(bits[word]) & ((1 << bit) - 1)).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if out is not None:
                more = np.unpackbits(bits.view(np.uint8), count=len(chunks), bitorder="little").view(bool)
                value[more] |= out << np.uint32(8)
            out = value
        return out


def by_words(path: str):
    """The tokenizer of a file whose ids of a text are the ids of its words."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = json.load(open(path))
    split = [p for p in made["pre_tokenizer"].get("pretokenizers", [made["pre_tokenizer"]]) if p["type"] == "Split"]
    if not (split and split[0]["behavior"] == "Removed" and split[0]["invert"]) or made["post_processor"] or made["truncation"] or made["padding"]:
        raise ValueError("this tokenizer doesn't drop blanks, so a text can't be encoded word by word")
    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of texts, with the ids of words met before kept in arrays of bounded size."""

    def __init__(self, path: str):
        self.tokenizer = by_words(path)
        #: A special token that splits any text but is no part of words in natural text.
        self.mark = next(t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special).content
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.known = WordRows()
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        count = np.zeros(len(words), np.int64)
        lots, out = [list(range(i, min(i + 512, len(words)))) for i in range(0, len(words), 512)], {}
        joined = [self.mark.join(words[i] for i in lot) for lot in lots]
        for lot, got in zip(lots, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(lot) - 1:
                count[lot] = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
                out[lot[0]] = np.delete(ids, cuts)
            else:  # a word holds the mark itself
                each = [np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32) for i in lot]
                count[lot] = [len(x) for x in each]
                out[lot[0]] = np.concatenate(each)
        return np.concatenate([np.zeros(0, np.uint32), *(out[k] for k in sorted(out))]), count

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column in a row, each with the end id, and their n + 1 bounds."""
        data, at = raw(column)
        start, end = spans(data, at)
        keys, first, inverse = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        if self.known.count + len(keys) > self.known.most:
            self.clear()
        rows = self.known.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            ids, count = self.words([data[start[i] : end[i]].tobytes().decode() for i in first[new].tolist()])
            rows[new] = self.known.add(keys[new])
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(count)))
            self.ids = np.concatenate((self.ids, ids))
        rows = rows[inverse]
        low, size = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        total = np.concatenate(([0], np.cumsum(size)))
        word_bound = np.searchsorted(start, at)
        bound = total[word_bound] + np.arange(len(at))
        doc = np.repeat(np.arange(len(at) - 1), np.diff(word_bound))
        out = np.full(int(bound[-1]), END, np.uint32)
        place = np.repeat(total[:-1] + doc, size) + (within := np.arange(int(total[-1])) - np.repeat(total[:-1], size))
        out[place] = self.ids[np.repeat(low, size) + within]
        return out, bound


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file. A function of the module: what a task's own function refers to
    directly is shipped with each task anew, and would be empty in every task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_SEGMENT = "part int, seq long, first long, n_tokens long, ids array<long>, bounds array<long>, code binary"


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            tokens = np.concatenate([x[0] for x in held])
            ids = pa.chunked_array([x[1] for x in held]).combine_chunks()
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            names = [c.split()[0] for c in _SEGMENT.split(", ")]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([len(tokens)], pa.int64()), lists, pa.array([bounds], pa.list_(pa.int64())), pa.array([encode(tokens)], pa.binary())], names)

        for batch in batches:
            for i, text in pieces(batch.column(1), PIECE):
                tokens, bound = encoder.texts(text)
                held.append((tokens, batch.column(0).slice(i, len(text)).cast(pa.int64()), bound))
                size += len(tokens)
                if size >= SEGMENT_TOKENS:
                    yield segment()
                    seq, first, size, held = seq + 1, first + size, 0, []
        if held:
            yield segment()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None) -> str:
    """Encode the texts of (doc_id, text) rows in ascending id order into the file format at ``out``."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows with equal ids and texts are alike, so the tie only spreads them over tasks
    ordered = slim.repartitionByRange("doc_id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_write(path), _SEGMENT).write.option("compression", "none").parquet(out)
    return out


def _starts(spark, path: str) -> list[tuple[int, int, int]]:
    """(part, start, n) of each partition of the writing job: one row a partition on the driver."""
    out, total = [], 0
    for part, n in sorted(spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        out.append((part, total, n))
        total += n
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            start, ids, bounds, code = (batch.column(k)[i] for k in range(4))
            tokens = np.ascontiguousarray(Codes(code.as_buffer()).all(), "<u4")
            at = np.asarray(bounds.values)
            view = memoryview(tokens.view(np.uint8))
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(start.as_py() + at[:-1]), pa.array(np.diff(at)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a written file, from its decoded ids.

    One row a partition of the writing job reaches the driver, to turn places in a partition into global ones.
    """
    starts = spark.createDataFrame(_starts(spark, path), "part int, start long, n long").select("part", "start")
    rows = spark.read.parquet(path).join(F.broadcast(starts), "part")
    return rows.select((F.col("start") + F.col("first")).alias("start"), "ids", "bounds", "code").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token(spark, path: str, place: int) -> int:
    """The id at a global place of a written file; only its segment's code is read, and only its own chunks are decoded."""
    for part, start, n in _starts(spark, path):
        if start <= place < start + n:
            place -= start
            row = spark.read.parquet(path).where((F.col("part") == part) & (F.col("first") <= place) & (F.col("first") + F.col("n_tokens") > place)).select("first", "code").first()
            return Codes(row["code"])[place - row["first"]]
    raise IndexError(place)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' tokens to a new file in shared storage and read its index back."""
    spark = docs.sparkSession
    return read_index(spark, write_tokens(docs, fresh_path(spark, "tokens"), tokenizer))
