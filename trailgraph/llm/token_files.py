"""Token files: one concatenated id array, document boundaries by Elias-Fano.

A file set is a table of *segments*.  A segment is a self-contained binary block: a header, the ids of its documents one
after the other (16 bits where the vocabulary allows, else 32), and two Elias-Fano sequences, for the documents' ends in
the id array and for their keys.  An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n)) bits; its
select directory holds one position for every 256 values, so that ``select(i)`` reads a few bytes and no 64-bit offset
table is kept.  Segments travel in Spark's own writer, so that they reach any store, and are committed once however
often a task is tried.

Documents are ordered by key.  They are dealt to parts by ranges of the key (a key, or none, that very many rows have, by
ranges of its texts too), each part is written by one task in key
order, and a document's global place is its part's start (a sum a part), plus its place in the part.

Defined cases: null or empty text has the end id only; an empty table writes no segment and reads back empty; null keys
come first; equal keys are ordered by text; a text of any length stays in one segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.llm.common import map_arrow, ordered_parts, shuffle_partitions
from trailgraph.llm.wordbpe import WordBpe
from trailgraph.storage import small_batches

MAGIC = b"TRLSEG01"
#: Magic, width of an id in bytes, documents, documents with a null key, first key, ids, bytes of the ends and of the keys.
HEADER = struct.Struct("<8sqqqqqqq")
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 18
#: Parts for each shuffle partition, so that hashing parts to tasks stays even.
PARTS_A_PARTITION = 4
SELECT_EVERY = 256

SEGMENT_SCHEMA = "part int, start_in_part long, n_docs long, n_ids long, last_key long, payload binary"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values in near-minimal space, with select."""

    HEAD = struct.Struct("<qqqq")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> "EliasFano":
        n, low_bits, n_low, n_high = cls.HEAD.unpack_from(data)
        raw = np.frombuffer(data, dtype=np.uint8)[cls.HEAD.size :]
        return cls(n, low_bits, raw[:n_low], raw[n_low : n_low + n_high], np.frombuffer(raw[n_low + n_high :].tobytes(), dtype=np.uint32))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        window = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8].tobytes(), "little")
        return (window >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, whole bytes are skipped by their bit counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at // 8
        left += int(_POPCOUNT[self.high[byte] & ((1 << (at % 8)) - 1)])
        while (ones := int(_POPCOUNT[self.high[byte]])) <= left:
            left -= ones
            byte += 1
        bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        one = 8 * byte + (bits & -bits).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)


class Segment:
    """Reads one binary block."""

    def __init__(self, payload: bytes):
        view = memoryview(payload)
        magic, width, n, self.n_null, self.first_key, n_ids, n_ends, n_keys = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, at = n, HEADER.size
        self.ids = np.frombuffer(view[at : at + width * n_ids], dtype=f"<u{width}")
        at += width * n_ids
        self.ends = EliasFano.from_bytes(view[at : at + n_ends])
        self.keys = EliasFano.from_bytes(view[at + n_ends : at + n_ends + n_keys])

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i lies in the id array, by two selects."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]

    def key(self, i: int) -> int | None:
        return None if i < self.n_null else self.first_key + self.keys.select(i - self.n_null)

    def find(self, key: int) -> range:
        """The documents that have the key, by binary search over selected keys."""
        low, high = self.n_null, self.n_docs
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.key(middle) < key else (low, middle)
        end = low
        while end < self.n_docs and self.key(end) == key:
            end += 1
        return range(low, end)


def segment_bytes(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One block of the documents, whose keys ascend with nulls first."""
    n_null = sum(k is None for k in keys)
    first = keys[n_null] if n_null < len(keys) else 0
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    ends = EliasFano.encode(np.cumsum([len(x) for x in ids])).to_bytes()
    key_part = EliasFano.encode(np.array([k - first for k in keys[n_null:]], dtype=np.uint64)).to_bytes()
    head = HEADER.pack(MAGIC, width, len(keys), n_null, first, len(flat), len(ends), len(key_part))
    return head + flat.astype(f"<u{width}").tobytes() + ends + key_part


def _segment_rows(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer_path)
        width = 2 if max(bpe.vocab_size - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], dtype=np.uint32)
        part, start, keys, ids, held = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            rows = {"part": [part], "start_in_part": [start], "n_docs": [len(keys)], "n_ids": [held], "last_key": [keys[-1]], "payload": [segment_bytes(keys, ids, width)]}
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("last_key", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            encoded = bpe.encode_batch(b.column(2).to_pylist())
            for p, key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoded):
                if keys and (p != part or held >= SEGMENT_IDS):
                    yield close()
                    start += held
                    keys, ids, held = [], [], 0
                if p != part:
                    part, start = p, 0
                keys.append(key)
                ids.append(np.concatenate((x, end)))
                held += len(x) + 1
        if keys:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id``, and writes the segments to ``path`` in ascending key order."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    part, _ = ordered_parts(keyed, "key", "text", n * PARTS_A_PARTITION)
    dealt = keyed.select(part.alias("part"), "key", "text").repartition(n, "part").sortWithinPartitions("part", "key", "text")
    with small_batches(spark):
        map_arrow(dealt, _segment_rows(tokenizer_path, end_id), SEGMENT_SCHEMA).write.parquet(path)


def _documents(with_ids: bool, wanted: list[int] | None = None):
    """Documents of segments, all or those of the wanted keys; their places come from select alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def rows_of(at: int, segment: Segment) -> pa.RecordBatch:
        numbers = range(segment.n_docs) if wanted is None else [i for key in wanted for i in segment.find(key)]
        rows, last, end = [], None, 0
        for i in numbers:
            start = end if last is not None and i == last + 1 else segment.bounds(i)[0]
            last, end = i, segment.ends.select(i)
            ids = segment.ids[start:end]
            rows.append((segment.key(i), at + start, end - start, zlib.crc32(ids.astype("<u4").tobytes())) + ((ids.astype(np.int64),) if with_ids else ()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, payload in zip(b.column(0), b.column(1)):
                yield rows_of(at.as_py(), Segment(payload.as_py()))

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, keys: Sequence[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document of the file set, or of those that have one of
    the stated ``keys``: segments that end before the first key are left out, and in a segment keys are searched by select."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One sum a part comes to the driver: their number is a multiple of the shuffle partitions.
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = dict(zip([p for p, _ in totals], accumulate([0, *(n for _, n in totals)])))
    places = spark.createDataFrame(list(starts.items()), "part int, part_start long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    wanted = None if keys is None else sorted(set(keys))
    if wanted is not None:
        segments = segments.filter(F.col("last_key") >= wanted[0]) if wanted else segments.limit(0)
    placed = segments.join(F.broadcast(places), "part").select((F.col("part_start") + F.col("start_in_part")).alias("at"), "payload")
    return map_arrow(placed, _documents(with_ids, wanted), schema)
