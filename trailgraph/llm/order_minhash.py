"""Document fingerprints by Order MinHash.

A text's elements are its k-mers of code points, each numbered by its occurrence.  An element's hash falls in one of
``SLOTS`` slots by its leading bits; in each slot the ``TUPLE`` smallest elements are selected, put in text order, and
hashed as a tuple.  A slot agrees between two texts if the same elements are smallest in both *and* stand in the same
order, so that moved passages count as edits, which sets of k-mers don't see.  The share of agreeing slots is taken to
the power 1 / ``TUPLE``: the likeness of single elements.  An empty slot borrows the next filled one's tuple.

Neighbours in key order are met by dealing the texts to key ranges (those of a key, or of none, that very many rows have,
to ranges of the text); each range's first text is also sent to the range
before it (the first range's to the last), so that no task needs another's rows.

Defined cases: null text counts as empty; an empty text has one constant fingerprint; a text shorter than k is one
element; equal keys are ordered by text; a null key is the smallest; a lone document's next is itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import HEAD_CHARS, map_arrow, ordered_parts, shuffle_partitions
from trailgraph.llm.words import mix

K = 8
TUPLE = 2
SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS
#: Survivors a slot aimed at when a long text's larger hashes are passed over; short slots are filled from all of them.
AIMED = 12
PARTS_A_PARTITION = 4
NULL_KEY = -(1 << 63)

_U = np.uint64


def _kmers(codes: np.ndarray) -> np.ndarray:
    """A hash of each k-mer (of the whole text where that is shorter)."""
    h = codes.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    if len(h) < K:
        weights = np.arange(1, len(h) + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)
        return mix((h * weights).sum(keepdims=True, dtype=np.uint64) + _U(len(h)))
    step = 1
    while step < K:
        h = h[:-step] * _U(0x2545F4914F6CDD1D) + (h[step:] ^ (h[step:] >> _U(29)))
        step *= 2
    return mix(h)


def _elements(codes: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers, in text order."""
    kmers = _kmers(codes)
    n = len(kmers)
    place = _U((1 << max(1, n.bit_length())) - 1)
    packed = (kmers & ~place) | np.arange(n, dtype=np.uint64)
    packed.sort()
    identity, at = packed & ~place, (packed & place).astype(np.int64)
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(identity[1:], identity[:-1], out=new[1:])
    first = np.flatnonzero(new)
    run = np.repeat(first, np.diff(np.append(first, n)))
    # Two k-mers whose leading bits agree would count as one: of 40 bits and more, that is not to be expected.
    occurrence = (np.arange(n) - run).astype(np.uint64)
    out = np.empty(n, dtype=np.uint64)
    out[at] = occurrence
    return mix(kmers + out * _U(0xD1342543DE82EF95))


def fingerprint(text: str) -> np.ndarray:
    """One 16-bit tuple hash a slot."""
    if not text:
        return np.zeros(SLOTS, dtype=np.uint16)
    elements = _elements(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    n = len(elements)
    shift = _U(64 - SLOT_BITS)
    places = np.arange(n)
    if n > 3 * AIMED * SLOTS:
        low = elements & _U((1 << (64 - SLOT_BITS)) - 1)
        places = np.flatnonzero(low < _U(int((1 << (64 - SLOT_BITS)) * (AIMED * SLOTS / n))))
        if np.bincount((elements[places] >> shift).astype(np.int64), minlength=SLOTS).min() < TUPLE:
            places = np.arange(n)
    values = elements[places]
    order = np.argsort(values, kind="stable")
    values, places = values[order], places[order]
    edges = np.searchsorted(values, np.arange(SLOTS, dtype=np.uint64) << shift)
    sizes = np.diff(np.append(edges, len(values)))
    filled = np.flatnonzero(sizes)
    take = np.minimum(edges[filled][:, None] + np.arange(TUPLE), len(values) - 1)
    have = np.arange(TUPLE) < sizes[filled][:, None]
    in_order = np.argsort(np.where(have, places[take], n + np.arange(TUPLE)), axis=1)
    chosen = np.take_along_axis(np.where(have, values[take], _U(0)), in_order, axis=1)
    tuples = np.zeros(len(filled), dtype=np.uint64)
    for j in range(TUPLE):
        tuples = mix(tuples * _U(0x9E3779B97F4A7C15) + chosen[:, j] + _U(j + 1))
    slots = np.searchsorted(filled, np.arange(SLOTS)) % len(filled)
    away = (filled[slots] - np.arange(SLOTS)) % SLOTS
    return (mix(tuples[slots] + away.astype(np.uint64) * _U(0xA0761D6478BD642F)) >> _U(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean() ** (1 / TUPLE))


def _hex(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part, tail, key, text; a part's first tail row is the next of its last own row."""
    waiting: tuple | None = None

    def finished(before: tuple, text: str, mark: np.ndarray) -> tuple:
        key, own, own_mark = before
        q = len(own) // 4
        edited = own[: len(own) - q] + text[:q]
        edited_mark = own_mark if edited == own else fingerprint(edited)
        return (key, len(own), hashlib.sha256(edited.encode()).hexdigest(), _hex(own_mark), _hex(edited_mark), likeness(own_mark, edited_mark), likeness(own_mark, mark))

    for b in batches:
        rows = []
        for key, text, tail in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            if tail and waiting is None:
                continue
            text = text or ""
            mark = fingerprint(text)
            if waiting is not None:
                rows.append(finished(waiting, text, mark))
            waiting = None if tail else (key, text, mark)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, and that of the text edited with the next one's beginning, and both likenesses."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("key"))
    part, hot = ordered_parts(keyed, "doc_id", "text", n * PARTS_A_PARTITION)
    is_hot = reduce(Column.__or__, [F.col("doc_id").eqNullSafe(F.lit(k).cast("long")) for k in hot], F.lit(False))
    # Of a hot key, a part's first text is told by its beginning; of other keys, by the key alone.
    keyed = keyed.withColumn("part", part).withColumn("first", F.when(is_hot, F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS)))
    # One row a part: their number goes with the shuffle partitions, and beginnings are short.
    firsts = {r["part"]: r["first"] for r in keyed.filter(is_hot).groupBy("part").agg(F.min("first").alias("first")).collect()} if hot else {}
    heads = sorted((r["part"], r["head"]) for r in keyed.groupBy("part").agg(F.min("key").alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    around = [(p, head, firsts.get(p), heads[i - 1][0]) for i, (p, head) in enumerate(heads)]
    places = spark.createDataFrame(around, "part int, head long, head_first string, before int")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    sent = F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))
    dealt = (
        keyed.join(F.broadcast(places), "part")
        .withColumn("to", F.explode(F.when((F.col("key") == F.col("head")) & F.col("first").eqNullSafe(F.col("head_first")), F.array(own, sent)).otherwise(F.array(own))))
        .select("to.part", "key", "doc_id", "text", "to.tail")
        .repartition(n, "part").sortWithinPartitions("part", "tail", "key", "text")
    )
    return map_arrow(dealt, _rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
