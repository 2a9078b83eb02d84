"""Best-fit packing of token pieces into sequences, with certified bin counts.

Pieces are dealt to partitions of bounded size by a hash of their key.  Each partition is packed by best-fit decreasing
and certified: dual feasible functions give a lower bound of its bin count.  A partition whose bin count meets its bound is
closed.  Partitions with a gap between the two exchange their documents: all of them are dealt anew to partitions with
another hash, and best-fit decreasing runs again; a round is kept if it takes fewer bins.  Where that saved
nothing it is not tried again before fewer than half as many pieces are in such partitions.  Once every partition is
certified, or can't be mended so, but the whole count is above the bound of all pieces, what the partitions' bounds were
rounded up by is in bins that are not full: the pieces of those are exchanged in the same way, in fewer and (up to
``1 << PATIENCE`` times) larger partitions.  Rounds end when the whole count meets the bound of all pieces, when
``PATIENCE`` rounds in a row save nothing, or after ``rounds``; ``gap`` tells by how many sequences the count is above the
bound then, and so may be above the fewest.
The driver sees counts a round and one histogram of at most ``capacity`` lengths.

Defined cases: null or empty text is one piece, the end id; an empty table gives no sequence; a text longer than the
capacity is cut, all its pieces but the last are full sequences of their own; repeated rows are packed each; a null id
is an id; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import discard, map_arrow, written
from trailgraph.llm.wordbpe import WordBpe

#: Pieces of one packing partition, on average.
PIECES_A_PARTITION = 20_000
#: Rounds without a saving after which the exchange ends.
PATIENCE = 3
#: Rounds of exchange; an id has bits for ``MOST_ROUNDS``.
ROUNDS, MOST_ROUNDS = 24, (1 << 10) - 1
#: Dual feasible functions of the first family that are tried.
DFF_STEPS = 40

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, fill long, partition_bins long, partition_bound long"


def _pieces(tokenizer_path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer_path)
        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            rows: list[tuple] = []
            for key, ids in zip(b.column(0).to_pylist(), bpe.encode_batch(b.column(1).to_pylist())):
                ids = np.concatenate((ids, end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((key, k, at, len(piece), zlib.crc32(piece.tobytes())) + ((piece.astype(np.int64),) if with_ids else ()))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every text's ids and the end id, cut into pieces of at most ``capacity``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, _pieces(tokenizer_path, end_id, capacity, with_ids), PIECE_SCHEMA + ", ids array<long>" * with_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound that dual feasible functions prove; ``counts[x]``: pieces of length x."""
    x = np.flatnonzero(counts)
    n = counts[x].astype(object)
    if not len(x):
        return 0
    sizes = x.astype(object)
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(1, DFF_STEPS):  # (k + 1) x / C rounded down over k, or x / C where that is whole
        steps, over = (k + 1) * x // capacity, (k + 1) * x % capacity
        best = max(best, -(-int((np.where(over == 0, steps * k, steps * (k + 1)).astype(object) * n).sum()) // (k * (k + 1))))
    for e in np.unique(np.minimum(x, capacity - x)):  # pieces above C - e count as whole bins, those below e not at all
        if 0 < e <= capacity // 2:
            best = max(best, -(-int((np.where(x > capacity - e, capacity, np.where(x < e, 0, x)).astype(object) * n).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each piece.  Open bins are kept by room, with a bit mask of the rooms in use."""
    bins, places = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    mask, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = mask >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, chosen = capacity, used
            used += 1
        bins[i], places[i] = chosen, capacity - room
        if room > need:
            by_room.setdefault(room - need, []).append(chosen)
            mask |= 1 << (room - need)
    return bins, places


def _pack_partition(capacity: int, round_number: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pieces["length"].to_numpy()
        bins, places = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        out = pieces[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (np.int64(round_number) << 53) + (pieces["bucket"].to_numpy(dtype=np.int64) << 24) + bins
        out["offset"], out["fill"] = places, fill[bins]
        out["partition_bins"] = len(fill)
        out["partition_bound"] = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return out

    return pack


def _packed(pieces: DataFrame, n: int, capacity: int, round_number: int, larger: int = 1) -> DataFrame:
    buckets = max(1, -(-n // (larger * PIECES_A_PARTITION)))
    key = F.pmod(F.xxhash64(F.lit(round_number), "doc_id", "piece", "ids_crc32"), F.lit(buckets))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return written(pieces.select(*columns, key.alias("bucket")).groupBy("bucket").applyInPandas(_pack_partition(capacity, round_number), PACKED_SCHEMA))


def _bins(packed: DataFrame) -> int:
    """Sequences."""
    return packed.filter("offset = 0").count()


def pack(pieces: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``fill`` (the sequence's length) to pieces of at most ``capacity``, the bins and the
    bound of the partition that a piece was packed in last, and ``gap``: sequences above the bound of all pieces."""
    if not 0 <= rounds <= MOST_ROUNDS:
        raise ValueError(f"rounds must be from 0 to {MOST_ROUNDS}")
    pieces = written(pieces)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    bound = lower_bound(counts, capacity)
    tables = [_packed(pieces, int(counts.sum()), capacity, 0)]
    total, idle, fruitless, larger = _bins(tables[0]), 0, 0, 2
    gap = F.col("partition_bins") > F.col("partition_bound")
    for round_number in range(1, rounds + 1):
        if total <= bound or idle >= PATIENCE:
            break
        whole = reduce(DataFrame.unionByName, tables)
        # Partitions with a gap exchange all they have; without any, or where that saves nothing, bins that are not full.
        n = whole.filter(gap).count() if not idle else 0
        gaps = n > 0 and (not fruitless or 2 * n <= fruitless)
        chosen = gap if gaps else F.col("fill") < capacity
        dealt = whole.filter(chosen)
        n = n if gaps else dealt.count()
        before = _bins(dealt)
        again = _packed(dealt, n, capacity, round_number, 1 if gaps else larger)
        saved = before - _bins(again)
        if saved > 0:
            total, idle = total - saved, 0
            tables = [t.filter(~chosen) for t in tables] + [again]
        else:
            idle, fruitless = idle + (not gaps), n if gaps else fruitless
            larger = larger if gaps else min(2 * larger, 1 << PATIENCE)  # what has worked stays
            discard(again)
    return reduce(DataFrame.unionByName, tables).withColumn("gap", F.lit(total - bound).cast("long"))


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """Sequences, and the fewest that pieces of these lengths can have."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in packed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, partition_bins, partition_bound, gap`` of every piece
    of every document."""
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity).drop("fill")
