"""MinHash near-dedup by an inverted join of signature coordinates, links confirmed on full sets.

1. *Signatures.*  A document's set of five-word shingles has ``COORDINATES`` minima, of a hash each.  Documents of equal
   sets are one node, with a number of its own; a digest of 128 bits tells sets apart.
2. *Threshold.*  Coordinates of two sets agree independently, each with the probability of their Jaccard similarity, so
   that a pair of similarity ``PERCENT`` agrees in fewer than ``MATCHES`` of them with a probability below ``MISS``; what
   agrees in ``MATCHES`` or more is a candidate.
3. *Posting.*  (coordinate, value) pairs are put in one order, rare ones first by a sketch of how often each occurs.  Two
   nodes that agree in ``MATCHES`` coordinates share one of the first ``COORDINATES - MATCHES + 1`` pairs of either, so each
   node is posted under those alone.  A pair's smallest node leads it, and its nodes are members of the leader's group: a
   group of g nodes has g rows.  Groups are cut into tiles of bounded size (as in ``jaccard_join``).
4. *Merging.*  In a tile the members are posted under all their coordinates.  A member's shortest lists, one more than may
   disagree, are merged and counted: who is in none of them can't match often enough.  The longer lists are skipped
   through: only members that the count so far leaves a chance are looked up in them, and fewer with every list.
5. *Confirmation.*  What is retained is intersected exactly on the full sets, in the tile.  Members that are connected
   already are not compared, so that a group of copies costs about one comparison a member.
6. *Components* of the links, distributed.

Defined cases: texts without words (null, empty) have an empty set and are linked with nothing; fewer words than five
are one shingle; repeated rows have equal sets and are one node; rows of one id with different texts are linked each by
its text; null ids are left alone as components of their own, and are kept; an empty table gives an empty result; other
columns are ignored, whatever their names (``deduplicated`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.bits import bit_filter, chunks_for, with_held, without
from trailgraph.llm.common import discard, join_counted, map_arrow, map_batches, written
from trailgraph.llm.components import components
from trailgraph.llm.jaccard_join import HOT_DOCUMENTS, SKETCH_BITS, SKETCH_CHUNKS, TILE_SHINGLES, Comparison, _overlap, led_groups, links_of_groups, shingle_sets, sketch_of
from trailgraph.llm.words import chunk_groups, mix, ragged

COORDINATES = 64
#: 100 * intersection >= PERCENT * union links two sets.
PERCENT = 85
#: The probability that a pair which is linked agrees in too few coordinates, at most.
MISS = 1e-9
#: Long lists that are skipped through together.
SKIP = 8
#: Shingles that are hashed by all coordinates at once.
HASHED = 4096

_U = np.uint64
_ODD = np.random.default_rng(20240607).integers(0, 1 << 63, (2, COORDINATES), dtype=np.uint64) * _U(2) + _U(1)


def least_matches(coordinates: int, share: float, miss: float) -> int:
    """The largest count that as many coordinates, each agreeing with probability ``share``, fall short of with a probability
    of ``miss`` at most."""
    short = 0.0
    for k in range(coordinates + 1):
        short += math.comb(coordinates, k) * share**k * (1 - share) ** (coordinates - k)
        if short > miss:
            return k
    return coordinates


MATCHES = least_matches(COORDINATES, PERCENT / 100, MISS)
PREFIX = COORDINATES - MATCHES + 1


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), HASHED):
        np.minimum(out, ((shingles[k : k + HASHED] ^ _ODD[0][:, None]) * _ODD[1][:, None]).min(axis=1), out=out)
    return (out >> _U(32)).astype(np.uint32)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    at = np.arange(len(shingles), dtype=np.uint64)
    return tuple(int(mix(mix(shingles + at * w).sum(keepdims=True, dtype=np.uint64) + _U(len(shingles)))[0].view(np.int64)) for w in _ODD[0, :2])


def needed(total: int) -> int:
    """The least overlap that links two sets of ``total`` elements together."""
    return -(-PERCENT * total // (100 + PERCENT))


def tokens(signatures: np.ndarray) -> np.ndarray:
    """Each (coordinate, value) of a matrix of signatures as one number; different pairs have different numbers."""
    return mix(signatures.astype(np.uint64) | np.arange(COORDINATES, dtype=np.uint64) << _U(32))


# -- 1. and 3. -------------------------------------------------------------------------------------------------------


def _signed(b: pa.RecordBatch) -> pa.RecordBatch:
    sets = [s for group in chunk_groups(b.column(1).to_pylist()) for s in shingle_sets(group)]
    high, low = zip(*map(digest, sets))
    columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], names=["doc_id", "text_hash", "n", "high", "low", "signature"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        yield tokens(_matrix(b.column(0))).reshape(-1)


def _prefixes(shipped):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = tokens(_matrix(b.column(1)))
        often = shipped.value[(own >> _U(64 - SKETCH_BITS)).astype(np.int64)]
        # A node has one pair of each coordinate, so that ties are in the coordinates' order for all nodes alike.
        first = np.argsort(often, axis=1, kind="stable")[:, :PREFIX]
        own, hot = np.take_along_axis(own, first, axis=1), np.take_along_axis(often, first, axis=1) >= HOT_DOCUMENTS
        lists = pa.list_(pa.int64())
        columns = [pa.array([row[m].view(np.int64) for row, m in zip(own, kept)], lists) for kept in (~hot, hot)]
        return pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "prefix", "hot_prefix"])

    return run


# -- 4. and 5. -------------------------------------------------------------------------------------------------------


class Postings:
    """The members of a tile under all their coordinates: for each, members in order of its value."""

    def __init__(self, signatures: np.ndarray):
        values = np.ascontiguousarray(signatures.T)
        n = values.shape[1]
        self.values, self.order = values, np.argsort(values, axis=1, kind="stable")
        in_order = np.take_along_axis(values, self.order, axis=1)
        place = np.broadcast_to(np.arange(n), values.shape)
        new = np.ones(values.shape, dtype=bool)
        new[:, 1:] = in_order[:, 1:] != in_order[:, :-1]
        begins = np.maximum.accumulate(np.where(new, place, 0), axis=1)
        following = np.full(values.shape, n)
        following[:, :-1] = np.where(new, place, n)[:, 1:]
        ends = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
        self.begins, self.ends = np.empty_like(begins), np.empty_like(ends)
        np.put_along_axis(self.begins, self.order, begins, axis=1)
        np.put_along_axis(self.ends, self.order, ends, axis=1)

    def matching(self, i: int, wanted: np.ndarray) -> np.ndarray:
        """The ``wanted`` members (a mask) that agree with member i in ``MATCHES`` coordinates or more."""
        begins, lengths = self.begins[:, i], self.ends[:, i] - self.begins[:, i]
        by_length = np.argsort(lengths, kind="stable")
        short, long = by_length[:PREFIX], by_length[PREFIX:]
        merged = self.order[np.repeat(short, lengths[short]), ragged(begins[short], lengths[short])]
        counts = np.bincount(merged, minlength=len(wanted))
        found = np.flatnonzero((counts > 0) & wanted)
        counts = counts[found]
        for k in range(0, len(long), SKIP):
            chance = counts + (len(long) - k) >= MATCHES
            found, counts = found[chance], counts[chance]
            if not len(found):
                break
            lists = long[k : k + SKIP]
            counts = counts + (self.values[lists[:, None], found] == self.values[lists, i][:, None]).sum(axis=0)
        return found[counts >= MATCHES]


def with_partner(sizes: np.ndarray, signatures: list[bytes]) -> np.ndarray:
    """Which members have another in their size band that agrees with them often enough; sizes ascend."""
    postings = Postings(np.frombuffer(b"".join(signatures), dtype=np.uint32).reshape(-1, COORDINATES))
    lows, highs = np.searchsorted(sizes, -(-PERCENT * sizes // 100)), np.searchsorted(sizes, 100 * sizes // PERCENT, side="right")
    found = np.zeros(len(sizes), dtype=bool)
    for i in range(len(sizes)):
        if not found[i] and highs[i] - lows[i] > 1:
            wanted = np.zeros(len(sizes), dtype=bool)
            wanted[lows[i] : highs[i]] = True
            wanted[i] = False
            partners = postings.matching(i, wanted)
            found[partners] = True
            found[i] = len(partners) > 0
    return found


def tile_links(ids: list[int], blobs: list[bytes], leader: int | None, apart: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that give the components of a tile, and each member's label.  A blob is a signature and then the set.

    ``apart``: 1 or 2 for each member; pairs within the same side are not compared (they have met elsewhere).
    """
    head = 4 * COORDINATES
    sets = [np.frombuffer(blob, dtype=np.uint64, offset=head) for blob in blobs]
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    members, sizes = [sets[i] for i in order], np.array([len(sets[i]) for i in order])
    postings = Postings(np.frombuffer(b"".join(blobs[i][:head] for i in order), dtype=np.uint32).reshape(-1, COORDINATES))
    sides = apart[order] if apart is not None else None
    lows, highs = np.searchsorted(sizes, -(-PERCENT * sizes // 100)), np.searchsorted(sizes, 100 * sizes // PERCENT, side="right")
    label = np.arange(len(order))
    links: list[tuple[int, int]] = []

    def compare(i: int, low: int) -> None:
        wanted = label != label[i]
        wanted[:low], wanted[highs[i] :] = False, False
        if sides is not None:
            wanted &= sides != sides[i]
        if not wanted.any():
            return
        for j in postings.matching(i, wanted).tolist():
            if label[j] != label[i] and _overlap(members[i], members[j]) >= needed(int(sizes[i] + sizes[j])):
                links.append((ids[order[i]], ids[order[j]]))
                label[label == label[j]] = label[i]

    if leader is not None and leader in ids:
        at = order.index(ids.index(leader))
        compare(at, int(lows[at]))
    for i in range(len(order)):
        if (label == label[0]).all():
            break
        compare(i, i + 1)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = label
    return links, out


def _set_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    sets = [s for group in chunk_groups(b.column(1).to_pylist()) for s in shingle_sets(group)]
    high, low = zip(*map(digest, sets))
    columns = [b.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["first_id", "of_high", "of_low", "shingles"])


def _sets_of(texts: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``set_id, shingles`` (the signature first) of the nodes in ``members``, each from the document with its smallest id."""
    involved = written(members.select(F.col("doc_id").alias("node")).distinct().join(nodes.select("node", "high", "low", "first", "signature"), "node"))
    chunks = chunks_for(involved.count())
    marked = with_held(texts.select("doc_id", "text"), [F.col("doc_id")], bit_filter(involved, [F.col("first")], chunks), chunks, "involved")
    sets = map_batches(marked.filter("involved").select("doc_id", "text"), _set_rows, "first_id long, of_high long, of_low long, shingles binary")
    # The filter lets others pass too, and rows may repeat both id and set.
    own = sets.join(involved, (F.col("of_high") == F.col("high")) & (F.col("of_low") == F.col("low")) & (F.col("first_id") == F.col("first")))
    return own.groupBy(F.col("node").alias("set_id")).agg(F.first(F.concat("signature", "shingles")).alias("shingles"))


BY_COORDINATES = Comparison(_sets_of, with_partner, tile_links)


def _components_of_rows(docs: DataFrame, id_col: str, text_col: str, tile_shingles: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(map_batches(texts.withColumn("text_hash", F.xxhash64("text")), _signed, "doc_id long, text_hash long, n long, high long, low long, signature binary"))
    linked = signed.filter("n > 0 and doc_id is not null")
    of_sets = linked.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    nodes = written(of_sets.withColumn("node", F.monotonically_increasing_id()))
    counts = docs.sparkSession.sparkContext.broadcast(sketch_of(nodes.select("signature"), _counted))  # 2 MB
    led = led_groups(written(map_batches(nodes.select("node", "signature"), _prefixes(counts), "doc_id long, prefix array<long>, hot_prefix array<long>")))
    both = led.unionByName(led.select("leader", F.col("leader").alias("doc_id")).distinct())
    members = written(both.join(nodes.select(F.col("node").alias("doc_id"), "n"), "doc_id").select("leader", "doc_id", "n"))
    signatures = nodes.select(F.col("node").alias("map_id"), F.col("signature").alias("bitmap"))
    found = components(links_of_groups(texts, members, nodes, signatures, tile_shingles, BY_COORDINATES)).select(F.col("node").alias("linked_node"), F.col("component_id").alias("of_node"))
    least = written(nodes.join(found, F.col("node") == F.col("linked_node"), "left").select("high", "low", "first", "copies", F.coalesce("of_node", "node").alias("least")))
    smallest = written(least.groupBy("least").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    of_keys = written(join_counted(least, smallest, "least", "sets").select("high", "low", "component_id", "copies"))
    discard(nodes, members, led, least, smallest, found)
    shown = ["doc_id", "text_hash", F.col("n").alias("n_shingles")]
    alone = signed.filter("n = 0 or doc_id is null").select(*shown, F.col("doc_id").alias("component_id"))
    own = join_counted(linked.select("doc_id", "text_hash", "n", "high", "low"), of_keys, ["high", "low"], "copies").select(*shown, "component_id")
    return own.unionByName(alone)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; the row of a component's smallest id is kept."""
    rows = _components_of_rows(docs, id_col, text_col, tile_shingles)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows = _components_of_rows(docs, id_col, text_col, TILE_SHINGLES).filter("doc_id != component_id")
    return without(docs, [docs[id_col].cast("long"), F.xxhash64(docs[text_col])], written(rows.select("doc_id", "text_hash").distinct()))
