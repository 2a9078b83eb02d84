"""Exact n-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

1. *Order.*  A sketch counts how often each shingle bucket occurs, over all documents; shingles are ordered by that
   count, rare ones first (any order common to all documents gives exact results; this one keeps candidates few).
2. *Candidates.*  Two sets of Jaccard 3/4 share one of the first |A| - ceil(3/4 |A|) + 1 shingles of either, so each
   document posts those.  A shingle's smallest document leads it; its documents are members of the leader's group.  Two
   linked documents are members of one group at least, and a group of g documents has g rows, not g * g pairs.
3. *Bounds.*  Each document has a bitmap of its shingles' parity, of about as many bits as shingles.  In a group that is
   one tile, members whose bitmap lets no other member of the size band be near enough are put aside; only the
   others' shingles are sent.
4. *Tiles.*  A group of bounded shingles and members is one tile.  A larger one is dealt to several tiles, its smallest
   member in each; members that their tile does not connect to that one then meet every other tile, in blocks, so that no
   pair is left out.  Members are dealt where they are: a group that most members are in is not one task's.
5. *In a tile*, sets are in order of size.  A set meets the sets in its size band only (a size ratio of 3/4); the
   parity bitmaps' differing bits bound the overlap from above; what is left is intersected exactly.  Sets that are
   connected already are not compared: the result is the components.
6. *Components* of the links, distributed.

Documents with equal sets are one node throughout, which goes by a 64-bit digest of the set: an id may repeat with different
texts.  Shingles are 64-bit hashes of five words.

Defined cases: texts without words (null, empty) have no shingle and are linked with nothing; fewer words than five are
one shingle; repeated rows have equal sets and are one node; an empty table gives an empty result; null ids are left
alone as components of their own; rows of one id with different texts are linked
each by its text; other columns are ignored, whatever their names (``drop_near_copies`` keeps them).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.bits import bit_filter, chunks_for, with_held, without
from trailgraph.llm.common import discard, join_counted, map_arrow, map_batches, shuffle_partitions, written
from trailgraph.llm.components import components
from trailgraph.llm.words import Chunks, chunk_groups, mix

WORDS = 5
#: 100 * intersection >= PERCENT * union links two sets.
PERCENT = 75
SKETCH_BITS = 18
SKETCH_CHUNKS = 16
#: A shingle that the sketch bounds by so many documents is led by a split, pre-aggregated way.
HOT_DOCUMENTS = 1 << 16
#: Shingles and members of one tile, on average.
TILE_SHINGLES, TILE_MEMBERS = 1 << 20, 512
POSTINGS_A_PARTITION = 2_000_000
MAX_BITMAP_BITS = 1 << 16

_U = np.uint64
_WEIGHTS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_sets(group: Chunks) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the group."""
    h, first = group.hashes, group.first
    n = len(h) - WORDS + 1
    if n > 0:
        total = np.zeros(n, dtype=np.uint64)
        for k, w in enumerate(_WEIGHTS):
            total += h[k : k + n] * _U(w)
        total = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(total[a : b - WORDS + 1]))
        elif b > a:
            short = (h[a:b] * np.array(_WEIGHTS[: b - a], dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(mix(short + _U(b - a))))
        else:
            out.append(h[:0])
    return out


def needed(total: int | np.ndarray) -> int | np.ndarray:
    """The least overlap that links two sets of ``total`` elements together."""
    return -(-PERCENT * total // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


# -- 1. order ---------------------------------------------------------------------------------------------------------


def _shingle_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for group in chunk_groups(b.column(0).to_pylist()):
            if sets := [s for s in shingle_sets(group) if len(s)]:
                yield np.concatenate(sets)


def _counted(hashes: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for h in hashes(batches):
            counts += np.bincount((h >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        parts = counts.reshape(SKETCH_CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["chunk", "counts"])

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
            totals[chunk] = totals[chunk] + counts if chunk in totals else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["chunk", "counts"])


def sketch_of(rows: DataFrame, hashes: Callable = _shingle_hashes) -> np.ndarray:
    """How many rows have a hash of each bucket: an upper bound for each hash; 2 MB whatever the input.

    hashes: arrays of 64-bit hashes from batches of the rows, each hash once a row."""
    each = map_arrow(rows, _counted(hashes), "chunk int, counts binary").repartition(SKETCH_CHUNKS, "chunk")
    out = np.zeros((SKETCH_CHUNKS, (1 << SKETCH_BITS) // SKETCH_CHUNKS), dtype=np.int64)
    for row in each.mapInArrow(_sum_chunks, "chunk int, counts binary").collect():
        out[row["chunk"]] = np.frombuffer(bytes(row["counts"]), dtype=np.int64)
    return out.reshape(-1)


# -- 2. candidates ----------------------------------------------------------------------------------------------------


def _prefixes(shipped):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: np.ndarray = shipped.value
        rows: list[list] = [[], [], [], [], []]
        for group in chunk_groups(b.column(1).to_pylist()):
            for s in shingle_sets(group):
                often = counts[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                # s is ascending, so a stable sort by count orders ties by hash
                first = np.argsort(often, kind="stable")[: prefix_length(len(s))]
                hot = often[first] >= HOT_DOCUMENTS
                rows[0].append(len(s))
                rows[1].append(_set_key(s))
                rows[2].append(s[first[~hot]].view(np.int64))
                rows[3].append(s[first[hot]].view(np.int64))
                rows[4].append(_bitmap(s, bitmap_bits(len(s))).tobytes())
        lists = pa.list_(pa.int64())
        types = [pa.int64(), pa.int64(), lists, lists, pa.binary()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(r, t) for r, t in zip(rows, types))], names=["doc_id", "text_hash", "n", "key", "prefix", "hot_prefix", "bitmap"])

    return run


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings by (token, doc_id): (leader, doc_id) of every shingle that two documents or more have."""
    token, leader = None, None
    for b in batches:
        tokens, docs = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.concatenate(([tokens[0] != token], tokens[1:] != tokens[:-1]))
        starts = np.flatnonzero(new)
        leaders = np.full(len(docs), leader if leader is not None else docs[0])
        if len(starts):
            leaders[starts[0] :] = np.repeat(docs[starts], np.diff(np.append(starts, len(docs))))
        token, leader = tokens[-1], leaders[-1]
        other = leaders != docs
        if other.any():
            pairs = np.unique(np.stack((leaders[other], docs[other])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["leader", "doc_id"])


def led_groups(table: DataFrame) -> DataFrame:
    """``leader, doc_id``: the members of each group but the leaders."""
    spark = table.sparkSession
    n = table.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(spark), -(-n // POSTINGS_A_PARTITION))
    postings = table.select(F.explode("prefix").alias("token"), "doc_id")
    led = postings.repartition(parts, "token").sortWithinPartitions("token", "doc_id").mapInArrow(_lead, "leader long, doc_id long")
    hot = table.select(F.explode("hot_prefix").alias("token"), "doc_id")
    heads = written(hot.groupBy("token").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("documents")).filter("documents > 1"))
    led = led.unionByName(join_counted(hot, heads, "token", "documents").filter("doc_id != leader").select("leader", "doc_id"))
    out = written(led.distinct())
    discard(heads)
    return out


# -- 3. to 5. tiles --------------------------------------------------------------------------------------------------


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of n shingles: a power of two near n."""
    return min(MAX_BITMAP_BITS, max(512, 1 << (n - 1).bit_length())) if n else 512


def _bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap as 64-bit words: bit i tells whether an odd number of elements hash to i.  Every differing bit needs
    an element of one set alone."""
    parity = (np.bincount((s >> _U(16)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """The same set's bitmap of fewer bits: the parity of the parts."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def with_partner(sizes: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Which members have another in their size band whose overlap the bitmaps don't exclude; sizes ascend."""
    found = np.zeros(len(sizes), dtype=bool)
    highs = np.searchsorted(sizes, 100 * sizes // PERCENT, side="right")
    words = min(map(len, maps)) if len(maps) else 0
    level, block = 0, None
    for i in range(len(sizes)):
        high = int(highs[i])
        if high <= i + 1 or found[i:high].all():
            continue
        if block is None or len(maps[i]) > words:  # sizes ascend, so bitmaps do: fold what lies above to this one's bits
            words, level = len(maps[i]), i
            block = np.stack([_folded(m, words) for m in maps[i:]])
        both = sizes[i + 1 : high] + sizes[i]
        unlike = np.bitwise_count(block[i + 1 - level : high - level] ^ block[i - level]).sum(axis=1, dtype=np.int64)
        near = (both - unlike) // 2 >= needed(both)
        if near.any():
            found[i] = True
            found[i + 1 : high] |= near
    return found


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def tile_links(ids: list[int], sets: list[np.ndarray], leader: int | None, apart: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that give the components of a tile, and each member's label.

    ``apart``: 1 or 2 for each member; pairs within the same side are not compared (they have met elsewhere).
    """
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    members = [sets[i] for i in order]
    sides = apart[order] if apart is not None else None
    maps = [_bitmap(s, bitmap_bits(2 * len(s))) for s in members]
    label = np.arange(len(order))
    links: list[tuple[int, int]] = []
    folds: list = [0, None]  # bitmaps from a member on, folded to that member's width: sizes ascend, so widths do

    def folded_from(i: int) -> tuple[int, np.ndarray]:
        if folds[1] is None or len(maps[i]) != folds[1].shape[1]:
            folds[:] = i, np.stack([_folded(m, len(maps[i])) for m in maps[i:]])
        return folds[0], folds[1]

    def compare(i: int, low: int, unlike: np.ndarray) -> None:
        """Member i with the members from ``low`` on, of whose bitmaps ``unlike`` bits differ from its own."""
        high = low + len(unlike)
        both = sizes[low:high] + sizes[i]
        other = np.arange(low, high)
        keep = ((both - unlike) // 2 >= needed(both)) & (label[low:high] != label[i]) & (other != i)
        if sides is not None:
            keep &= sides[low:high] != sides[i]
        for j in other[keep].tolist():
            if label[j] != label[i] and _overlap(members[i], members[j]) >= needed(int(sizes[i] + sizes[j])):
                links.append((ids[order[i]], ids[order[j]]))
                label[label == label[j]] = label[i]

    highs = np.searchsorted(sizes, 100 * sizes // PERCENT, side="right")
    if leader is not None and leader in ids:
        at = order.index(ids.index(leader))
        low = int(np.searchsorted(sizes, -(-PERCENT * int(sizes[at]) // 100)))
        pairs = ((maps[at], m) for m in maps[low : int(highs[at])])
        unlike = [int(np.bitwise_count(_folded(x, min(len(x), len(y))) ^ _folded(y, min(len(x), len(y)))).sum()) for x, y in pairs]
        compare(at, low, np.array(unlike, dtype=np.int64))
    for i in range(len(order)):
        if (label == label[0]).all():
            break
        if highs[i] > i + 1:
            level, block = folded_from(i)
            compare(i, i + 1, np.bitwise_count(block[i + 1 - level : highs[i] - level] ^ block[i - level]).sum(axis=1, dtype=np.int64))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = label
    return links, out


def _tile_stream(batches: Iterator[pa.RecordBatch], finish, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Calls ``finish`` with the rows of each tile, and gives its rows on as longs; rows come by (leader, tile)."""
    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    key, rows = None, []
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:2] != key and rows:
                out += finish(key, rows)
                rows = []
            key = row[:2]
            rows.append(row[2:])
        if out:
            yield as_batch(out)
    if rows and (out := finish(key, rows)):
        yield as_batch(out)


def _bounded(partners: Callable):
    """The members of each group that may have a partner in it."""

    def finish(key: tuple, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: r[1])
        kept = partners(np.array([r[1] for r in rows]), [r[2] for r in rows])
        return [(*key, doc, n) for (doc, n, _), k in zip(rows, kept.tolist()) if k]

    return lambda batches: _tile_stream(batches, finish, ["leader", "tile", "doc_id", "n"])


_LINKS = ["leader", "tile", "a", "b"]


def _first_tiles(link: Callable):
    """Links (a, b) of each tile; and, where the group has several tiles, (a, null) for members that
    the group's smallest, which is in each of them, isn't connected to."""

    def finish(key: tuple, rows: list[tuple]) -> list[tuple]:
        leader, tile = key
        ids = [r[0] for r in rows]
        hub = min(ids)
        links, label = link(ids, [r[2] for r in rows], hub, None)
        out = [(leader, tile, a, b) for a, b in links]
        if rows[0][1] > 1:
            led = label[ids.index(hub)]
            out += [(leader, tile, i, None) for i, x in zip(ids, label.tolist()) if x != led]
        return out

    return lambda batches: _tile_stream(batches, finish, _LINKS)


def _second_tiles(link: Callable):
    """Links between the members of a tile (side 1) and unconnected members of other tiles (side 2)."""

    def finish(key: tuple, rows: list[tuple]) -> list[tuple]:
        links, _ = link([r[0] for r in rows], [r[2] for r in rows], None, np.array([r[1] for r in rows]))
        return [(*key, a, b) for a, b in links]

    return lambda batches: _tile_stream(batches, finish, _LINKS)


def _set_key(s: np.ndarray) -> int:
    """64-bit digest of a set: the key that it goes by, whatever the ids of its documents."""
    return int(np.add.reduce(mix(s + np.arange(len(s), dtype=np.uint64) * _U(_WEIGHTS[1]))).view(np.int64)) if len(s) else 0


def _set_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    sets = [s for group in chunk_groups(b.column(1).to_pylist()) for s in shingle_sets(group)]
    columns = [b.column(0), pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["first_id", "set_id", "shingles"])


def _sets_of(texts: DataFrame, members: DataFrame, firsts: DataFrame) -> DataFrame:
    """``set_id, shingles`` of the sets in ``members``, each from the document with its smallest id."""
    nodes = written(members.select(F.col("doc_id").alias("key")).distinct().join(firsts, "key").select("key", "first"))
    chunks = chunks_for(nodes.count())
    involved = bit_filter(nodes, [F.col("first")], chunks)
    marked = with_held(texts.select("doc_id", "text"), [F.col("doc_id")], involved, chunks, "involved")
    sets = map_batches(marked.filter("involved").select("doc_id", "text"), _set_rows, "first_id long, set_id long, shingles binary")
    # The filter lets others pass too, and rows may repeat both id and set.
    own = sets.join(nodes, (F.col("set_id") == F.col("key")) & (F.col("first_id") == F.col("first")))
    return own.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def _in_tiles(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "leader", "tile").sortWithinPartitions("leader", "tile").select("leader", "tile", "doc_id", *columns)


def _sizes(members: DataFrame) -> DataFrame:
    """``leader, shingles, members, hub`` of each group."""
    return written(members.groupBy("leader").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("hub")))


@dataclass(frozen=True)
class Comparison:
    """How the members of tiles are compared.  sets_of: the sets of (texts, members, firsts), as ``set_id, shingles``;
    partners: which members of ascending sizes may have a partner, by their signatures; link: as ``tile_links``, of ids,
    sets as ``sets_of`` gives them, the leader and the sides."""

    sets_of: Callable
    partners: Callable
    link: Callable


def _words(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint64)


BY_BITMAPS = Comparison(
    _sets_of, lambda sizes, maps: with_partner(sizes, list(map(_words, maps))), lambda ids, sets, leader, apart: tile_links(ids, list(map(_words, sets)), leader, apart)
)


def links_of_groups(texts: DataFrame, members: DataFrame, firsts: DataFrame, signatures: DataFrame, tile_shingles: int, how: Comparison = BY_BITMAPS) -> DataFrame:
    """``a, b``: links that give the components.  members: leader, doc_id, n (leaders among them); firsts: what
    ``how.sets_of`` finds sets by; signatures: map_id, bitmap.

    Leaders and members are keys of sets."""
    tiles = F.ceil(F.greatest(F.col("shingles") / F.lit(tile_shingles), F.col("members") / F.lit(TILE_MEMBERS)))
    sized = written(join_counted(members, _sizes(members), "leader", "members").withColumn("tiles", tiles).select("leader", "doc_id", "n", "tiles"))
    small = sized.filter("tiles = 1").withColumn("tile", F.lit(0).cast("long")).join(signatures, F.col("doc_id") == F.col("map_id"))
    kept = map_arrow(_in_tiles(small, "n", "bitmap"), _bounded(how.partners), "leader long, tile long, doc_id long, n long").drop("tile")
    kept = written(kept.unionByName(sized.filter("tiles > 1").select("leader", "doc_id", "n")))
    groups = _sizes(kept)
    own = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.col("tiles"))
    every = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    tile = F.explode(F.when(F.col("doc_id") == F.col("hub"), every).otherwise(F.array(own)))
    placed = written(join_counted(kept, groups, "leader", "members").withColumn("tiles", tiles).withColumn("tile", tile))
    sets = how.sets_of(texts, placed, firsts)
    joined = placed.select("leader", "tile", "tiles", "doc_id").join(sets, F.col("doc_id") == F.col("set_id"))
    schema = "leader long, tile long, a long, b long"
    found = written(map_arrow(_in_tiles(joined, "tiles", "shingles"), _first_tiles(how.link), schema))
    discard(sized, kept)
    links = found.filter("b is not null").select("a", "b")
    loose = found.filter("b is null").select("leader", F.col("tile").alias("home"), F.col("a").alias("doc_id"))
    if loose.isEmpty():
        return links
    # Members that no tile connects to a leader of several tiles: each meets the members of all other tiles of its group.
    loose = written(loose.join(placed.select("leader", "doc_id", "n", "tiles", F.col("tile").alias("home")), ["leader", "doc_id", "home"]))
    blocks = loose.groupBy("leader").agg(F.ceil(F.greatest(F.sum("n") / F.lit(tile_shingles), F.count(F.lit(1)) / F.lit(TILE_MEMBERS))).alias("blocks"))
    blocks = written(blocks.join(groups.select("leader", "members"), "leader"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(32)), F.col("blocks"))
    number = F.col("blocks") * F.col("at") + F.col("block")
    queries = join_counted(loose, blocks, "leader", "members").withColumn("block", block).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).filter("at != home")
    dealt = placed.filter("tiles > 1 and doc_id != hub").select("leader", "doc_id", F.col("tile").alias("at"))
    against = join_counted(dealt, blocks, "leader", "members").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = queries.select("leader", number.alias("tile"), "doc_id", F.lit(2).alias("side")).unionByName(against.select("leader", number.alias("tile"), "doc_id", F.lit(1).alias("side")))
    rows = written(rows)
    again = rows.join(how.sets_of(texts, rows, firsts), F.col("doc_id") == F.col("set_id"))
    return links.unionByName(written(map_arrow(_in_tiles(again, "side", "shingles"), _second_tiles(how.link), schema)).select("a", "b"))


def _components_of_rows(docs: DataFrame, id_col: str, text_col: str, tile_shingles: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(sketch_of(texts.select("text")))  # 2 MB
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    table = written(map_batches(hashed, _prefixes(counts), "doc_id long, text_hash long, n long, key long, prefix array<long>, hot_prefix array<long>, bitmap binary"))
    linked = table.filter("n > 0 and doc_id is not null")
    firsts = written(linked.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    led = led_groups(linked.select(F.col("key").alias("doc_id"), "prefix", "hot_prefix"))
    both = led.unionByName(led.select("leader", F.col("leader").alias("doc_id")).distinct())
    members = written(both.join(firsts.select(F.col("key").alias("doc_id"), "n"), "doc_id").select("leader", "doc_id", "n"))
    bitmaps = linked.select(F.col("key").alias("map_id"), "bitmap").dropDuplicates(["map_id"])
    found = components(links_of_groups(texts, members, firsts, bitmaps, tile_shingles))
    of_sets = written(firsts.join(found, F.col("key") == F.col("node"), "left").select("key", "first", "copies", F.coalesce("component_id", "key").alias("least_key")))
    smallest = written(of_sets.groupBy("least_key").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    of_sets = written(join_counted(of_sets, smallest, "least_key", "sets").select("key", "component_id", "copies"))
    discard(firsts, members, led, smallest, found)
    shown = ["doc_id", "text_hash", F.col("n").alias("n_shingles")]
    alone = table.filter("n = 0 or doc_id is null").select(*shown, F.col("doc_id").alias("component_id"))
    own = join_counted(linked.select("doc_id", "text_hash", "n", "key"), of_sets, "key", "copies").select(*shown, "component_id")
    return own.unionByName(alone)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    return _components_of_rows(docs, id_col, text_col, tile_shingles).drop("text_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are their component's smallest id, with all their columns."""
    rows = _components_of_rows(docs, id_col, text_col, TILE_SHINGLES).filter("doc_id != component_id")
    return without(docs, [docs[id_col].cast("long"), F.xxhash64(docs[text_col])], written(rows.select("doc_id", "text_hash").distinct()))
