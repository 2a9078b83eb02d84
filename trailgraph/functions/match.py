"""Closest names by Ratcliff-Obershelp similarity, as a join of two tables.

A pair's matching characters are at most its common ones, and these at most as many as the shorter text has.  So a pair
of lengths n <= m that reaches the threshold t has n / m >= t / (2 - t): texts are put in bands by the number of digits
of their length in base ceil((2 - t) / t), and only the same and the next bands can meet.

Texts of the same characters (anagrams) have the same bound against any other text, so that bounds are computed once for
each two sets of characters: in a band these are packed in blocks, and each pair of blocks meets once, as an equi-join on
the names' blocks.  An entity is first compared with the names of the set with the highest bound.  What it finds there is
its floor: then it meets the sets alone whose bound isn't below the floor, in whatever block they are.  Matching blocks
are a common subsequence, so before a ratio is computed the longest one bounds it; ratios are computed from the highest
bound down until no bound can beat what was found.

At a threshold of a half a prefix of rare characters would have two thirds of a name in it; bands and counts cut more.
Where floors cut nothing (texts that are all about as far from each other) the job is all pairs by nature: it is dealt
by blocks, and no task has more than a block of each side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.storage import stored

#: Names, and entities (or their sets of characters), of one block, on average.
NAME_BLOCK, ENTITY_BLOCK = 4096, 1000
#: Buckets that characters are counted in.
BUCKETS = 64
SCHEMA = "entity string, name string, score double"


def _counts(*sides: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """How often each bucket's characters occur in each text, and the texts' lengths, for lists of texts that are compared.  Up to
    ``BUCKETS`` different characters have a bucket each; more share them."""
    known = {c: k % BUCKETS for k, c in enumerate(sorted(set().union(*(set(t) for texts in sides for t in texts))))}
    out = []
    for texts in sides:
        counts = np.zeros((len(texts), max(1, min(len(known), BUCKETS))), dtype=np.int32)
        for row, text in zip(counts, texts):
            row += np.bincount([known[c] for c in text], minlength=len(row)).astype(np.int32)
        out.append((counts, np.array([len(t) for t in texts])))
    return out


def common(text: str, others: list[str]) -> list[int]:
    """Lengths of the longest common subsequences, a whole number's bits at a time."""
    full, at = (1 << len(text)) - 1, {}
    for k, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << k
    out = []
    for other in others:
        open_ = full
        for c in other:
            if c in at:
                hit = open_ & at[c]
                open_ = (open_ + hit | open_ - hit) & full
        out.append(len(text) - open_.bit_count())
    return out


def best_of(entities: list[str], names: list[str], threshold: float, floors: list[float] | None = None) -> list[tuple[str, str, float]]:
    """Each entity's most similar name of the threshold (or its own floor) or more, and more than none, of equals the smallest."""
    lengths = np.array([len(n) for n in names])
    out = []
    for e, text in enumerate(entities):
        floor = threshold if floors is None else max(threshold, floors[e])
        total = lengths + len(text)
        bound = np.where(total > 0, 2.0 * np.array(common(text, names), dtype=np.int64) / np.maximum(total, 1), 1.0)
        best, found = 0.0, None
        for at in np.argsort(-bound, kind="stable").tolist():
            if bound[at] < floor or bound[at] < best or bound[at] == 0:
                break
            ratio = SequenceMatcher(None, text, names[at]).ratio()
            if ratio >= floor and (ratio > best or ratio == best and found is not None and names[at] < found):
                best, found = ratio, names[at]
        if found is not None:
            out.append((text, found, best))
    return out


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=names)


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entities, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = best_of([e["entity"] for e in entities], names, threshold, [e["floor"] for e in entities])
                yield _batch(rows, ["entity", "name", "score"])

    return run


def _bounds(first: bool):
    """For each set of characters the sets that it can reach its floor with, or (``first``) the one with the highest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for wanted, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (counts, lengths), (own, sizes) = _counts(sets, [w["chars"] for w in wanted])
                for e, w in enumerate(wanted):
                    bound = 2.0 * np.minimum(counts, own[e]).sum(axis=1) / (lengths + sizes[e])
                    near = np.flatnonzero((bound >= w["floor"]) & (bound > 0))
                    if first and len(near):
                        near = near[[np.argmax(bound[near])]]
                    if len(near):
                        yield _batch([(w["chars"], sets[k], float(bound[k])) for k in near.tolist()], ["of", "chars", "bound"])

    return run


def band(text: Column, threshold: float) -> Column:
    """Number of the band that a text's length is in; texts whose bands are more than one apart are too unlike."""
    base = math.ceil((2 - threshold) / threshold - 1e-9) if threshold > 0 else 37
    return F.length(F.conv(F.length(text).cast("string"), 10, max(2, base))) if base <= 36 else F.lit(1)


def characters(text: Column) -> Column:
    """A text's characters in order: the same for anagrams alone."""
    return F.array_join(F.array_sort(F.split(text, "")), "")


def _blocks(rows: DataFrame, key: str, by: str, item: Column, size: int, sizes: DataFrame, out: str) -> DataFrame:
    """``key, block, out``: the items of each block of each key, dealt by a hash of ``by``.  sizes: of_key, n."""
    numbered = rows.join(sizes, F.col(key) == F.col("of_key"))
    block = F.pmod(F.xxhash64(by), F.ceil(F.col("n") / F.lit(size)))
    return numbered.groupBy(key, block.alias("block")).agg(F.collect_list(item).alias(out))


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("of_key")).agg(F.count(F.lit(1)).alias("n"))


def _meeting(left: DataFrame, right: DataFrame, key: str, size: int, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """Each block of ``left`` with each of the same key of ``right``, whose blocks have about ``size`` items.  Blocks are few and
    small, what is done with them isn't: as many tasks as a shuffle has share them."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    aimed = left.join(sizes, F.col(key) == F.col("of_key")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(size)) - 1))).drop("of_key", "n", "block")
    aimed, right = aimed.withColumnRenamed(key, "to").repartition(parts, "to", "at"), right.repartition(parts, key, "block")
    return aimed.join(right, (F.col("to") == F.col(key)) & (F.col("at") == F.col("block"))).select(*columns)


def _near(sets: DataFrame, name_sets: DataFrame, first: bool) -> DataFrame:
    """``of, chars, bound`` of sets of characters (``chars, band, floor``) and those of names (``chars, band``) that they reach."""
    name_sizes = _sizes(name_sets, "band")  # one row a band: at most 64
    name_blocks = _blocks(name_sets, "band", "chars", F.col("chars"), NAME_BLOCK, name_sizes, "name_sets")
    own = _blocks(sets, "band", "chars", F.struct("chars", "floor"), ENTITY_BLOCK, _sizes(sets, "band"), "sets")
    # A block meets all blocks of its own band and of those beside it.
    aimed = own.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    return _meeting(aimed, name_blocks, "band", NAME_BLOCK, name_sizes, ["sets", "name_sets"]).mapInArrow(_bounds(first), "of string, chars string, bound double")


def _compared(entities: DataFrame, near: DataFrame, names: DataFrame, name_sizes: DataFrame, threshold: float) -> DataFrame:
    """``entity, name, score``: the best of the names that each entity (``entity, own, floor``) is near to, a row a block at most."""
    pairs = entities.join(near, (F.col("own") == F.col("of")) & (F.col("bound") >= F.col("floor"))).select("entity", "floor", "chars")
    wanted = _blocks(pairs, "chars", "entity", F.struct("entity", "floor"), ENTITY_BLOCK, _sizes(pairs, "chars"), "entity_block")
    listed = _blocks(names, "chars", "name", F.col("name"), NAME_BLOCK, name_sizes, "name_block")
    tiles = _meeting(wanted, listed, "chars", NAME_BLOCK, name_sizes, ["entity_block", "name_block"])
    return stored(tiles.mapInArrow(_tiles(threshold), SCHEMA))  # which bounds the bytes of a batch


def closest(entities: DataFrame, names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``entity, name, score``: for each entity its most similar name, as spelled, of ``threshold`` or more; of equals the
    smallest.  Entities without one, and nulls, are left out."""
    wanted = entities.select("entity").filter("entity is not null").distinct()
    listed = stored(names.select("name").filter("name is not null").distinct().withColumn("chars", characters(F.col("name"))))
    same = stored(wanted.join(listed.select("name"), F.col("entity") == F.col("name"), "left").withColumn("own", characters(F.col("entity"))))
    exact = same.filter(F.col("name").isNotNull() & F.lit(threshold <= 1)).select("entity", "name", F.lit(1.0).alias("score"))
    rest = same.filter("name is null and entity != ''").select("entity", "own")
    spelled = listed.filter("name != ''")
    name_sizes = stored(_sizes(spelled, "chars"))
    name_sets = name_sizes.select(F.col("of_key").alias("chars"), band(F.col("of_key"), threshold).alias("band"))

    def sets(floors: DataFrame) -> DataFrame:
        return floors.groupBy(F.col("own").alias("chars")).agg(F.min("floor").alias("floor")).withColumn("band", band(F.col("chars"), threshold))

    floors = rest.withColumn("floor", F.lit(float(threshold)))
    top = _near(sets(floors), name_sets, True).groupBy("of").agg(F.max(F.struct("bound", "chars")).alias("top")).select("of", "top.chars", "top.bound")
    top = stored(top)
    found = _compared(floors, top, spelled, name_sizes, threshold)
    floors = stored(floors.join(found.groupBy(F.col("entity").alias("found")).agg(F.max("score").alias("score")), F.col("entity") == F.col("found"), "left").select("entity", "own", F.coalesce("score", "floor").alias("floor")))
    near = _near(sets(floors), name_sets, False).join(top.select("of", "chars"), ["of", "chars"], "left_anti")
    found = found.unionByName(_compared(floors, near, spelled, name_sizes, threshold))
    best = F.min(F.struct(-F.col("score"), F.col("name"))).alias("best")
    return exact.unionByName(found.groupBy("entity").agg(best).select("entity", F.col("best.name").alias("name"), (-F.col("best.col1")).alias("score")))
