"""Bit filters over hashed keys, made and asked by DataFrame functions alone.

A filter is a table of chunks of 4 KB: ``chunk, bitmap``.  All bits of a key are in one chunk, so that a key is looked up
by one join.  Filters are broadcast; their size is bounded by ``MOST_CHUNKS``, and one that is too small for its keys
answers "maybe" more often, never wrongly "no".
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one chunk, as bitmap_construct_agg has them.
CHUNK_BITS = 32768
BITS_A_KEY = 16
HASHES = 2
#: 64 MB.
MOST_CHUNKS = 1 << 14


def chunks_for(n: int, most: int = MOST_CHUNKS) -> int:
    """Chunks of a filter of n keys."""
    return max(1, min(most, -(-n * BITS_A_KEY // CHUNK_BITS)))


def _chunk(key: list[Column], chunks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *key), F.lit(chunks))


def _positions(key: list[Column]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), *key), F.lit(CHUNK_BITS)) for k in range(1, HASHES + 1)]


def bit_filter(rows: DataFrame, key: list[Column], chunks: int, least: int = 1) -> DataFrame:
    """``chunk, bitmap``: the bits that ``least`` of the rows' keys or more set.  Rows send (chunk, bit) alone."""
    bits = rows.select(_chunk(key, chunks).alias("chunk"), F.explode(F.array(*_positions(key))).alias("bit"))
    counted = bits.groupBy("chunk", "bit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counted.groupBy("chunk").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def with_held(rows: DataFrame, key: list[Column], held_bits: DataFrame, chunks: int, name: str) -> DataFrame:
    """Adds ``name``: whether the filter has all bits of the key.  Nothing is shuffled, and no bitmap stays in a row.

    The filter is broadcast: ``MOST_CHUNKS`` * 4 KB at most.
    """
    chunk, bitmap = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    side = held_bits.select(F.col("chunk").alias(chunk), F.col("bitmap").alias(bitmap))
    joined = rows.join(F.broadcast(side), _chunk(key, chunks) == F.col(chunk), "left")
    held = F.col(bitmap).isNotNull()
    for at in _positions(key):
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = held & (F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1)
    return joined.withColumn(name, F.coalesce(held, F.lit(False))).drop(chunk, bitmap)


def without(docs: DataFrame, key: list[Column], dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't a row of ``dropped``, a written table of distinct keys (nulls equal nulls).

    Rows that a filter of the dropped keys excludes pass straight through; only the others are shuffled.
    """
    chunks = chunks_for(dropped.count())
    wanted = [F.col(c) for c in dropped.columns]
    maybe, *own = (f"_{uuid.uuid4().hex}" for _ in range(len(key) + 1))
    keyed = docs.select("*", *[k.alias(o) for k, o in zip(key, own)])
    marked = with_held(keyed, [F.col(o) for o in own], bit_filter(dropped, wanted, chunks), chunks, maybe)
    side = dropped.toDF(*(f"{o}_" for o in own))
    same = F.lit(True)
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}_"))
    passed, doubtful = marked.filter(~F.col(maybe)), marked.filter(F.col(maybe)).join(side, same, "left_anti")
    return passed.unionByName(doubtful).drop(maybe, *own)
