"""What several operators share: inputs, the shared folder, Arrow batches, joins with hot keys, and rows in key order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.storage import discard, stored, working_folder

#: Rows and bytes of the part of an Arrow batch that a Python worker works on at a time (a single row may be longer).
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: A key with more rows than this, and than one in ``MOST_HOT`` of all rows, is hot: there are fewer than ``MOST_HOT``.
HOT_ROWS, MOST_HOT = 500, 10_000
#: Of rows in key order: a key worth so many parts is dealt on by text, to so many parts at most, by so many first characters,
#: of which so many are sampled for a part.
HOT_PARTS, MOST_INNER, HEAD_CHARS, SAMPLED_A_PART = 2, 1024, 256, 50

__all__ = ["discard", "join_counted", "map_arrow", "map_batches", "ordered_parts", "range_bounds", "range_part", "shared_folder", "shuffle_partitions", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    return working_folder(spark)


def written(df: DataFrame) -> DataFrame:
    """Writes to the shared folder and reads again: cuts lineage, and survives lost executors."""
    return stored(df)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and bytes, without copying."""
    if batch.num_rows <= 1 or batch.num_rows <= BATCH_ROWS and batch.nbytes <= BATCH_BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _parts(batch.slice(0, half))
        yield from _parts(batch.slice(half))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded size, whatever the session's settings are; they are left as they are."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for batch in batches if batch.num_rows for part in _parts(batch))
        pa.default_memory_pool().release_unused()  # the worker serves other tasks next

    return df.mapInArrow(bounded, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """The same for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := function(batch)) is not None:
                yield out

    return map_arrow(df, run, schema)


def join_counted(rows: DataFrame, side: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``side``, a written table of one row a key (one column or several, not null) that tells in
    ``count`` how many of ``rows`` have it (or more).

    Hot keys' rows stay where they are and meet a broadcast of fewer than ``MOST_HOT`` rows; the others are shuffled by
    key, so that no task has more than one in ``MOST_HOT`` of all rows, or ``HOT_ROWS``, for a key.
    """
    seen = side.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    bound = max(HOT_ROWS, (seen["total"] or 0) // MOST_HOT)
    if (seen["most"] or 0) <= bound:
        return rows.join(side, key)
    hot = side.filter(F.col(count) > bound)
    cold = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(side.filter(F.col(count) <= bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending inner bounds that split the rows by ``key`` (a long) into about equal parts; nulls aside."""
    return sorted(set(_cuts(df, key, parts)))


def _cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """The bounds, one that many rows have as often as they are parts' worth."""
    if parts <= 1:
        return []
    return [int(c) for c in df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts)]


def range_part(key: Column, bounds: Sequence[int | str], kind: str = "long") -> Column:
    """Number of the bounds at or below ``key``: the part it is in, 0 for null.  Two levels, so that many bounds stay cheap."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(r[0]).cast(kind) for r in rows])
    fine = F.array(*[F.array(*[F.lit(b).cast(kind) for b in r]) for r in rows])
    coarse = F.size(F.filter(heads, lambda b: b <= key))
    inner = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda b: b <= key))
    return F.coalesce(F.when(key.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * width + inner), F.lit(0)).cast("int")


def ordered_parts(df: DataFrame, key: str, text: str, parts: int) -> tuple[Column, list[int | None]]:
    """The part of each row, in order of (``key``, ``text``), nulls first, and the keys that are in several parts.

    A key, or none, that is worth ``HOT_PARTS`` parts or more is dealt on by its texts' beginnings.  Their bounds come from
    a sample of bounded size; it sets how even parts are, never which rows there are.  Only rows that are alike in key and
    in ``HEAD_CHARS`` characters can't be told apart.
    """
    cuts = _cuts(df, key, parts)
    bounds = sorted(set(cuts))
    n = df.agg(F.count(F.lit(1)).alias("all"), F.count(key).alias("keyed")).first()
    worth: dict[int | None, int] = {k: c for k, c in Counter(cuts).items() if c >= HOT_PARTS}
    worth = {k: max(1, c * n["keyed"] // n["all"]) for k, c in worth.items()}
    if n["all"] and (nulls := (n["all"] - n["keyed"]) * parts // n["all"]) >= HOT_PARTS:
        worth[None] = nulls
    whole = range_part(F.col(key), bounds)
    if not worth:
        return whole, []
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, HEAD_CHARS)
    hot = df.filter(F.col(key).isin([k for k in worth if k is not None]) | (F.col(key).isNull() if None in worth else F.lit(False)))
    wanted = SAMPLED_A_PART * sum(worth.values())
    # As many heads as wanted, in expectation: their number goes with that of the parts, not of the rows.
    drawn = hot.select(F.col(key).alias("key"), head.alias("head")).sample(min(1.0, wanted / max(1, n["all"] * sum(worth.values()) // parts)), seed=7).collect()
    most = min(parts, MOST_INNER)
    inner = F.lit(most)  # other keys of the part come after the hot one
    for k, c in worth.items():
        heads = sorted((r["head"] for r in drawn if r["key"] == k), key=str.encode)
        c = min(c, most)
        cut = sorted({heads[len(heads) * i // c] for i in range(1, c)} if heads else set(), key=str.encode)
        inner = F.when(F.col(key).eqNullSafe(F.lit(k).cast("long")), range_part(head, cut, "string")).otherwise(inner)
    return (whole * (most + 1) + inner).cast("int"), list(worth)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
