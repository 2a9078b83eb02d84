"""Peak concurrency of intervals, by step functions that are added in a tree.

1. *Build.*  A task turns its rows, whichever they are, into step functions: for each key the moments at which something
   starts or ends, with what changes there.  Moments of one key and time are one, whatever the rows.
2. *Cut.*  Functions are cut by time range (``RANGE_S``), so that a key's history is many small rows: a range has
   ``RANGE_S / 60`` moments at most, however many intervals there are.
3. *Merge.*  The functions of one (key, range) are added two by two.  A shuffle brings ``FAN`` tasks' functions of a
   range together, which are then added in rounds; beyond that there is another shuffle, so that their number grows with
   the logarithm of the tasks, and no task sees all functions even of the key and range that most intervals have.
4. *Stitch.*  What a range leaves behind is two sums and two maxima.  A scan over the ranges of a key, one row each,
   carries them on, and the ranges are unrolled with their carry, each by itself.

The function over all keys is the sum of the finished functions of a range, so that rows aren't sent twice.

Defined cases: intervals with a null start, or an end that isn't after the start, take no part; a null end is never; a
null key is ``NO_KEY``; null amounts are 0; repeated intervals count each; moments where starts and ends cancel are no
rows; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgraph.llm.common import discard, join_counted, map_arrow, shuffle_partitions, written

UNIT_S, RANGE_S, DAY_S = 60, 86_400, 86_400
#: Tasks whose functions of a range meet in one group.
FAN = 256
#: Moments that a task keeps before it gives its functions on and begins new ones.
MOST_MOMENTS = 2_000_000
NO_KEY, ALL_KEYS = -1, -2
OPEN_DAYS = 7
#: Rows that the spread of null keys in a join is dealt to.
NULL_PARTS = 1024
#: Cents beyond this are no amount.
MOST_CENTS = 9.0e18

_FUNCTION = "key int, range long, part long, at array<int>, d_count array<long>, d_amount array<long>"
_PROFILE = "key int, range long, at array<int>, d_count array<long>, d_amount array<long>, count long, amount long, top_count long, top_amount long"
_LISTS = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

Moments = tuple[np.ndarray, ...]


def added(group: list[np.ndarray], at: np.ndarray, *changes: np.ndarray) -> Moments:
    """Moments that agree in all of ``group`` and in ``at`` made one, in that order; those that change nothing go."""
    order = np.lexsort((at, *reversed(group)))
    keys = [g[order] for g in (*group, at)]
    if not len(order):
        return (*keys, *(c[order] for c in changes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(c[order], first) for c in changes]
    kept = np.any([s != 0 for s in sums], axis=0)
    return (*(k[first][kept] for k in keys), *(s[kept] for s in sums))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), n)


def _lists(bounds: np.ndarray, columns: tuple[np.ndarray, ...]) -> list[pa.Array]:
    offsets = pa.array(bounds, pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c, kind.value_type)) for c, kind in zip(columns, _LISTS)]


# -- 1. and 2. -------------------------------------------------------------------------------------------------------


def _functions(part: int, moments: Moments) -> pa.RecordBatch:
    key, when, d_count, d_amount = moments
    of_range = when // RANGE_S
    bounds = _runs(key, of_range)
    heads = bounds[:-1]
    arrays = [pa.array(key[heads], pa.int32()), pa.array(of_range[heads], pa.int64()), pa.array(np.full(len(heads), part), pa.int64())]
    return pa.RecordBatch.from_arrays([*arrays, *_lists(bounds, ((when - of_range * RANGE_S), d_count, d_amount))], names=["key", "range", "part", "at", "d_count", "d_amount"])


def _build(most: int):
    """A task's rows as functions; more than ``most`` moments are given on, and others begun."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        none = np.zeros(0, dtype=np.int64)
        held: Moments = (none, none, none, none)
        waiting: list[Moments] = []
        n = 0
        for b in batches:
            key, start, amount = (b.column(k).to_numpy().astype(np.int64) for k in (0, 1, 3))
            ends = b.column(2)
            closed = np.asarray(ends.is_valid())
            end = ends.fill_null(0).to_numpy().astype(np.int64)[closed]
            one = np.ones(len(key), dtype=np.int64)
            waiting.append((np.concatenate((key, key[closed])), np.concatenate((start, end)), np.concatenate((one, -one[closed])), np.concatenate((amount, -amount[closed]))))
            n += len(waiting[-1][0])
            if n > most // 4:
                k, t, c, a = (np.concatenate(x) for x in zip(held, *waiting))
                held, waiting, n = added([k], t, c, a), [], 0
                if len(held[0]) > most:
                    yield _functions(part, held)
                    held = (none, none, none, none)
        k, t, c, a = (np.concatenate(x) for x in zip(held, *waiting))
        held = added([k], t, c, a)
        if len(held[0]):
            yield _functions(part, held)

    return run


# -- 3. --------------------------------------------------------------------------------------------------------------


def _added_in_rounds(key: np.ndarray, of_range: np.ndarray, part: np.ndarray, *moments: np.ndarray) -> Moments:
    """All functions of each (key, range) added two by two; ``part`` is their number."""
    at, d_count, d_amount = moments
    while True:
        key, of_range, part, at, d_count, d_amount = added([key, of_range, part], at, d_count, d_amount)
        if not part.any():
            return key, of_range, at, d_count, d_amount
        part = part >> 1


def _merge(fan: int, finished: bool):
    """Adds functions that come by (key, range, part); a part becomes that of its block.  ``finished``: with their profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def merged(rows: pa.Table) -> pa.RecordBatch:
            key, of_range, part = (rows.column(k).to_numpy().astype(np.int64) for k in range(3))
            lists = [rows.column(k).combine_chunks() for k in (3, 4, 5)]
            sizes = np.diff(lists[0].offsets.to_numpy())
            flat = [x.flatten().to_numpy().astype(np.int64) for x in lists]
            block = np.repeat(part // fan, sizes)
            # A block's number is its key while its functions are added: rounds are over numbers below the fan.
            moments = _added_in_rounds(np.repeat(key, sizes) * (1 << 32) + block, np.repeat(of_range, sizes), np.repeat(part % fan, sizes), *flat)
            both, of_range, at, d_count, d_amount = moments
            bounds = _runs(both, of_range) if len(both) else np.zeros(1, dtype=np.int64)
            heads = bounds[:-1]
            block, key = both[heads] & 0xFFFFFFFF, both[heads] >> 32
            out = [pa.array(key, pa.int32()), pa.array(of_range[heads], pa.int64())]
            if not finished:
                return pa.RecordBatch.from_arrays([*out, pa.array(block, pa.int64()), *_lists(bounds, (at, d_count, d_amount))], names=["key", "range", "part", "at", "d_count", "d_amount"])
            return pa.RecordBatch.from_arrays([*out, *_lists(bounds, (at, d_count, d_amount)), *_profile(bounds, d_count, d_amount)], names=[c.split()[0] for c in _PROFILE.split(", ")])

        for b in batches:
            rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = rows.num_rows - 1
            same = (rows.column(0).to_numpy() == rows.column(0)[last].as_py()) & (rows.column(1).to_numpy() == rows.column(1)[last].as_py())
            begin = int(np.argmax(same))  # rows are sorted: the last group's are the last
            if begin:
                yield merged(rows.slice(0, begin))
            rest = rows.slice(begin)
        if rest is not None:
            yield merged(rest)

    return run


def _profile(bounds: np.ndarray, *changes: np.ndarray) -> list[pa.Array]:
    """Of each function: its two sums, then the largest that each sum is at any of its moments."""
    sums, tops = [], []
    for change in changes:
        running = _within(bounds, change)
        sums.append(pa.array(running[bounds[1:] - 1] if len(bounds) > 1 else running, pa.int64()))
        tops.append(pa.array(np.maximum.reduceat(running, bounds[:-1]) if len(bounds) > 1 else running, pa.int64()))
    return sums + tops


def _within(bounds: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each run."""
    running = np.cumsum(change)
    before = np.concatenate(([0], running))[bounds[:-1]]
    return running - np.repeat(before, np.diff(bounds))


def _met(functions: DataFrame, fan: int) -> DataFrame:
    """Rows of a (key, range, block) together and in order."""
    keys = ["key", "range", F.floor(F.col("part") / F.lit(fan))]
    return functions.repartition(shuffle_partitions(functions.sparkSession), *keys).sortWithinPartitions("key", "range", "part")


def merged_functions(functions: DataFrame, fan: int = FAN) -> DataFrame:
    """One function, with its profile, for each (key, range)."""
    now = written(functions)
    parts = (now.agg(F.max("part").alias("most")).first()["most"] or 0) + 1
    while parts > fan:
        now, before = written(map_arrow(_met(now, fan), _merge(fan, False), _FUNCTION)), now
        discard(before)
        parts = -(-parts // fan)
    return written(map_arrow(_met(now, fan), _merge(fan, True), _PROFILE).filter(F.size("at") > 0))


def over_all_keys(finished: DataFrame, all_keys: int) -> DataFrame:
    """The sum of all keys' finished functions of each range, as the function of ``all_keys``."""
    keys = finished.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    part = F.pmod(F.xxhash64("key"), F.lit(max(1, keys)))  # keys that share a number are added all the same
    return merged_functions(finished.select(F.lit(all_keys).cast("int").alias("key"), "range", part.alias("part"), "at", "d_count", "d_amount"))


# -- 4. --------------------------------------------------------------------------------------------------------------


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of functions that come with what is carried into them."""
    for b in batches:
        key, of_range = (b.column(k).to_numpy() for k in (0, 1))
        lists = [b.column(k) for k in (2, 3, 4)]
        sizes = np.diff(lists[0].offsets.to_numpy())
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        at, d_count, d_amount = (x.flatten().to_numpy() for x in lists)
        carried, carried_amount, high, peak = (np.repeat(b.column(k).to_numpy(), sizes) for k in (5, 6, 7, 8))
        when = np.repeat(of_range, sizes) * RANGE_S + at
        count, amount = _within(bounds, d_count) + carried, _within(bounds, d_amount) + carried_amount
        highs = np.concatenate([np.maximum.accumulate(count[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]) if len(key) else count
        following = np.append(when[1:], 0)
        ends = np.asarray(b.column(9).is_valid())
        last = bounds[1:] - 1
        following[last] = b.column(9).fill_null(0).to_numpy()
        ended = np.zeros(len(when), dtype=bool)
        ended[last[~ends]] = True
        arrays = [
            pa.array(np.repeat(key, sizes), pa.int32()), pa.array(when, pa.int64()), pa.array(following, pa.int64(), mask=ended), pa.array(count, pa.int64()), pa.array(amount, pa.int64()),
            pa.array(np.maximum(highs, high), pa.int64()), pa.array(amount == peak, pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "from_s", "to_s", "n_open", "open_amount", "high_open", "is_peak"])


def stitched(finished: DataFrame) -> DataFrame:
    """The rows of all functions.  The scan has one row a (key, range): as many as days, not as intervals."""
    in_time = Window.partitionBy("key").orderBy("range")
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    ranges = finished.select("key", "range", "count", "amount", "top_count", "top_amount", (F.col("range") * RANGE_S + F.element_at("at", 1)).alias("first_s"))
    carried = ranges.withColumns({"carried": F.coalesce(F.sum("count").over(before), F.lit(0)), "carried_amount": F.coalesce(F.sum("amount").over(before), F.lit(0)), "next_s": F.lead("first_s").over(in_time)})
    tops = carried.withColumns({"high": F.coalesce(F.max(F.col("carried") + F.col("top_count")).over(before), F.lit(0)), "peak": F.max(F.col("carried_amount") + F.col("top_amount")).over(Window.partitionBy("key"))})
    side = tops.select(F.col("key").alias("of_key"), F.col("range").alias("of_range"), "carried", "carried_amount", "high", "peak", "next_s")
    joined = finished.join(side, (F.col("key") == F.col("of_key")) & (F.col("range") == F.col("of_range")))
    rows = joined.select("key", "range", "at", "d_count", "d_amount", "carried", "carried_amount", "high", "peak", "next_s")
    return map_arrow(rows, _unrolled, "key int, from_s long, to_s long, n_open long, open_amount long, high_open long, is_peak boolean")


def concurrency(intervals: DataFrame, all_keys: int | None = ALL_KEYS, fan: int = FAN, most_moments: int = MOST_MOMENTS) -> DataFrame:
    """``key, from_s, to_s, n_open, open_amount, high_open, is_peak`` of ``key, start_s, end_s, amount``: a row for each key and
    moment at which the count or the amount changes.  ``all_keys``: a key for all intervals together."""
    whole = intervals.filter("start_s is not null and (end_s is null or end_s > start_s)")
    rows = whole.select(F.coalesce(F.col("key").cast("int"), F.lit(NO_KEY)).alias("key"), F.col("start_s").cast("long").alias("start_s"), F.col("end_s").cast("long").alias("end_s"), F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"))
    finished = merged_functions(map_arrow(rows, _build(most_moments), _FUNCTION), fan)
    if all_keys is not None:
        finished = finished.unionByName(over_all_keys(finished, all_keys))
    return stitched(finished)


# -- sales -----------------------------------------------------------------------------------------------------------


def minute(time: Column) -> Column:
    """Seconds since 1970 of a time without a zone, rounded down to minutes; the session's zone plays no part."""
    return F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long") * DAY_S + F.hour(time) * 3600 + F.minute(time) * 60


def cents(total: Column) -> Column:
    """Rounded cents; what is null or no number of 64 bits is 0."""
    scaled = total.cast("double") * 100 + 0.5
    return F.when(F.abs(scaled) < MOST_CENTS, F.floor(scaled).cast("long")).otherwise(F.lit(0).cast("long"))


def sale_intervals(sales: DataFrame, sale_lines: DataFrame, clients: DataFrame) -> DataFrame:
    """``key, start_s, end_s, amount``: when each sale is open, by its client's nation.

    A client or sale that most rows have is not one task's: clients with very many sales are met by broadcast, lines are
    reduced before they are sent, null ids are spread.  Of a client's repeated rows the smallest nation counts.
    """
    cut = sales.select("sale_id", "client_id", minute(F.col("sold_at")).alias("start_s"), cents(F.col("total")).alias("amount")).filter("start_s is not null")
    nations = clients.filter("client_id is not null").groupBy(F.col("client_id").alias("of_client")).agg(F.min("nation_id").alias("nation_id"))
    counts = cut.filter("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n_sales"))
    seen = written(counts.join(nations, F.col("client_id") == F.col("of_client"), "left").select("client_id", "n_sales", F.coalesce(F.col("nation_id").cast("int"), F.lit(NO_KEY)).alias("key")))
    known = join_counted(cut.filter("client_id is not null"), seen, "client_id", "n_sales").select("sale_id", "key", "start_s", "amount")
    keyed = known.unionByName(cut.filter("client_id is null").select("sale_id", F.lit(NO_KEY).alias("key"), "start_s", "amount"))
    shipped = sale_lines.filter("sale_id is not null and shipped_at is not null").groupBy(F.col("sale_id").alias("of_sale")).agg(F.min("shipped_at").alias("shipped_at"))
    ends = shipped.select("of_sale", F.lit(0).alias("spread"), (minute(F.col("shipped_at")) + OPEN_DAYS * DAY_S).alias("end_s"))
    spread = F.when(F.col("sale_id").isNull(), F.pmod(F.xxhash64("start_s", "amount", "key"), F.lit(NULL_PARTS)).cast("int")).otherwise(0)
    joined = keyed.withColumn("null_part", spread).join(ends, (F.col("sale_id") == F.col("of_sale")) & (F.col("null_part") == F.col("spread")), "left")
    return joined.select("key", "start_s", "end_s", "amount")


#: DuckDB SQL for op12_peak_concurrency.
SQL = """
WITH e AS (
    SELECT sale_id, CAST(floor(epoch(min(shipped_at)) / 60) AS BIGINT) * 60 + 604800 AS end_s FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id
), c AS (
    SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id
), s AS (
    SELECT coalesce(c.nation_id, -1) AS nation_id, CAST(floor(epoch(s.sold_at) / 60) AS BIGINT) * 60 AS start_s, e.end_s, coalesce(CAST(floor(100 * s.total + 0.5) AS BIGINT), 0) AS cents
    FROM sales s LEFT JOIN e ON s.sale_id = e.sale_id LEFT JOIN c ON s.client_id = c.client_id WHERE s.sold_at IS NOT NULL
), o AS (
    SELECT * FROM s WHERE end_s IS NULL OR end_s > start_s
), m AS (
    SELECT nation_id, start_s AS t_s, 1 AS d, cents AS v FROM o UNION ALL SELECT nation_id, end_s, -1, -cents FROM o WHERE end_s IS NOT NULL
), d AS (
    SELECT nation_id, t_s, sum(d) AS d, sum(v) AS v FROM (SELECT * FROM m UNION ALL SELECT -2, t_s, d, v FROM m) GROUP BY nation_id, t_s HAVING sum(d) <> 0 OR sum(v) <> 0
), r AS (
    SELECT nation_id, t_s, sum(d) OVER w AS n_open, sum(v) OVER w AS open_cents, lead(t_s) OVER w AS to_s FROM d WINDOW w AS (PARTITION BY nation_id ORDER BY t_s)
)
SELECT CAST(nation_id AS INTEGER) AS nation_id, t_s AS from_s, to_s, CAST(n_open AS BIGINT) AS n_open, CAST(open_cents AS BIGINT) AS open_cents,
       CAST(max(n_open) OVER (PARTITION BY nation_id ORDER BY t_s) AS BIGINT) AS high_open, open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak
FROM r
"""
