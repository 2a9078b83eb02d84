"""Bundles that are larger than one string can be, read in splits.

A file is read as records that end with a closing brace, in the splits that Spark makes of it.  What a split does to the
reader's state is a function of the state before it: whether the split begins within a string, how many brackets of the
stack it closes, and which it opens and leaves open.  Pass 1 computes that for both cases, without knowing what comes
before; the functions of a file's splits (a row each) are then applied in order, which gives the state that each split
begins with.  Pass 2 reads again, cuts the objects of the list "objects" out of the text, and numbers them; an object that
crosses a split is put together from its pieces, all others stay where they are.

Defined cases: a file whose brackets don't close is left out; so is a list under another name; whatever strings hold, is
text; an empty file gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgraph.storage import stored

OBJECT, LIST, WANTED = "o", "a", "A"
#: What the stack is between the objects that are looked for.
BETWEEN = OBJECT + WANTED
_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}\[\]]', re.DOTALL)
_NAMED = re.compile(r'"objects"\s*:\s*\Z')
_STATES = "path string, begin long, in_string_0 boolean, closed_0 int, opened_0 string, in_string_1 boolean, closed_1 int, opened_1 string"
_BEGINNINGS = "path string, begin long, in_string boolean, stack string"
_PIECES = "path string, begin long, local int, first boolean, last boolean, text string"


def tokens(record: str, in_string: bool) -> Iterator[tuple[str, int, int, bool]]:
    """``bracket, start, end, in_string`` of each bracket outside of strings; of what a record ends in, an empty bracket."""
    at = 0
    if in_string:
        m = _REST.match(record)
        if m is None:
            yield "", len(record), len(record), True
            return
        at = m.end()
    for m in _TOKEN.finditer(record, at):
        if m[1] is None:
            yield m[0], m.start(), m.end(), False
        elif not m[1]:
            yield "", len(record), len(record), True
            return
    yield "", len(record), len(record), False


def opened_by(record: str, bracket: str, at: int, depth_is_one: bool) -> str:
    """How an opening bracket is kept on the stack."""
    if bracket == "{":
        return OBJECT
    return WANTED if depth_is_one and _NAMED.search(record, max(0, at - 64), at) else LIST


class Effect:
    """What a text does to the stack of brackets, and whether it ends within a string."""

    def __init__(self, in_string: bool):
        self.in_string, self.closed, self.opened = in_string, 0, ""

    def read(self, record: str) -> None:
        for bracket, start, _, ends_in_string in tokens(record, self.in_string):
            if not bracket:
                self.in_string = ends_in_string
            elif bracket in "{[":
                self.opened += opened_by(record, bracket, start, True)
            elif self.opened:
                self.opened = self.opened[:-1]
            else:
                self.closed += 1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """(path, begin, further columns) and record; the brace that ends a record is put back."""
    for b in batches:
        heads = [c.to_pylist() for c in b.columns[:-1]]
        for k, value in enumerate(b.column(b.num_columns - 1).to_pylist()):
            yield tuple(h[k] for h in heads), value + "}"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key: tuple, both: list[Effect]) -> pa.RecordBatch:
        values = [*key, *(x for e in both for x in (e.in_string, e.closed, e.opened))]
        kinds = [pa.string(), pa.int64(), *[pa.bool_(), pa.int32(), pa.string()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in _STATES.split(", ")])

    now, both = None, []
    for key, record in _splits(batches):
        if key != now:
            if now is not None:
                yield row(now, both)
            now, both = key, [Effect(False), Effect(True)]
        for e in both:
            e.read(record)
    if now is not None:
        yield row(now, both)


def beginnings(splits: pd.DataFrame) -> pd.DataFrame:
    """The state that each split of one file begins with; nothing for a file that doesn't close."""
    rows, in_string, stack = [], False, ""
    ordered = splits.sort_values("begin")
    for s in ordered.itertuples(index=False):
        rows.append((s.path, s.begin, in_string, stack))
        after, closed, opened = (s.in_string_1, s.closed_1, s.opened_1) if in_string else (s.in_string_0, s.closed_0, s.opened_0)
        stack = stack[: len(stack) - closed] + opened if closed <= len(stack) else ""
        # A list that lies deeper is none of those wanted: its name was seen, its depth wasn't.
        stack = "".join(LIST if c == WANTED and k != 1 else c for k, c in enumerate(stack))
        in_string = after
    columns = [c.split()[0] for c in _BEGINNINGS.split(", ")]
    return pd.DataFrame(rows if not in_string and not stack else [], columns=columns)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects, and pieces of objects: ``local`` counts those that a split begins, from 1; 0 is the one that it begins in."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    rows: list[tuple] = []
    now, stack, in_string, local, parts, first = None, "", False, 0, [], False

    def end_of_split() -> None:
        if now is not None and parts and len(stack) > len(BETWEEN) and stack.startswith(BETWEEN):
            rows.append((*now, local, first, False, "".join(parts)))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    size = 0
    for (path, begin, in_string_0, stack_0), record in _splits(batches):
        if (path, begin) != now:
            end_of_split()
            now, stack, in_string, local, parts, first = (path, begin), stack_0, in_string_0, 0, [], False
        at = 0 if len(stack) > len(BETWEEN) and stack.startswith(BETWEEN) else None  # where the object's text goes on
        for bracket, start, stop, ends_in_string in tokens(record, in_string):
            if not bracket:
                in_string = ends_in_string
            elif bracket in "{[":
                if bracket == "{" and stack == BETWEEN:
                    at, local, parts, first = start, local + 1, [], True
                stack += opened_by(record, bracket, start, len(stack) == 1)
            else:
                stack = stack[:-1]
                if stack == BETWEEN and at is not None:
                    rows.append((*now, local, first, True, "".join([*parts, record[at:stop]])))
                    size += len(rows[-1][-1])
                    at, parts, first = None, [], False
        if at is not None:
            parts.append(record[at:])
        if size > 4 << 20:
            yield batch()
            rows.clear()
            size = 0
    end_of_split()
    if rows:
        yield batch()


def large_bundle_objects(spark: SparkSession, base: str, larger_than: int = 0) -> DataFrame:
    """``path, obj_pos, object``: the objects of all JSON files below ``base`` that have more bytes than ``larger_than``, numbered
    in order of their file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("lineSep", "}").text(base)
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin")]
    records = files.filter(F.col("_metadata.file_size") > larger_than).select(*where, "value")
    states = stored(records.mapInArrow(_effects, _STATES))
    # A row a split; a file's rows meet in one group.
    begun = stored(states.groupBy("path").applyInPandas(beginnings, _BEGINNINGS))
    side = begun.select(F.col("path").alias("of_path"), F.col("begin").alias("of_begin"), "in_string", "stack")
    known = records.join(F.broadcast(side), (F.col("path") == F.col("of_path")) & (F.col("begin") == F.col("of_begin"))).select("path", "begin", "in_string", "stack", "value")
    found = stored(known.mapInArrow(_objects, _PIECES))
    counts = found.groupBy("path", "begin").agg(F.max("local").alias("n"))
    in_file = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("path").alias("of_path"), F.col("begin").alias("of_begin"), F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("before"))
    placed = found.join(F.broadcast(offsets), (F.col("path") == F.col("of_path")) & (F.col("begin") == F.col("of_begin"))).withColumn("obj_pos", (F.col("before") + F.col("local") - 1).cast("int"))
    whole = placed.filter("first and last").select("path", "obj_pos", F.col("text").alias("object"))
    pieces = placed.filter("not (first and last)").groupBy("path", "obj_pos").agg(F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("parts"))
    return whole.unionByName(pieces.select("path", "obj_pos", F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("object")))
