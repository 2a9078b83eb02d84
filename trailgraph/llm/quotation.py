"""Quotation linking: conversations in reply order, without quotes.

A message's lines are parsed into quote levels (the number of leading ``>``) and these into passages: paragraphs of one
level.  A line that announces a quote ("... wrote:") goes with it.  Passages are normalised (case, white space) and
hashed.  A quoted passage is joined to the first message of its conversation that has the passage, or the whole of it,
as own text; failing that, to the first message of any other conversation.  Joins are against two originals a hash at
most, so that a passage quoted very often makes one row a quote, and quotes of one passage are not one task's.

A message's own text is the message without the quoted passages that were linked, and without the lines that announce
them; all else stays as it was written, quotes of no known message too.

A message replies to the latest earlier message that it quotes, else to the message before it.  A conversation falls
into branches: one begins where a message replies to another than the one before it.

Defined cases: null or empty text has no passage and an empty own text; a message without a linked quote keeps its text
as it is, and one with keeps no blank lines at its ends; a quote of no known message is counted, not linked; a message never
replies to itself or a later one; messages without conversation id or turn pass with no link; rows repeating a
conversation id and turn are linked alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgraph.llm.common import join_counted, map_batches, written

_MARK = re.compile(r"[ \t]*>")
_ANNOUNCES = re.compile(r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$")
_BLANKS = re.compile(r"\s+")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")

#: A conversation of more messages is ordered in blocks, by many tasks; into how many blocks at most.
BLOCK_TURNS, MOST_BLOCKS = 4096, 512

PARSED = "conv_id long, turn long, role string, parts array<struct<level:int,hash:long,raw:string>>, own array<long>"


def line_level(line: str) -> tuple[int, str]:
    """Quote level and content of a line."""
    level, at = 0, 0
    while m := _MARK.match(line, at):
        level, at = level + 1, m.end()
    return level, line[at:].strip() if level else line.rstrip()


@dataclass
class Part:
    """A passage: its lines without marks, the lines of the message it covers, and where among these its own begin."""

    level: int
    bodies: list[str] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)

    def add(self, body: str, raw: str) -> None:
        self.at.append(len(self.raw))
        self.bodies.append(body)
        self.raw.append(raw)


def parts(text: str) -> list[Part]:
    """The passages of a message in order; together their lines are the message.  Blank lines go with the passage before;
    lines that announce a quote, and blank quoted ones between own text and a quote, with the quote."""
    out: list[Part] = []
    waiting: list[str] = []
    open_passage = False
    for raw in _LINE.findall(text):
        level, body = line_level(raw.rstrip("\r\n"))
        if not body.strip():
            if out and not waiting and (not level or out[-1].level):
                out[-1].raw.append(raw)
            else:
                waiting.append(raw)
            open_passage = False
            continue
        if level and out and out[-1].level < level and _ANNOUNCES.match(out[-1].bodies[-1]):
            before = out[-1]
            before.bodies.pop()
            cut = before.at.pop() if before.bodies else 0
            waiting = before.raw[cut:] + waiting
            del before.raw[cut:]
            if not before.bodies:
                out.pop()
            open_passage = False
        if not (open_passage and out[-1].level == level):
            out.append(Part(level, raw=waiting))
            waiting = []
        out[-1].add(body, raw)
        open_passage = True
    if waiting:
        out.append(Part(0, raw=waiting))
    return out


def passages(text: str | None) -> list[tuple[int, str]]:
    """(level, passage) of a message in order; announcing lines are left out where a quote follows."""
    return [(p.level, "\n".join(p.bodies)) for p in parts(text or "") if p.bodies]


def passage_hash(passage: str) -> int:
    """Of the passage without case and with single spaces; 0 is kept for none."""
    plain = _BLANKS.sub(" ", passage).strip().lower()
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


def _parse(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
        found = parts(text or "")
        said = [(p, "\n".join(p.bodies)) for p in found]
        own = [passage for p, passage in said if not p.level and p.bodies]
        hashes = sorted({passage_hash(p) for p in [*own, "\n\n".join(own)]}) if own else []
        rows.append((conv, turn, role, [{"level": p.level, "hash": passage_hash(passage) if p.level else None, "raw": "".join(p.raw)} for p, passage in said], hashes))
    made = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("raw", pa.string())]))
    types = [pa.int64(), pa.int64(), pa.string(), made, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "turn", "role", "parts", "own"])


def _with_block(turns: DataFrame) -> DataFrame:
    """Adds ``block`` to ``conv_id, turn``, a written table: 0, but in conversations of more than ``BLOCK_TURNS`` messages the
    number of the conversation's own cuts at or below the turn.

    Cuts are approximate quantiles, so that blocks hold about as many messages each however far apart the turns are.  Which
    cuts there are doesn't change the result.
    """
    none = F.floor(F.col("turn") / BLOCK_TURNS)  # messages without a conversation go by the turn's value
    sizes = written(turns.filter("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_TURNS))
    if sizes.first() is None:
        return turns.withColumn("block", F.when(F.col("conv_id").isNull(), none).otherwise(F.lit(0).cast("long")))
    shares = [k / MOST_BLOCKS for k in range(1, MOST_BLOCKS)]
    cuts = join_counted(turns, sizes, "conv_id", "n").groupBy("conv_id", "n").agg(F.percentile_approx("turn", shares, 8 * MOST_BLOCKS).alias("cuts"))
    long = join_counted(turns, written(cuts.withColumn("cuts", F.array_distinct("cuts"))), "conv_id", "n")
    cut = long.select("conv_id", "turn", F.size(F.filter("cuts", lambda c: c <= F.col("turn"))).cast("long").alias("block"))
    # Long conversations are at most one in ``BLOCK_TURNS`` of all rows.
    rest = turns.join(sizes.select(F.col("conv_id").alias("long_id")), F.col("conv_id") == F.col("long_id"), "left_anti")
    return cut.unionByName(rest.withColumn("block", F.when(F.col("conv_id").isNull(), none).otherwise(F.lit(0).cast("long"))))


def _windows() -> tuple[Window, Window, Window]:
    """Within a block, over a conversation's blocks, and over the blocks before.  A conversation that holds most messages is
    ordered by many tasks; its blocks are few rows."""
    across = Window.partitionBy("conv_id").orderBy("block")
    return Window.partitionBy("conv_id", "block").orderBy("turn"), across, across.rowsBetween(Window.unboundedPreceding, -1)


def _with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    side = blocks.withColumnsRenamed({"conv_id": "__c", "block": "__b"})
    return rows.join(side, F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("block").eqNullSafe(F.col("__b"))).drop("__c", "__b")


def _with_before(rows: DataFrame) -> DataFrame:
    """Adds ``before``: the conversation's turn before each."""
    within, across, _ = _windows()
    lasts = rows.groupBy("conv_id", "block").agg(F.max("turn").alias("last")).select("conv_id", "block", F.lag("last").over(across).alias("last_before"))
    return _with_blocks(rows, lasts).withColumn("before", F.coalesce(F.lag("turn").over(within), "last_before")).drop("last_before")


def _with_branches(rows: DataFrame) -> DataFrame:
    """Adds ``branch``, the number of branch starts up to each turn, and ``place`` in the branch, from 1."""
    within, _, earlier = _windows()
    rows = rows.withColumn("at", F.row_number().over(within)).withColumn("begun", F.sum("starts").over(within))
    rows = rows.withColumn("start_at", F.max(F.when(F.col("starts") == 1, F.col("at"))).over(within))
    sums = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("starts").alias("s"), F.max("start_at").alias("m"))
    sums = sums.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("s_before", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    sums = sums.withColumn("m_before", F.coalesce(F.max(F.col("m") + F.col("n_before")).over(earlier), F.lit(1)))
    rows = _with_blocks(rows, sums.select("conv_id", "block", "n_before", "s_before", "m_before"))
    place = F.col("at") + F.col("n_before") - F.coalesce(F.col("start_at") + F.col("n_before"), F.col("m_before")) + 1
    return rows.withColumn("branch", (F.col("s_before") + F.col("begun")).cast("long")).withColumn("place", place.cast("long"))


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, own_text, n_quotes, n_linked, source_conv, source_turn, reply_to, branch, place`` of every message.

    ``source_*``: the message of another conversation that it quotes first.  ``branch``, ``place``: order in the
    conversation without quotes.
    """
    picked = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"))
    parsed = written(map_batches(picked, _parse, PARSED))
    known = parsed.filter("conv_id is not null and turn is not null")
    here = written(known.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("first_turn")))
    quotes = known.select("conv_id", "turn", F.explode(F.filter("parts", lambda p: p["level"] > 0)).alias("q")).select("conv_id", "turn", "q.level", "q.hash").distinct()
    asked = quotes.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("asked"))
    linked = join_counted(quotes, written(asked.join(here, ["conv_id", "hash"], "left")), ["conv_id", "hash"], "asked").drop("asked")
    linked = written(linked.withColumn("first_turn", F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn"))))
    # What the own conversation doesn't have may be another's: one original a hash, and a second where the first is its own.
    wanted = linked.filter("first_turn is null").select("conv_id", "turn", "hash").distinct()
    origins = here.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("first_turn").alias("turn"))).alias("origin"), F.count(F.lit(1)).alias("holding"))
    origins = written(wanted.groupBy("hash").agg(F.count(F.lit(1)).alias("wanting")).join(origins, "hash"))
    wanted = written(join_counted(wanted, origins, "hash", "wanting").drop("wanting"))
    own_first = wanted.filter("origin.conv_id = conv_id").drop("origin", "holding")
    asking = written(wanted.filter("origin.conv_id = conv_id").groupBy("hash").agg(F.first("origin.conv_id").alias("first_conv"), F.first("holding").alias("holding"), F.count(F.lit(1)).alias("asking")))
    seconds = join_counted(here, asking, "hash", "holding").filter("conv_id != first_conv").groupBy("hash").agg(F.min(F.struct("conv_id", F.col("first_turn").alias("turn"))).alias("origin"), F.first("asking").alias("asking"))
    own_first = join_counted(own_first, written(seconds), "hash", "asking").drop("asking")
    outside = wanted.filter("origin.conv_id != conv_id").drop("holding").unionByName(own_first)
    taken = linked.filter("first_turn is not null").select("conv_id", "turn", "hash").unionByName(outside.select("conv_id", "turn", "hash"))
    taken = taken.groupBy("conv_id", "turn").agg(F.collect_set("hash").alias("taken"))  # as many as a message has quotes
    outside = outside.groupBy("conv_id", "turn").agg(F.min("origin").alias("origin"), F.count(F.lit(1)).alias("n_outside"))
    inside = linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("first_turn").alias("n_inside"), F.max("first_turn").alias("quoted_turn"))
    turns = _with_before(written(_with_block(written(parsed.select("conv_id", "turn").distinct()))))
    replies = turns.join(inside, ["conv_id", "turn"], "left").join(outside, ["conv_id", "turn"], "left").join(taken, ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("quoted_turn", "before"))
    ordered = _with_branches(replies.withColumn("starts", (F.col("quoted_turn") != F.col("before")).eqNullSafe(F.lit(True)).cast("long")))
    replies = ordered.select(
        F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        (F.coalesce("n_inside", F.lit(0)) + F.coalesce("n_outside", F.lit(0))).cast("long").alias("n_linked"),
        F.col("origin.conv_id").alias("source_conv"), F.col("origin.turn").alias("source_turn"), "reply_to", "branch", "place", "taken",
    )
    joined = parsed.select("conv_id", "turn", "role", "parts").join(replies, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn")), "left")
    kept = F.filter("parts", lambda p: (p["level"] == 0) | ~F.coalesce(F.array_contains("taken", p["hash"]), F.lit(False)))
    text = F.concat_ws("", F.transform(kept, lambda p: p["raw"]))
    own_text = F.when(F.size(kept) < F.size("parts"), F.regexp_replace(text, r"^(?:[ \t\r]*\n)+|\s+$", "")).otherwise(text)
    return joined.withColumn("own_text", own_text).select("conv_id", "turn", "role", "own_text", "n_quotes", "n_linked", "source_conv", "source_turn", "reply_to", "branch", "place")
