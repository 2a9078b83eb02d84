"""Fill-in-middle transformation by big-integer bit-parallelism.

A text's UTF-8 bytes are classed by ``bytes.translate``, and a class becomes one big integer whose bit i tells whether
byte i is in it.  Shifting the newlines by one marks where units (lines with their newline) begin, ``bit_count`` gives
how many there are, and recursive halving finds the byte at which the k-th of them begins; code points are bytes that
continue none.  Each step is a few operations on whole integers, linear in the text, whatever its length.

The draws are sha256 of a seed and the key, so that a row's form depends on the row alone.  ``restored`` takes a
document back to its text by DataFrame functions: a sentinel begins with the only ``<`` it has, so that none can arise
where a part and a sentinel meet.

Defined cases: null text counts as empty; an empty text, and one that holds a sentinel, is plain; an empty prefix,
middle or suffix is an empty string; a null key is drawn as the empty word; repeated rows are each transformed alike; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
#: For ``bits``: bytes that end a unit, and bytes that continue a code point.
NEWLINES = bytes(0x31 if c == 0x0A else 0x30 for c in range(256))
CONTINUING = bytes(0x31 if 0x80 <= c < 0xC0 else 0x30 for c in range(256))


def bits(raw: bytes, of_class: bytes) -> int:
    """Bit i tells whether byte i is in the class."""
    return int(raw[::-1].translate(of_class), 2) if raw else 0


def unit_starts(raw: bytes) -> int:
    """Bit i tells whether a unit begins at byte i: at the first, and after each newline but a last one."""
    return (bits(raw, NEWLINES) << 1 | 1) & ((1 << len(raw)) - 1)


def select(mask: int, width: int, rank: int) -> int:
    """The place of the set bit that ``rank`` others are below, of ``width`` bits.  A half that can't hold it is cut away, so
    that all steps together cost about two passes."""
    if width == 1:
        return 0
    half = width // 2
    low = mask & ((1 << half) - 1)
    below = low.bit_count()
    return select(low, half, rank) if rank < below else half + select(mask >> half, width - half, rank - below)


def code_points(continuing: int, start: int, end: int) -> int:
    """Code points of the bytes from ``start`` to ``end``."""
    return end - start - (continuing >> start & ((1 << (end - start)) - 1)).bit_count()


@dataclass
class Cut:
    """A text's form and output; ``prefix_chars`` and ``middle_chars`` are None where it is plain."""

    n: int
    form: str
    output: bytes
    prefix_chars: int | None = None
    middle_chars: int | None = None


def transform(text: str | None, key: str, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> Cut:
    """One text, cut between units; ``key``: the decimal id."""
    raw = (text or "").encode()
    starts = unit_starts(raw)
    n = starts.bit_count()
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    if not raw or _P in raw or _S in raw or _M in raw or h3 % 100 >= fim_percent:
        return Cut(n, "plain", raw)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (len(raw) if units == n else select(starts, len(raw), units) for units in (first, second))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    spm = h4 % 100 < spm_percent
    output = b"".join((_S, suffix, _P, prefix, _M, middle) if spm else (_P, prefix, _S, suffix, _M, middle))
    continuing = bits(raw, CONTINUING)
    return Cut(n, "spm" if spm else "psm", output, code_points(continuing, 0, a), code_points(continuing, a, b))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _rows(seed: int, fim_percent: int, spm_percent: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = b.column(0).to_pylist()
        cuts = [transform(t, "" if k is None else str(k), seed, fim_percent, spm_percent) for k, t in zip(keys, b.column(1).to_pylist())]
        columns = [[getattr(c, name) for c in cuts] for name in ("n", "form", "prefix_chars", "middle_chars")]
        arrays = [b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:])), pa.array([c.output for c in cuts], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row: nothing is shuffled."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(keyed, _rows(seed, fim_percent, spm_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.try_element_at(part, F.lit(k)) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


#: DuckDB SQL for op11_fill_middle.
SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
    SELECT *, string_split(t, chr(10)) AS parts, len(string_split(t, chr(10))) - CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 1 ELSE 0 END AS n FROM d
), c AS (
    SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS u1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS u2,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
    SELECT *, CASE WHEN least(u1, u2) = 0 THEN '' WHEN least(u1, u2) = n THEN t ELSE array_to_string(parts[1:least(u1, u2)], chr(10)) || chr(10) END AS prefix,
           CASE WHEN greatest(u1, u2) = 0 THEN '' WHEN greatest(u1, u2) = n THEN t ELSE array_to_string(parts[1:greatest(u1, u2)], chr(10)) || chr(10) END AS head FROM c
), m AS (
    SELECT *, substr(head, length(prefix) + 1) AS middle, substr(t, length(head) + 1) AS suffix FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM m
"""
