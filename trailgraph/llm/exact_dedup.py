"""Exact deduplication with two Bloom passes, by DataFrame functions alone.

Pass 1 counts, for each bit of a Bloom filter, the rows that set it, and keeps the bits set by two rows or more.  A text
that occurs twice sets all its bits twice, so pass 2 looks up every row's bits: a row with a bit that only it set is
unlike every other row and passes straight through.  Only the possibly repeated rows are shuffled and grouped, as
(digest, id): no text is ever shuffled.

Rows are worked on in slices by hash, ``SLICE_ROWS`` at a time on average, so that a slice's filter can be broadcast
whatever the number of rows.  A digest that very many rows have is not one task's: the rows stay where they are and meet
its group by broadcast.

Defined cases: null text counts as empty; an empty table gives an empty result; a null id is the smallest id; rows that
repeat both id and text count in ``group_size`` and are all kept or all dropped; rows of one id, null too, with different
texts are kept or dropped each; columns other than the two named are ignored, whatever their names (``exact_dedup`` keeps
them).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.bits import bit_filter, chunks_for, with_held, without
from trailgraph.llm.common import discard, join_counted, written
from trailgraph.storage import stored, working_folder

#: Rows of one slice: a filter of 64 MB.
SLICE_ROWS = 1 << 25


def normalised(text: Column) -> Column:
    """A-Z lowered, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: ``doc_id``, ``text_sha256``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))


def _marked(rows: DataFrame, n: int) -> DataFrame:
    key, chunks = [F.col("text_sha256")], chunks_for(n)
    return with_held(rows, key, bit_filter(rows, key, chunks, least=2), chunks, "maybe")


def possibly_repeated(rows: DataFrame) -> DataFrame:
    """Adds ``maybe`` to ``doc_id, text_sha256``, a written table: whether two rows or more set each of the row's bits."""
    n = rows.count()
    slices = -(-n // SLICE_ROWS)
    if slices <= 1:
        return written(_marked(rows, n))
    sliced = stored(rows.withColumn("slice", F.pmod(F.xxhash64("text_sha256", F.lit(9)), F.lit(slices))), by="slice")
    folder = working_folder(rows.sparkSession)
    for k in range(slices):
        _marked(sliced.filter(F.col("slice") == k).drop("slice"), n // slices).write.mode("append").parquet(folder)
    discard(sliced)
    return rows.sparkSession.read.schema(_marked(rows, 1).schema).parquet(folder)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; of equal texts the largest id stays."""
    rows = written(digests(docs, id_col, text_col))
    marked = possibly_repeated(rows)
    discard(rows)
    single = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    again = marked.filter("maybe").select("doc_id", "text_sha256")
    groups = written(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    grouped = join_counted(again, groups, "text_sha256", "group_size").select("doc_id", "keep_id", "group_size", "text_sha256")
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    dropped = written(exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select("doc_id", "text_sha256").distinct())
    return without(docs, [docs[id_col], F.sha2(normalised(docs[text_col]), 256)], dropped)


#: DuckDB SQL for op10_exact_dedup.
SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
