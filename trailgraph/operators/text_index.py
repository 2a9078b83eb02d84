"""Posting lists of trigrams, for keyword filters that don't read all descriptions.

Descriptions are numbered by ranges of their node, and kept in blocks of ``BLOCK`` numbers.  A trigram's posting list is
cut by block: sorted numbers within the block, so that a list has rows of bounded size however common the trigram is.
Lists are stored by a bucket of the trigram, and in its order, so that a look-up reads a few row groups.

A text that holds a word holds all its trigrams.  So a word's candidates are the intersection of its trigrams' lists,
block by block; words are intersected ("and") or united ("or").  Candidates are then verified on their text.  Words of
fewer than three characters have no trigram: "and" goes by the other words, and where nothing is left all descriptions
are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgraph.storage import stored

BLOCK, BUCKETS, GRAM = 1 << 15, 64, 3
_POSTINGS = "gram string, block long, numbers array<int>, bucket int"
_TEXTS = "number long, src string, dst string, block long"


def grams(text: Column) -> Column:
    """The different trigrams of a text in lower case, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def numbered(descriptions: DataFrame) -> DataFrame:
    """``number, block, src, dst``: numbers from 0 in order of the node, by ranges: no task sees all."""
    placed = stored(descriptions.select("src", "dst").sort("src", "dst").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a range
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    number = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), part == F.col("part")).select(number.alias("number"), F.floor(number / F.lit(BLOCK)).alias("block"), "src", "dst")


def build(descriptions: DataFrame, path: str) -> "TextIndex":
    """Writes the index of ``src, dst`` (node and text) below ``path``."""
    texts = f"{path}/texts"
    # Numbers go by ranges: a task has few blocks, in their order, and no text is moved for it.
    numbered(descriptions).write.partitionBy("block").option("compression", "zstd").mode("overwrite").parquet(texts)
    spark = descriptions.sparkSession
    # A block's lists are one task's: its texts are dealt, and neither their trigrams nor lists in parts.  The number is stated, so that
    # small texts, which have many trigrams, aren't put together in few tasks.
    kept = spark.read.schema(_TEXTS).parquet(texts)
    blocks = kept.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    each = kept.repartition(max(blocks, spark.sparkContext.defaultParallelism), "block").select("block", (F.col("number") % BLOCK).cast("int").alias("at"), F.explode(grams(F.col("dst"))).alias("gram"))
    lists = each.groupBy("gram", "block").agg(F.sort_array(F.collect_list("at")).alias("numbers")).withColumn("bucket", _bucket(F.col("gram")))
    lists.repartition("bucket").sortWithinPartitions("gram", "block").write.partitionBy("bucket").option("compression", "zstd").mode("overwrite").parquet(f"{path}/postings")
    return TextIndex(spark, path)


@dataclass
class TextIndex:
    """An index that ``build`` wrote."""

    spark: SparkSession
    path: str

    def texts(self) -> DataFrame:
        return self.spark.read.schema(_TEXTS).parquet(f"{self.path}/texts")

    def postings(self, wanted: Sequence[str]) -> DataFrame:
        """``gram, block, numbers`` of the stated trigrams: their buckets' directories alone."""
        buckets = sorted({crc32(g.encode()) % BUCKETS for g in wanted})
        lists = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")
        return lists.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(list(wanted))).select("gram", "block", "numbers")

    def with_all(self, wanted: Sequence[str]) -> DataFrame:
        """``block, numbers``: the texts that have all of the trigrams; a block without one of them has none."""
        met = self.postings(wanted).groupBy("block").agg(F.collect_list("numbers").alias("lists")).filter(F.size("lists") == len(wanted))
        both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1), lambda kept, more: F.array_intersect(kept, more))
        return met.select("block", both.alias("numbers")).filter(F.size("numbers") > 0)

    def candidates(self, words: Sequence[str], every: bool) -> DataFrame:
        """``src, dst`` of a superset of the descriptions that have all, or any, of the words; words are in lower case."""
        of_words = [word_grams(w) for w in words]
        if not of_words or (not any(of_words) if every else not all(of_words)):
            return self.texts().select("src", "dst")
        if every:
            found = self.with_all(sorted(set().union(*of_words)))
        else:
            found = reduce(DataFrame.unionByName, [self.with_all(sorted(set(g))) for g in of_words])
        each = found.select(F.col("block").alias("of_block"), F.explode("numbers").alias("at"))
        numbers = each.select("of_block", (F.col("of_block") * BLOCK + F.col("at")).alias("of_number")).distinct()
        return self.texts().join(numbers, (F.col("block") == F.col("of_block")) & (F.col("number") == F.col("of_number"))).select("src", "dst")


def word_grams(word: str) -> list[str]:
    return [word[k : k + GRAM] for k in range(len(word) - GRAM + 1)]
