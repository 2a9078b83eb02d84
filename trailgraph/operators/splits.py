"""Sections, stratified splits, distributions, target updates and chat records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_ratios(train: float, validation: float, test: float) -> None:
    if not math.isclose(train + validation + test, 1.0, abs_tol=1e-6) or not all(0 <= r <= 1 for r in (train, validation, test)):
        raise ValueError("ratios must be in [0, 1] and sum to 1")


def with_sections(rows: DataFrame, sections: DataFrame, drop_unmapped: bool = True) -> DataFrame:
    """Adds ``section`` by ``question`` (the last section of a question wins); unmapped rows go, or are "Unknown"."""
    last = sections.groupBy(F.col("question").alias("__question")).agg(F.max_by("section", F.struct("ord", "section")).alias("section"))
    joined = rows.drop("section").join(last, F.col("question") == F.col("__question"), "left").drop("__question")
    return joined.filter("section is not null") if drop_unmapped else joined.withColumn("section", F.coalesce("section", F.lit("Unknown")))


def held_out_sizes(n: Column, train: float, validation: float, test: float) -> tuple[Column, Column]:
    """Rows for validation and test of a section of n: 0 and 1 keep all for training, 2 give one to test, one held-out row
    goes to validation; else test takes its share rounded up, but leaves validation one if that has a share."""
    if validation + test == 0:
        return F.lit(0).cast("long"), F.lit(0).cast("long")
    held = F.ceil(F.lit(1.0 - train) * n)
    share = F.ceil(F.lit(test / (validation + test)) * held)
    share = F.least(share, held - 1) if validation > 0 else share
    test_n = F.when(n <= 1, 0).when(n == 2, 1).when(held <= 1, 0).otherwise(share)
    validation_n = F.when(n <= 2, 0).when(held <= 1, held).otherwise(held - share)
    return validation_n.cast("long"), test_n.cast("long")


def ranked(rows: DataFrame, groups: list[str], digest: Column, *ties: str) -> DataFrame:
    """Adds ``rank_in_group`` (from 1, by the hex digest, then the ties) and ``rows_in_group``.

    A row's rank is its rank within a (group, leading hash byte), plus the rows of the bytes before: a group that holds
    most rows is ranked by 256 tasks, and the offsets are 256 counts a group.
    """
    marked = rows.withColumn("__digest", digest).withColumn("__byte", F.substring("__digest", 1, 2))
    of = {g: f"__of_{k}" for k, g in enumerate(groups)}
    counts = marked.groupBy(*[F.col(g).alias(o) for g, o in of.items()], F.col("__byte").alias("__of_byte")).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*of.values())
    places = counts.select(*of.values(), "__of_byte", (F.sum("__n").over(whole.orderBy("__of_byte")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias("rows_in_group"))
    own = Window.partitionBy(*groups, "__byte").orderBy("__digest", *ties)
    same = F.col("__byte") == F.col("__of_byte")
    for g, o in of.items():
        same = same & F.col(g).eqNullSafe(F.col(o))
    placed = marked.withColumn("__rank", F.row_number().over(own)).join(places, same)
    return placed.withColumn("rank_in_group", F.col("__rank") + F.col("__before")).drop("__digest", "__byte", "__rank", "__of_byte", "__before", *of.values())


def split(rows: DataFrame, train: float = 0.80, validation: float = 0.05, test: float = 0.15, seed: int = 42, key: str = "question", section: str = "section") -> DataFrame:
    """Adds ``split``.  In each section rows are ordered by md5 of seed and key: validation, test, then training."""
    check_ratios(train, validation, test)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key), F.lit(""))))
    placed = ranked(rows, [section], digest, key)
    n_validation, n_test = held_out_sizes(F.col("rows_in_group"), train, validation, test)
    rank = F.col("rank_in_group")
    return placed.withColumn("split", F.when(rank <= n_validation, "validation").when(rank <= n_validation + n_test, "test").otherwise("train")).drop("rank_in_group", "rows_in_group")


def distribution(rows: DataFrame) -> DataFrame:
    """``split, section, n, percent``."""
    n = rows.groupBy("split", "section").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def unmapped(rows: DataFrame) -> DataFrame:
    """``scanned, unmapped`` of rows with a section column."""
    return rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("section").isNull()).alias("unmapped"))


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows.dropna(subset=columns)


def update_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Replaces ``target`` by the question's new one, where that is not empty; ``updated`` tells where it differs."""
    new = targets.select(F.col("question").alias("__question"), F.col("new_target").alias("__target"))
    joined = rows.join(new, F.col("question") == F.col("__question"), "left")
    changed = F.col("__target").isNotNull() & (F.col("__target") != "") & ~F.col("__target").eqNullSafe(F.col("target"))
    return joined.withColumn("updated", changed).withColumn("target", F.when(changed, F.col("__target")).otherwise(F.col("target"))).drop("__question", "__target")


def update_counts(rows: DataFrame) -> DataFrame:
    """``scanned, updated`` of updated rows."""
    return rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("updated").alias("updated"))


def chat_records(rows: DataFrame, system: str) -> DataFrame:
    """``messages``: system, human, gpt turns of each (question, path)."""
    turns = [("system", F.lit(system)), ("human", F.col("question")), ("gpt", F.col("path"))]
    return rows.withColumn("messages", F.array(*[F.struct(F.lit(who).alias("from"), value.alias("value")) for who, value in turns]))


def section_counts(items: DataFrame, sections: DataFrame) -> DataFrame:
    """``section, n`` of every section, those without an item too."""
    n = items.groupBy(F.col("section").alias("of_section")).agg(F.count(F.lit(1)).alias("n"))
    return sections.select("section").distinct().join(n, F.col("section") == F.col("of_section"), "left").select("section", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
