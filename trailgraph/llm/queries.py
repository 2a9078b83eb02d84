"""One query an operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.llm import concurrency, exact_dedup, fill_middle, jaccard_join, langid, minhash_dedup, order_minhash, packing, pii, piece_sampling, quotation, token_files, toxicity
from trailgraph.llm.common import shared_folder, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Labelled rows that a classifier is fitted on at most: of each language, and of both classes together.
LANGUAGE_ROWS, TOXICITY_ROWS = 1_000, 20_000


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.round_trips(table(spark, sf_dir, "documents"), PIECES, seed=1, theta=1.0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, LANGUAGE_ROWS))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_files.read_token_files(spark, path)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(table(spark, sf_dir, "documents"))


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotation.reply_order(table(spark, sf_dir, "conversations"))
    return linked.withColumn("own_sha256", F.sha2("own_text", 256)).drop("own_text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), TOXICITY_ROWS)
    return toxicity.score(docs, model).selectExpr("doc_id", "held_out", "score", "predicted", "cast(size(segments) as long) AS n_segments")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, end_id=0, capacity=2048)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)}
    return cut.withColumns(digests).drop("output")


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = concurrency.sale_intervals(*(table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients")))
    return concurrency.concurrency(opened).withColumnsRenamed({"key": "nation_id", "open_amount": "open_cents"})


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_copies(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_piece_sampling": op1_piece_sampling,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_personal_data": op5_personal_data,
    "op6_quotation_links": op6_quotation_links,
    "op7_toxicity": op7_toxicity,
    "op8_order_minhash": op8_order_minhash,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_peak_concurrency": op12_peak_concurrency,
    "op13_minhash_dedup": op13_minhash_dedup,
}

SQL = {"op10_exact_dedup": exact_dedup.SQL, "op11_fill_middle": fill_middle.SQL, "op12_peak_concurrency": concurrency.SQL}
