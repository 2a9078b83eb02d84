"""The corpus pipeline: documents without toxic texts, exact and near copies and personal data, packed into sequences.

Defined cases, of all stages: an empty table gives an empty one; other columns pass unchanged, whatever their names or
nulls; rows that repeat both id and text are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailgraph.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from trailgraph.llm.common import table, written
from trailgraph.llm.queries import TOXICITY_ROWS, WORD_BPE


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on the labelled documents among them.  Null texts count
    as empty; without labels of both classes nothing goes."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), TOXICITY_ROWS))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts.  Null texts count as empty, a null id is the smallest;
    of rows that share an id only those go whose text another row keeps."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.  Texts without words, and rows with a null id, stay;
    rows of the smallest id all stay."""
    return jaccard_join.drop_near_copies(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks, and ``n_chars`` set anew.  Null texts stay null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: which tokens of which document stand where in which sequence.  A null or empty text is one piece, the
    end id; null ids are ids."""
    return packing.pack_documents(docs, WORD_BPE, end_id=0, capacity=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: The scores, spans and ids of the stages aren't expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k + 1 < len(STAGES) else docs
    return docs
