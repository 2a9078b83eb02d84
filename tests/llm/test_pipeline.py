"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
import pytest

from trailgraph.llm import pii
from trailgraph.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('in')}"
    words = [f"word{i}" for i in range(60)]
    docs = [(k, " ".join(words[(k * 7 + j * (k % 5 + 1)) % 60] for j in range(40)) + (" you idiot scum trash" if k % 4 == 0 else ""), "en", "s", 1) for k in range(120)]
    docs += [(500, "Mail bob@example.org today please my friend", "en", "s", 1), (501, "mail BOB@example.org today please my friend", "en", "s", 1), (600, None, None, None, None)]
    docs += [(700, " ".join(f"long{i}" for i in range(100)), "en", "s", 1), (701, " ".join(f"long{i}" for i in range(99)) + " end", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen.append((name, rows))
        if name != "packing":
            assert docs.columns == columns
    toxic, exact, near, private, packed = (rows for _, rows in seen)
    assert not any(r["text"] and "idiot" in r["text"] for r in toxic) and len(toxic) >= 90
    assert {r["doc_id"] for r in exact} & {500, 501} == {501}
    assert {r["doc_id"] for r in near} & {700, 701} == {700}
    assert any(r["text"] == "mail [EMAIL] today please my friend" for r in private)
    assert all(not pii.plain_spans(r["text"] or "") for r in private)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in private}


def test_run_gives_the_last_stage(spark, tables):
    assert "sequence_id" in corpus_pipeline.run(spark, tables).columns


def test_stages_of_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_of_nulls_ties_and_repeated_rows(spark, tables):
    near = " ".join(f"same{i}" for i in range(60))
    docs = [(None, None, None, None, None), (None, "a null id", "en", "s", 1), (1, None, None, None, 3), (1, "", "", "", 0), (2, near, "en", "s", 1), (2, near, "en", "s", 1), (3, near.upper(), "en", "s", 1), (4, near + " z", "en", "s", 1), (2, "write to x@y.org", "en", "s", 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = spark.createDataFrame(stage(spark, rows, tables).collect(), rows.schema if name != "packing" else None)
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=str) if name != "packing" else rows.collect()
    assert len(kept["toxicity"]) == 9
    # Null and empty texts are equal, and the largest id stays; (2, near) is a copy of 3.
    assert kept["exact_dedup"] == sorted([(None, "a null id"), (1, None), (1, ""), (2, "write to x@y.org"), (3, near.upper()), (4, near + " z")], key=str)
    assert kept["jaccard_join"] == [x for x in kept["exact_dedup"] if x[0] != 4]
    assert (2, "write to [EMAIL]") in kept["personal_data"] and (1, None) in kept["personal_data"]
    assert sorted(str(r["doc_id"]) for r in kept["packing"]) == sorted(str(k) for k, _ in kept["personal_data"])


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
