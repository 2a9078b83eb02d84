"""A small frontier goes to a label's edges; they are not moved."""

import pytest
from pyspark.sql import functions as F

from trailgraph.operators import graph as graphs, text_index
from trailgraph.plans.execute import follow, follow_many, start
from trailgraph.sources import readers, writers


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    rows = [(f"a{k % 40}", f"b{k % 60}", "r", k) for k in range(900)] + [(f"b{k % 60}", f"c{k % 9}", "s", 1000 + k) for k in range(900)] + [(f"b{k}", f"text {k}", "description", 3000 + k) for k in range(60)]
    folder = f"file://{tmp_path_factory.mktemp('small')}/edges"
    writers.write_sorted_edges(spark.createDataFrame(rows, "src string, dst string, label string, pos long").dropDuplicates(["src", "dst"]).repartition(3), folder)
    return graphs.Graph(readers.read_edges(spark, folder), spark.createDataFrame([("b1", "x")], "name string, node_type string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_stay_where_they_are(spark, graph):
    for path in (["r"], ["r", "s"]):
        plan = plan_of(follow(graph, spark, ["a1"], path))
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(src" not in plan
    assert "Exchange hashpartitioning(src" not in plan_of(follow_many(graph, start(spark, ["a1", "a2"]), ["r"]).own)
    assert {r["node"] for r in follow(graph, spark, ["a1"], ["r", "filter text", "s"]).collect()} == {f"c{k % 9}" for k in range(900) if k % 60 in {j % 60 for j in range(900) if j % 40 == 1}}


def test_start_keeps_its_rows(spark):
    one = start(spark, ["b", "a", "b", "é"], 7)
    assert sorted(map(tuple, one.collect())) == [(7, "a", "a"), (7, "b", "b"), (7, "é", "é")]
    assert start(spark, []).schema == one.schema and start(spark, []).isEmpty()


def test_an_indexs_texts_are_not_moved_to_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 16)
    dealt = []
    before = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda df, *a: dealt.append(a) or before(df, *a))
    index = text_index.build(spark.createDataFrame([(f"n{k:03}", f"text {k}") for k in range(100)], "src string, dst string"), f"file://{tmp_path}/i")
    assert ("block",) not in dealt and len(dealt) == 2  # the texts to their blocks' tasks once, the lists to their buckets
    kept = index.texts().filter(F.col("block") == F.floor(F.col("number") / 16))
    assert [r["number"] for r in kept.sort("src").collect()] == list(range(100))
    assert {r["src"] for r in index.candidates(["text 9"], True).collect()} >= {"n009", *(f"n{k:03}" for k in range(90, 100))}
