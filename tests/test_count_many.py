"""Counts over all hops by lists: the same as over the results' rows, and no row for an entity and a node of the last hop."""

import random

import pytest
from pyspark.sql import functions as F

from trailgraph.operators import graph as graphs
from trailgraph.plans import execute
from trailgraph.plans.execute import count_many, follow_many

FIELDS = "src string, dst string, label string, pos long"


@pytest.fixture(scope="module")
def graph(spark):
    """Hops that come back to nodes of earlier ones; two types and nodes without one."""
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice("rst"), k) for k in range(900)]
    rows += [(f"n{k}", "xy"[k % 2], f"is_{'xy'[k % 2]}_type", 1000 + k) for k in range(40)] + [(f"n{k}", "a red one", "description", 2000 + k) for k in range(0, 60, 3)]
    return graphs.Graph.of(graphs.canonical(spark.createDataFrame(rows, FIELDS).withColumnRenamed("pos", "seq")))


@pytest.mark.parametrize("listed, path", [(1 << 22, ["r"]), (1 << 22, ["r", "s", "t"]), (90, ["r", "s", "t"]), (0, ["r", "s"]), (90, ["r", "filter red", "r", "filter red"]), (1 << 22, ["select <<x>>", "r", "r", "exec_common x"]), (0, ["filter red"]), (1 << 22, ["r", "is_x_type", "s"]), (1 << 22, ["r", "none"])])
def test_counts_are_those_of_the_results(spark, graph, monkeypatch, listed, path):
    monkeypatch.setattr(execute, "LISTED", listed)
    monkeypatch.setattr(execute, "BLOCK", 7)
    state = spark.createDataFrame([(k % 2, f"n{k}", f"n{k}") for k in range(25)] + [(0, "n0", "n5"), (0, "n0", "n5"), (1, "lost", "lost")], "query_id long, entity string, node string")
    expected = follow_many(graph, state, path).results.groupBy("query_id", "entity", "node_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(repr, count_many(graph, state, path).collect())) == sorted(map(repr, expected.select("query_id", "entity", "node_type", "n").collect()))


def test_no_row_is_made_for_an_entity_and_a_node(spark):
    rows = [(f"a{k}", f"b{j}", "r", 100 * k + j) for k in range(20) for j in range(10)] + [(f"b{j}", f"c{i}", "s", 10000 + 100 * j + i) for j in range(10) for i in range(50)]
    graph = graphs.Graph.of(spark.createDataFrame(rows, FIELDS))
    state = spark.createDataFrame([(0, f"a{k}", f"a{k}") for k in range(20)], "query_id long, entity string, node string")
    counted = count_many(graph, state, ["r", "s"])
    assert {r["n"] for r in counted.collect()} == {60} and counted.count() == 20
    exchanges = [line for line in counted._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert any("(query_id#" in line and "entity#" in line and "node#" not in line for line in exchanges)  # the lists, dealt to the entities
    rows = follow_many(graph, state, ["r", "s"]).results
    assert rows.count() == 20 * 60 and {r["n"] for r in count_many(graph, state, ["r"]).collect()} == {10}
