"""A batch of paths keeps who is at a node as a list: no row a pair is dealt where they are counted alone."""

import random
import re

import pytest

from trailgraph.operators import graph as graphs
from trailgraph.plans import execute
from trailgraph.plans.execute import count_batch, follow_batch

PATHS = {0: ["r"], 1: ["r", "r"], 2: ["r", "filter red", "s"], 3: ["r", "filter RED", "s"], 4: ["is_x_type", "s"], 5: []}


@pytest.mark.parametrize("block", [2, 1 << 18])
def test_counts_are_those_of_the_batch(spark, monkeypatch, block):
    monkeypatch.setattr(execute, "BLOCK", block)
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("rs"), k) for k in range(90)]
    rows += [(f"n{k}", "a red one" if k % 2 else "blue", "description", 100 + k) for k in range(12)] + [(f"n{k}", "x", "is_x_type", 200 + k) for k in range(0, 12, 3)]
    graph = graphs.Graph.of(spark.createDataFrame(rows, "src string, dst string, label string, pos long"))
    asked = [(f"n{e}", p) for e in range(13) for p in PATHS if rng.random() < 0.7]
    queries = spark.createDataFrame([(k, e, p) for k, (e, p) in enumerate(asked)], "query_id long, entity string, path_id long")
    path_of = dict(enumerate(p for _, p in asked))
    expected: dict[tuple, int] = {}
    for r in follow_batch(graph, queries, PATHS).collect():
        key = (path_of[r["query_id"]], r["node"])
        expected[key] = expected.get(key, 0) + 1
    got = count_batch(graph, queries.select("path_id", "entity").union(queries.select("path_id", "entity")), PATHS)
    assert {(r["path_id"], r["node"]): r["n"] for r in got.collect()} == expected and len(expected) > 20


def test_no_pair_is_dealt_to_be_counted(spark):
    graph = graphs.Graph.of(spark.createDataFrame([(f"a{k % 5}", f"b{k % 7}", "r", k) for k in range(35)], "src string, dst string, label string, pos long"))
    asked = spark.createDataFrame([(0, f"a{k}") for k in range(5)], "path_id long, entity string")
    plan = count_batch(graph, asked, {0: ["r"]})._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*(entity|query_id|number)#[^)]*node#", plan) and "explode(who" not in plan
