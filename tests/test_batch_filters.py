"""Filters of a batch: what goes to the frontier are the steps that a description meets, not its text."""

import re

from trailgraph.operators import graph as graphs
from trailgraph.plans import execute
from trailgraph.plans.execute import count_batch, follow, follow_batch

PATHS = {0: ["r", "filter red"], 1: ["r", "filter red and ring"], 2: ["r", "filter ring or %"], 3: ["r", "filter RED", "r"], 4: ["filter red"], 5: ["r", "filter none"]}


def test_filters_of_a_batch(spark, monkeypatch):
    rows = [(f"n{k}", f"n{j}", "r", 10 * k + j) for k in range(6) for j in range(6) if (k + j) % 3] + [(f"n{k}", t, "description", 100 + k) for k, t in enumerate(["a red ring", "Red", "RING", "50 %", "_"])]
    rows += [("n0", "red again", "description", 200)]
    graph = graphs.Graph.of(spark.createDataFrame(rows, "src string, dst string, label string, pos long"))
    asked = spark.createDataFrame([(k, f"n{e}") for k in PATHS for e in range(3)], "path_id long, entity string")
    expected = {(e, k, r["node"]) for k, p in PATHS.items() for e in range(3) for r in follow(graph, spark, [f"n{e}"], p).collect()}
    queries = asked.selectExpr("path_id * 10 + cast(substr(entity, 2) AS long) AS query_id", "entity", "path_id")
    got = follow_batch(graph, queries, PATHS).collect()
    assert {(r["query_id"] % 10, r["query_id"] // 10, r["node"]) for r in got} == expected and len(got) == len(expected)
    counted = {(r["path_id"], r["node"]): r["n"] for r in count_batch(graph, asked, PATHS).collect()}
    assert counted == {(k, n): sum((e, k, n) in expected for e in range(3)) for _, k, n in expected}

    plans = []
    before = execute.stored
    monkeypatch.setattr(execute, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df))
    plans.append(count_batch(graph, asked, PATHS)._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "LeftSemi" in line]
    assert joins and not any("dst" in line or "words" in line for line in joins)
    assert all(re.search(r"\[next#\d+, node#\d+\]|\[node#\d+, next#\d+\]", line) for line in joins)
