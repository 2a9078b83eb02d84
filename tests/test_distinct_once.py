"""Several entities: results are dealt once by entity and node, and not again where no hop is shared."""

import re

from pyspark.sql import functions as F

from trailgraph.operators import graph as graphs
from trailgraph.plans.execute import follow_many, start


def test_results_are_dealt_once(spark):
    rows = [(f"a{k % 5}", f"b{k % 7}", "r", k) for k in range(35)] + [(f"b{k % 7}", f"c{k % 3}", "s", 100 + k) for k in range(21)] + [(f"a{k}", "x", "is_x_type", 200 + k) for k in range(5)]
    graph = graphs.Graph.of(spark.createDataFrame(rows, "src string, dst string, label string, pos long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = follow_many(graph, start(spark, ["a0", "a1"]), ["r", "s"])
        plan = out.results._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+L, entity#\d+, node#\d+", plan)) == 3  # the results', and the first frontier's, which is there twice
        assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L, entity#\d+, node_type", plan)
        got = sorted(map(repr, out.results.collect()))
        assert len(got) == len(set(got)) == 2 * (7 + 3)
        assert {r["node_type"] for r in follow_many(graph, start(spark, ["a0"]), ["r", "is_x_type", "r"]).results.select(F.col("node_type")).collect()} == {None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
