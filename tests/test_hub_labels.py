"""Histograms: edges into few targets are counted before they are dealt, and the others meet their types without a sort."""

import random
import re

from pyspark.sql import functions as F

from trailgraph.operators import graph as graphs

FIELDS = "src string, dst string, label string, pos long"


def plain(graph):
    typed = graph.edges.filter("label <> ''").join(graph.types, F.col("dst") == F.col("name"), "left").withColumn("target_type", F.coalesce("node_type", "dst")).filter("target_type <> ''")
    return typed.groupBy("label", "target_type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def rows_of(df):
    return sorted(map(repr, df.select("label", "target_type", "n", "first_pos").collect()))


def graph_of(spark, n=3000):
    rng = random.Random(3)
    rows = [(f"a{k}", f"b{rng.randrange(n)}", "r", k) for k in range(n)] + [(f"a{k}", rng.choice(["b1", "b2", "x", ""]), "hub", n + k) for k in range(n)]
    rows += [(f"b{k}", "xy"[k % 2], f"is_{'xy'[k % 2]}_type", 2 * n + k) for k in range(0, n, 3)] + [("a", "b1", None, 3 * n), ("a", "b2", "", 3 * n + 1)]
    return graphs.Graph.of(spark.createDataFrame(rows, FIELDS).repartition(3))


def test_counts_do_not_depend_on_the_way(spark, monkeypatch):
    graph = graph_of(spark)
    assert set(graphs.hub_labels(graph.edges.filter("label <> ''"))) == {"hub", "is_x_type", "is_y_type"}
    expected = rows_of(plain(graph))
    assert rows_of(graphs.relation_histogram(graph)) == expected
    for edges, targets in ((8, 0), (8, 2), (0, 1 << 20)):  # no label, two labels, all labels
        monkeypatch.setattr(graphs, "HUB_EDGES", edges)
        monkeypatch.setattr(graphs, "HUB_TARGETS", targets)
        assert rows_of(graphs.relation_histogram(graph)) == expected
    none = graphs.Graph(graph.edges.limit(0), graph.types)
    assert graphs.hub_labels(none.edges) == [] and graphs.relation_histogram(none).isEmpty()


def test_hubs_are_counted_first_and_nothing_is_sorted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = graphs.relation_histogram(graph_of(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    joined = plan.index("ShuffledHashJoin")
    assert re.search(r"HashAggregate\(keys=\[label#\d+, dst#\d+", plan[joined:])  # below the join
