"""What grows with the tables is dealt, kept small and read where it is needed alone."""

import re

import pytest
from pyspark.sql import functions as F

from trailgraph.operators import expand, graph as graphs, text_index
from trailgraph.sources.readers import keyed_objects
from trailgraph.streaming import edges as streaming
from trailgraph.streaming.edges import EdgeStore, RelationStore, merged, merged_by_number

TEMPLATE = "section string, idx int, question string, path array<string>, target array<string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_types_are_of_the_labels_that_templates_name(spark):
    rows = [("a", "b", "r", 1), ("b", "x", "is_x_type", 2), ("a", "c", "sel b", 3), ("c", "y", "is_y_type", 4), ("a", "c", "unused", 5), ("a", "b", "sel", 6)]
    edges = spark.createDataFrame(rows, "src string, dst string, label string, pos long")
    templates = spark.createDataFrame([("s", 0, "q", ["r", "none"], ["t"]), ("s", 1, "q", ["sel <<x>>", "is_x_type"], ["t"])], TEMPLATE)
    assert expand.asked_steps(templates) == (["is_x_type", "none", "r"], ["sel "])
    graph = graphs.Graph.of(edges)
    tops = expand.top_types(graph, templates).collect()
    whole = {r["label"]: r["top_type"] for r in graphs.relation_top_type(graphs.relation_histogram(graph)).collect()}
    assert [r["tops"] for r in tops] == [{k: whole[k] for k in ("r", "sel b", "is_x_type")}]
    other = spark.createDataFrame([("s", 0, "q", ["unused"], ["t"])], TEMPLATE)
    assert expand.top_types(graph, other).first()["tops"] == {"unused": whole["unused"]}  # not what was kept for others
    assert expand.top_types(graph, other.limit(0)).first()["tops"] == {}


def test_a_blocks_posting_lists_are_one_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 5)
    spark.sparkContext.setJobGroup("index", "index")
    index = text_index.build(spark.createDataFrame([(f"n{k}", f"text {k}") for k in range(60)], "src string, dst string"), f"file://{tmp_path}/i")
    tracker, tasks = spark.sparkContext.statusTracker(), []
    for job in tracker.getJobIdsForGroup("index"):
        tasks += [tracker.getStageInfo(k).numTasks for k in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(k)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 12 in tasks  # as many as blocks
    assert index.postings(["tex"]).agg(F.sum(F.size("numbers"))).first()[0] == 60


def test_deltas_are_written_as_they_come_and_merged_by_hash(spark, tmp_path):
    rows = [("a", "b", "r", 5), ("a", "b", None, 7), ("a", "b", "s", 7), ("c", "d", "r", 1), ("c", "d", "q", 0)]
    edges = spark.createDataFrame(rows, "src string, dst string, label string, seq long")
    store = EdgeStore(spark, f"file://{tmp_path}/s")
    store.upsert(edges, 0)
    assert store.partial().count() == 5
    partial = store.partial().unionByName(spark.createDataFrame([("a", "b", "r", 2, 1), ("e", "f", "r", 3, 2)], streaming.PARTIAL))
    plan = plan_of(merged_by_number(partial))
    assert "SortAggregate" not in plan and len(re.findall(r"Exchange hashpartitioning\(src#", plan)) == 1
    assert sorted(map(repr, merged_by_number(partial).collect())) == sorted(map(repr, merged(partial).collect()))
    for odd in (-1, 1 << 62):  # places that can't be packed
        far = partial.unionByName(spark.createDataFrame([("e", "f", "z", odd, odd)], streaming.PARTIAL))
        assert sorted(map(repr, merged_by_number(far).collect())) == sorted(map(repr, merged(far).collect()))
    store.compact()
    store.upsert(edges.withColumn("seq", F.col("seq") + 1), 1)
    assert sorted(map(tuple, store.edges().collect())) == [("a", "b", "s", 5), ("c", "d", "r", 0)]


def test_a_relationship_is_one_row_and_none_before_it_is_resolved(spark, tmp_path):
    store = RelationStore(spark, f"file://{tmp_path}/r")
    rels = spark.createDataFrame([(f"a--{k}", f"b--{k}", "uses", 2 * k) for k in range(9)], "source_ref string, target_ref string, relation string, seq long")
    names = "id string, name string, at long"
    store.add(rels, spark.createDataFrame([(f"a--{k}", f"a{k}", 1) for k in range(9)], names), 0)
    assert store.resolved.read(streaming.RESOLVED, [0]).count() == 0
    store.add(rels.limit(1), spark.createDataFrame([(f"b--{k}", f"b{k}", 1) for k in range(9)], names), 1)
    assert store.resolved.read(streaming.RESOLVED, [1]).count() == 9 and store.edges().count() == 18
    store.add(rels.limit(0), spark.createDataFrame([("a--3", "", 2)], names), 2)
    assert store.edges().count() == 16


def test_objects_are_dealt_before_they_are_parsed(spark):
    made = spark.range(40, numPartitions=1).selectExpr("id % 2 AS file_ord", "id AS obj_pos", """concat('{"id":"x--', id, '","type":"t","name":"n"}') AS object""")
    keyed = keyed_objects(made)
    plan = plan_of(keyed)
    assert plan.count("hashpartitioning(file_ord") == 1 and plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("hashpartitioning(file_ord")  # nothing is parsed before
    assert keyed.count() == 40
