"""The bucketed store: what it holds, and that hops don't move its edges."""

import random
import re

from pyspark.sql import functions as F

from trailgraph.operators import graph as graphs
from trailgraph.plans.execute import follow_many
from trailgraph.plans.steps import Hop
from trailgraph.plans.execute import advance
from trailgraph.sources import bucketed


def edges_of(spark, n=4000, parts=5):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(300)}'", f"s{rng.randrange(300)}'", rng.choice(["r", "is_x_type", "with 'mark' / %"]), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "src string, dst string, label string, pos long").repartition(parts)


def test_a_store_is_read_whole_by_its_session_and_a_new_one(spark, tmp_path):
    rows, df = edges_of(spark)
    stored = bucketed.write_bucketed(df, f"file://{tmp_path}/it's", "edges_one", 6)
    assert sorted(map(tuple, stored.collect())) == sorted(rows)
    spark.sql("DROP TABLE edges_one")  # the catalog of a new session doesn't know it
    again = bucketed.opened(spark, f"file://{tmp_path}/it's", "edges_one", 6)
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    assert {d.name for d in (tmp_path / "it's").glob("label=*")} and all(len(list(d.glob("*.parquet"))) <= 6 for d in (tmp_path / "it's").glob("label=*"))
    spark.sql("DROP TABLE edges_one")
    assert bucketed.write_bucketed(df.limit(0), f"file://{tmp_path}/none", "edges_none", 3).count() == 0
    spark.sql("DROP TABLE edges_none")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hop_moves_the_frontier_alone(spark, tmp_path):
    rows, df = edges_of(spark)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "-1")
        graph = graphs.Graph.of(bucketed.write_bucketed(df, f"file://{tmp_path}/store", "edges_two", 8))
        frontier = spark.createDataFrame([(0, f"s{k}'", f"s{k}'") for k in range(300)], "query_id long, entity string, node string")
        hop = frontier.join(graph.slice("r"), F.col("node") == F.col("src"))
        plan = plan_of(hop)
        assert len(re.findall(r"Exchange hashpartitioning\(node#", plan)) == 1 and not re.search(r"Exchange hashpartitioning\(src#", plan) and "Bucketed: true" in plan
        assert not re.search(r"Exchange hashpartitioning\(src#", plan_of(advance(graph, frontier, Hop("r"))))
        both = plan_of(bucketed.bucketed_like(frontier, "node", 8).join(graph.slice("r"), F.col("node") == F.col("src")))
        assert "Exchange hashpartitioning(src" not in both and both.count("Exchange hashpartitioning(node") == 1  # the one that was asked for
        got = follow_many(graph, frontier, ["r", "r"]).own
        one = {}
        for s, d, label, _ in rows:
            if label == "r":
                one.setdefault(s, set()).add(d)
        expected = {(e, n) for e in one for n in one[e]} | {(e, n) for e in one for m in one[e] for n in one.get(m, ())}
        assert {(r["entity"], r["node"]) for r in got.collect()} == expected
    finally:
        spark.conf.set(threshold, before)
        spark.sql("DROP TABLE IF EXISTS edges_two")
