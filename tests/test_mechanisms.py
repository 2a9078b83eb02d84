"""Path tries, the trigram index and factorised results against plain walks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trailgraph.operators import graph as graphs, text_index
from trailgraph.plans.execute import follow, follow_batch, follow_many, start
from trailgraph.plans.steps import path_trie


def a_graph(spark, seed=1, n=60):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(n)]
    edges = {(a, f"t{k % 3}"): f"is_t{k % 3}_type" for k, a in enumerate(names)}
    for _ in range(5 * n):
        edges[rng.choice(names), rng.choice(names)] = rng.choice(["r", "s", "u"])
    for a in names:
        edges[a, f"{a} {rng.choice(['Red', 'blue', 'GREEN'])} {rng.choice(['ring', 'rod'])}"] = "description"
    rows = [(s, d, label, k) for k, ((s, d), label) in enumerate(edges.items())]
    return graphs.Graph.of(spark.createDataFrame(rows, "src string, dst string, label string, pos long")), names


PATHS = {
    1: ["r", "s"], 2: ["r", "s", "u"], 3: ["r"], 4: ["r", "filter red"], 5: ["r", "filter  RED", "s"], 6: ["is_t1_type", "r"], 7: ["is_t1_type"], 8: [], 9: ["r", "s"],
    10: ["r", "filter red and ring", "u"], 11: ["r", "filter red or ring", "u"], 12: ["none", "r"], 13: ["description", "filter x"],
}


def test_a_trie_has_what_paths_share_once():
    trie = path_trie(PATHS)
    assert len(trie.steps) == 15 and trie.ends[1] == trie.ends[9] and trie.ends[8] == 0
    assert [trie.steps[k - 1].step.label for k in trie.route(trie.ends[2])] == ["r", "s", "u"]
    assert all(s.parent < s.node and s.depth == trie.depth(s.parent) + 1 for s in trie.steps)


def test_batches_by_a_trie_equal_single_paths(spark):
    graph, names = a_graph(spark)
    rng = random.Random(2)
    asked = [(k, rng.choice(names), rng.choice(list(PATHS))) for k in range(60)] + [(60, "nobody", 1), (61, "n1", 1), (62, "n1", 9)]
    got = {}
    for r in follow_batch(graph, spark.createDataFrame(asked, "query_id long, entity string, path_id long"), PATHS).collect():
        got.setdefault(r["query_id"], []).append(r["node"])
    edges = [tuple(r) for r in graph.edges.select("src", "dst", "label").collect()]

    def walked(entity, path):
        at = {entity}
        for step in path:
            if step.startswith("filter"):
                text = step[7:].strip().lower()
                words, test = (text.split(" and "), all) if " and " in text else (text.split(" or "), any)
                at = {s for s, d, label in edges if s in at and label == "description" and test(w in d.lower() for w in words)}
            elif "_type" in step:
                at = {s for s, d, label in edges if s in at and label == step}
            else:
                at = {d for s, d, label in edges if s in at and label == step}
        return sorted(at)

    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, e, p in asked if (w := walked(e, PATHS[p]))}
    assert follow_batch(graph, spark.createDataFrame([], "query_id long, entity string"), {}).count() == 0


WORDS = ["red", "ri", "", "ring", "straße", "日本語", "🙂🙂🙂", "a.b", "x" * 50, "aaaa", "zzz"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = [None, "", "ab", "ABC", "aaa", "STRASSE straße", "日本語の本", "🙂🙂🙂🙂", "x" * 60, "a.b axb"]
    texts += [" ".join(rng.choice(["Red", "ring", "GREEN", "aaaab", "rin", "g"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    rows = [(f"n{k % 90}", t) for k, t in enumerate(texts)] + [("long", "word " * 30_000 + "ring")]
    before, text_index.BLOCK = text_index.BLOCK, 7
    yield rows, text_index.build(spark.createDataFrame(rows, "src string, dst string").repartition(5), f"file://{tmp_path_factory.mktemp('index')}/i")
    text_index.BLOCK = before


@pytest.mark.parametrize("every", [True, False])
def test_candidates_verified_are_what_a_scan_finds(spark, indexed, every):
    rows, index = indexed
    rng = random.Random(4)
    for words in [[w] for w in WORDS] + [rng.sample(WORDS, 2) for _ in range(8)]:
        test = all if every else any
        found = index.candidates(words, every)
        hits = [F.contains(F.lower("dst"), F.lit(w)) for w in words]
        kept = found.filter(F.forall(F.array(*hits), lambda h: h) if every else F.exists(F.array(*hits), lambda h: h))
        expected = sorted((s, t) for s, t in rows if t is not None and test(w in t.lower() for w in words))
        assert sorted(map(tuple, kept.collect())) == expected, words


def test_the_index_reads_its_candidates_alone(spark, indexed):
    rows, index = indexed
    assert index.candidates(["straße"], True).count() == 1 and index.candidates(["qqq"], True).count() == 0
    assert index.candidates(["st", "aße"], True).count() == 1  # the short word is left to the verification
    assert index.candidates(["st", "aße"], False).count() == len(rows)
    plan = index.candidates(["ring"], True)._jdf.queryExecution().executedPlan().toString()
    assert "bucket IN" in plan.replace("bucket#", "bucket IN #") and "dynamicpruning" in plan.lower()


def test_filters_by_the_index_equal_filters_by_scan(spark, tmp_path):
    graph, names = a_graph(spark, 5)
    index = text_index.build(graph.descriptions(), f"file://{tmp_path}/i")
    by_index = graphs.Graph(graph.edges, graph.types, index)
    for path in (["is_t1_type", "filter red"], ["r", "filter red and ring", "s"], ["r", "filter re or rod"], ["is_t2_type", "filter n1"]):
        entity = [] if "_type" in path[0] else [names[7]]
        assert sorted(r["node"] for r in follow(by_index, spark, entity, path).collect()) == sorted(r["node"] for r in follow(graph, spark, entity, path).collect())


def test_many_entities_after_a_type_seed_are_planned_at_once(spark):
    graph, names = a_graph(spark)
    entities = [*names, *(f"e{k}" for k in range(20_000))]
    state = spark.range(len(entities)).join(spark.createDataFrame(list(enumerate(entities)), "id long, name string"), "id").selectExpr("0L AS query_id", "name AS entity", "name AS node")
    began = time.perf_counter()
    out = follow_many(graph, state, ["r", "is_t1_type", "r", "exec_common t1", "exec_difference t0"])
    out.results._jdf.queryExecution().optimizedPlan()
    assert time.perf_counter() - began < 20
    after = {r["node"] for r in out.shared.collect()}
    small = follow_many(graph, start(spark, names[:3]), ["r", "is_t1_type", "r", "exec_common t1", "exec_difference t0"])
    assert {r["node"] for r in small.shared.collect()} == after
    before = {(r["entity"], r["node"]) for r in small.own.collect()}
    assert {(r["entity"], r["node"]) for r in small.results.collect()} == before | {(e, n) for e in names[:3] for n in after}
    types = {r["name"]: r["node_type"] for r in graph.types.collect()}
    reach = {n: {e for e in names[:3] if n in after or (e, n) in before} for n in after | {n for _, n in before}}
    assert {r["node"] for r in small.combined[4].collect()} == {n for n, e in reach.items() if types.get(n) == "t1" and len(e) == 3}
    assert {r["node"] for r in small.combined[5].collect()} == {n for n, e in reach.items() if types.get(n) == "t0" and len(e) % 2 == 1}
    assert out.results.count() == len(after) * len(entities) + out.own.join(spark.createDataFrame([(n,) for n in after], "node string"), "node", "left_anti").count()
