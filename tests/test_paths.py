"""Paths over the graph: hand-made cases, and an independent set model on random graphs."""

import json
import random

import pytest

from trailgraph.operators import bundles, graph as graphs
from trailgraph.plans import steps as S
from trailgraph.plans.execute import follow, follow_batch, follow_many, start, trace
from trailgraph.sources import readers

A = {"objects": [
    {"type": "malware", "id": "malware--1", "name": "RedFox", "description": "RedFox is a worm. It spreads.", "is_family": True, "platforms": ["Windows", "Linux"], "revoked": False, "deprecated": False},
    {"type": "attack-pattern", "id": "attack-pattern--1", "name": "Mail Lure", "description": "Abuses Office files (macro). More.", "tags": []},
    {"type": "course-of-action", "id": "course-of-action--1", "name": "Mail Quarantine", "description": "Hold mail."},
    {"type": "relationship", "id": "relationship--1", "source_ref": "malware--1", "target_ref": "attack-pattern--1", "relationship_type": "uses"},
    {"type": "relationship", "id": "relationship--2", "source_ref": "course-of-action--1", "target_ref": "attack-pattern--1", "relationship_type": "mitigates"},
    {"type": "relationship", "id": "relationship--3", "source_ref": "malware--1", "target_ref": "tool--404", "relationship_type": "uses"},
    {"type": "marking-definition", "id": "marking-definition--1"}, {"name": "no id"},
]}
B = {"objects": [
    {"type": "malware", "id": "malware--2", "name": "BlueJay", "description": "BlueJay is a backdoor."},
    {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Disk Wipe", "description": "Erases disks."},
    {"type": "relationship", "id": "relationship--4", "source_ref": "malware--2", "target_ref": "attack-pattern--1", "relationship_type": "uses"},
    {"type": "relationship", "id": "relationship--5", "source_ref": "malware--2", "target_ref": "attack-pattern--2", "relationship_type": "uses"},
]}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bundles")
    (folder / "sub").mkdir()
    (folder / "a.json").write_text(json.dumps(A, indent=4))
    (folder / "sub" / "b.json").write_text(json.dumps(B, indent=2))
    (folder / "broken.json").write_text('{"objects": [')
    (folder / "other.txt").write_text(json.dumps(B))
    return bundles.bundle_edges(readers.read_bundles(spark, str(folder))).cache()


@pytest.fixture(scope="module")
def graph(raw):
    made = graphs.Graph.of(graphs.canonical(raw).cache())
    made.types.cache()
    return made


def test_bundle_edges(raw, graph):
    edges = {(r["src"], r["dst"]): (r["label"], r["pos"]) for r in graph.edges.collect()}
    labels = {k: v[0] for k, v in edges.items()}
    assert labels["Mail Lure", "attack_pattern"] == "is_attack_pattern_type"
    assert labels["RedFox", "Windows"] == "platforms" and ("RedFox", "Linux") not in labels
    assert labels["Mail Lure", "Not Available"] == "tags" and labels["RedFox", "True"] == "is_family"
    assert labels["RedFox", "False"] == "deprecated"
    assert edges["RedFox", "False"][1] == min(r["seq"] for r in raw.filter("label = 'revoked'").collect())
    assert labels["RedFox", "Mail Lure"] == "uses_attack_pattern" and labels["Mail Lure", "RedFox"] == "used_by_malware"
    assert labels["Mail Lure", "Mail Quarantine"] == "mitigated_by" and not any("404" in k[1] for k in labels)


VALUES = {
    "link": "[BlackFox](https://example.org/S1) is a worm.", "open": "[", "word": "true", "quoted": '["a"]', "none": None, "yes": True, "no": [False], "empty": [], "deep": [[["[x", 2], 1]],
    "nothing": [None], "hollow": [[]], "number": 12, "share": 1.5, "object": {"z": 1, "a": [1, {"q": 'x, y: "z"', "n": None}], "e": {}, "é": True}, "objects": [{"k": "a:b,c"}, {"k": 2}], "blank": "",
}


def python_text(value):
    while isinstance(value, list):
        if not value:
            return "Not Available"
        value = value[0]
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else str(value)


@pytest.mark.parametrize("indent", [None, 4])
def test_values_as_python_spells_them(spark, indent):
    text = json.dumps({"id": "m--1", "type": "m", "name": "N", **VALUES}, indent=indent, ensure_ascii=False)
    objects = readers.keyed_objects(spark.createDataFrame([(0, 0, text)], "file_ord int, obj_pos int, object string"))
    got = {r["label"]: r["dst"] for r in bundles.attribute_edges(objects).collect()}
    assert got == {"is_m_type": "m", "name": "N", **{k: python_text(v) for k, v in VALUES.items()}}
    order = [r["label"] for r in bundles.attribute_edges(objects).orderBy("seq").collect()]
    assert order == ["is_m_type", "name", *VALUES]


def test_full_mode_keeps_all_list_elements(spark):
    text = json.dumps({"id": "m--1", "type": "m", "name": "N", "platforms": ["a", "[b", True], "none": [], "text": "[a,b]"})
    objects = readers.keyed_objects(spark.createDataFrame([(0, 0, text)], "file_ord int, obj_pos int, object string"))
    got = [(r["label"], r["dst"]) for r in bundles.attribute_edges(objects, full=True).collect() if r["label"] not in ("name", "is_m_type")]
    assert sorted(got) == [("none", "Not Available"), ("platforms", "True"), ("platforms", "[b"), ("platforms", "a"), ("text", "[a,b]")]


def test_an_empty_last_name_drops_the_relationship(spark):
    objects = [{"id": "m--1", "type": "m", "name": "Early"}, {"id": "t--1", "type": "t", "name": "T"}, {"id": "m--1", "type": "m", "name": ""}, {"id": "r--1", "type": "relationship", "source_ref": "m--1", "target_ref": "t--1", "relationship_type": "uses"}]
    rows = [(0, k, json.dumps(o)) for k, o in enumerate(objects)]
    keyed = readers.keyed_objects(spark.createDataFrame(rows, "file_ord int, obj_pos int, object string"))
    assert {r["label"] for r in bundles.bundle_edges(keyed).collect()} == {"is_m_type", "is_t_type", "name"}


def test_files_are_numbered_in_path_order(spark):
    paths = [f"p{i:03d}" for i in range(200)]
    got = readers.in_order(spark.createDataFrame([(p,) for p in reversed(paths)], "path string").repartition(7), "path").collect()
    assert {r["path"]: r["number"] for r in got} == {p: i for i, p in enumerate(paths)}


CASES = [
    (["RedFox"], ["uses_attack_pattern", "mitigated_by"], {"Mail Quarantine"}),
    (["BlueJay"], ["uses_attack_pattern", "filter office"], {"Mail Lure"}),
    (["BlueJay"], ["uses_attack_pattern", "filter office and macro"], {"Mail Lure"}),
    (["BlueJay"], ["uses_attack_pattern", "filter office or erases"], {"Mail Lure", "Disk Wipe"}),
    (["RedFox"], ["description", "filter worm"], set()),
    (["RedFox"], ["is_malware_type"], {"RedFox"}),
    ([], ["is_malware_type", "filter backdoor", "uses_attack_pattern"], {"Mail Lure", "Disk Wipe"}),
    ([], ["uses_attack_pattern"], set()),
    ([], [], set()),
    (["RedFox"], [], {"RedFox"}),
    (["Nobody"], ["uses_attack_pattern"], set()),
    (["RedFox"], ["select x", "uses_attack_pattern"], set()),
]


@pytest.mark.parametrize("entities,path,expected", CASES)
def test_single_mode(spark, graph, entities, path, expected):
    assert {r["node"] for r in follow(graph, spark, entities, path).collect()} == expected


MANY = [
    (["uses_attack_pattern", "exec_common attack_pattern"], {"Mail Lure"}),
    (["uses_attack_pattern", "exec_difference attack_pattern"], {"Disk Wipe"}),
    (["is_malware_type", "uses_attack_pattern", "exec_common attack_pattern"], {"Mail Lure", "Disk Wipe"}),
    (["uses_attack_pattern", "exec_common nothing"], set()),
    (["exec_common attack_pattern"], set()),
]


@pytest.mark.parametrize("path,expected", MANY)
def test_combinations(spark, graph, path, expected):
    out = follow_many(graph, start(spark, ["RedFox", "BlueJay"]), path)
    assert {r["node"] for r in out.combined[len(path)].collect()} == expected


def test_select_and_unknown_operation(spark, graph):
    out = follow_many(graph, start(spark, ["RedFox", "BlueJay"]), ["select <<malware>> <<malware>>", "uses_attack_pattern", "exec_union attack_pattern"])
    assert {(r["entity"], r["node_type"], r["node"]) for r in out.results.collect()} == {("RedFox", "attack_pattern", "Mail Lure"), ("BlueJay", "attack_pattern", "Mail Lure"), ("BlueJay", "attack_pattern", "Disk Wipe")}
    assert out.errors == {3: "Unknown operation 'union'."}


def test_trace_lines(spark, graph):
    texts = spark.createDataFrame([("RedFox", "Mail Lure", "by mail", 1), ("RedFox", "Mail Lure", "later", 2)], "source string, target string, description string, line_no long")
    rows = trace(graph, start(spark, ["RedFox"]), ["uses_attack_pattern", "filter office"], texts).orderBy("step", "ord").collect()
    assert [r["line"] for r in rows] == ["[!] Step 1: Following relation 'uses_attack_pattern'. Results:", "   - Mail Lure: by mail", "[!] Step 2: Filtering attack_pattern nodes by 'office'.", "   - Mail Lure"]


def test_parse_and_render():
    assert S.parse_path("x <PATH>a<SEP>filter b</PATH> <PATH>c</PATH>") == ["a", "filter b"] and S.parse_path("none") == []
    for steps in (["a"], ["a", "b c"], []):
        assert S.parse_path(S.render_path(steps)) == (steps or [""])
    assert S.parse_step("filter A and B or c", "single") == S.Filter(("a", "b or c"), True, "A and B or c")
    assert isinstance(S.parse_step("x_type_y", "multi"), S.TypeSeed) and isinstance(S.parse_step("filter my_type", "multi"), S.TypeSeed)
    assert isinstance(S.parse_step("filter my_type", "single"), S.Filter)
    assert S.without_no_ops(S.compile_path(["select a", "b"], "multi")) == [S.Hop("b")]


def test_dead_paths_are_answered_without_a_scan(spark, graph):
    assert follow(graph, spark, ["RedFox"], ["show malware"], labels=frozenset(["uses_attack_pattern"])).collect() == []


class Model:
    """Sets and dictionaries: what the steps mean."""

    def __init__(self, edges):
        self.edges = {}
        for src, dst, label, seq in sorted(edges, key=lambda e: (e[3], e[2])):
            first = self.edges.get((src, dst), (None, seq))[1]
            self.edges[src, dst] = (label, first)

    def step(self, nodes, step, seed):
        if step.startswith("filter ") and not (seed and "_type" in step):
            words = step[7:].lower()
            both = " and " in words
            parts = words.split(" and " if both else " or ")
            test = all if both else any
            return {n for n in nodes if any(s == n and lab == "description" and test(w.strip() in d.lower() for w in parts) for (s, d), (lab, _) in self.edges.items())}
        if "_type" in step:
            sources = {s for (s, _), (lab, _) in self.edges.items() if lab == step}
            return sources if seed else nodes & sources
        return {d for (s, d), (lab, _) in self.edges.items() if lab == step and s in nodes}

    def type_of(self, node):
        found = [(pos, d) for (s, d), (lab, pos) in self.edges.items() if s == node and "type" in lab]
        return min(found)[1] if found else None


def random_edges(rng):
    names = [f"n{i}" for i in range(9)]
    labels = ["a", "b", "is_x_type", "is_y_type", "description"]
    return [(rng.choice(names), rng.choice([*names, "Red text", "blue TEXT", "x"]), rng.choice(labels), k) for k in range(60)]


STEPS = ["a", "b", "is_x_type", "filter red", "filter red or blue", "filter text and blue", "is_y_type"]


@pytest.mark.parametrize("seed", range(4))
def test_paths_equal_the_set_model(spark, seed):
    rng = random.Random(seed)
    edges = random_edges(rng)
    model = Model(edges)
    canonical = graphs.canonical(spark.createDataFrame(edges, "src string, dst string, label string, seq long")).cache()
    graph = graphs.Graph.of(canonical)
    assert {(r["src"], r["dst"]): (r["label"], r["pos"]) for r in canonical.collect()} == model.edges
    assert {r["name"]: r["node_type"] for r in graph.types.collect()} == {n: t for n in {s for s, _ in model.edges} if (t := model.type_of(n))}
    paths = {k: [rng.choice(STEPS) for _ in range(rng.randrange(1, 4))] for k in range(6)}
    entities = {k: f"n{k}" for k in paths}
    batch = follow_batch(graph, spark.createDataFrame(list(entities.items()), "query_id int, entity string"), paths)
    expected = set()
    for k, path in paths.items():
        nodes = {entities[k]}
        for step in path:
            nodes = model.step(nodes, step, False)
        expected |= {(k, n) for n in nodes}
    assert {tuple(r) for r in batch.collect()} == expected
    path, many = paths[0], ["n0", "n1", "n2"]
    results, state = set(), {e: {e} for e in many}
    for step in path:
        for e in many:
            state[e] = model.step(state[e], step, True)
            if "_type" not in step and not step.startswith("filter"):
                results |= {(e, model.type_of(n), n) for n in state[e]}
    out = follow_many(graph, start(spark, many), path)
    assert {(r["entity"], r["node_type"], r["node"]) for r in out.results.collect()} == results
    assert {(r["entity"], r["node"]) for r in out.frontiers[-1].expanded(out.entities).collect()} == {(e, n) for e in many for n in state[e]}


def test_labels_by_number_equal_those_by_text(spark):
    rng = random.Random(5)
    labels = ["is_x_type", "r", "é", "日本", "r2", None]
    rows = [(f"s{rng.randrange(30)}", f"s{rng.randrange(30)}", rng.choice(labels), rng.randrange(40)) for _ in range(3000)]
    edges = spark.createDataFrame(rows, "src string, dst string, label string, seq long")
    expected = sorted(map(repr, graphs.canonical(edges).collect()))
    stated = [x for x in labels if x]
    found = graphs.canonical_by_number(edges, stated, 39)
    assert sorted(map(repr, found.collect())) == expected
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    # No room for a label's number beside the place.
    assert sorted(map(repr, graphs.canonical_by_number(edges, stated, 1 << 61).collect())) == expected
    with pytest.raises(Exception, match="not among the stated labels"):
        graphs.canonical_by_number(edges, stated[:-1], 39).collect()
    assert graphs.canonical_by_number(edges.limit(0), [], 0).count() == 0
