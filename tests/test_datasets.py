"""Texts, expansion, splits, readers and writers."""

import itertools
import json
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from trailgraph import cli
from trailgraph.functions import match, text
from trailgraph.functions.match import closest
from trailgraph.operators import bundles, expand, graph as graphs, splits
from trailgraph.sources import readers, writers, yaml_documents
from trailgraph.streaming.bundles import append_objects, stored_objects


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,expected", [
    ("Abuses Office files (macro). More.", "Abuses Office files ."), ("v1.2 is good. next", "2 is good."), ("no stop here", "no stop here"), ("", None),
    ("[a] b.c", "a b.c"), ("Ends.", "Ends."), ("x.\ny. z", "x."), ("... a. b", "."),
])
def test_first_sentence(spark, raw, expected):
    assert one(spark, text.first_sentence, raw) == expected


def test_paths_in_texts(spark):
    assert one(spark, text.path_steps, "a <PATH>x<SEP>y</PATH>") == ["x", "y"] and one(spark, text.path_steps, "none") == []
    said = "first <PATH>a</PATH> The completed path is:\n<PATH>b\n<SEP>c</PATH> "
    assert one(spark, text.final_path, said) == "<PATH>b\n<SEP>c</PATH>" and one(spark, text.final_path, "no") is None
    assert one(spark, text.ends_path, "x</PATH>\n") and not one(spark, text.ends_path, "x")


def test_entities(spark):
    assert one(spark, text.entities, "Let's reason step by step, starting from the entity 'RedFox' (type: malware). Our") == ["RedFox"]
    many = "We are working with the following entities:\n- 'A b' is a malware\n- 'C' is a tool.\nOur goal\n\n**Entity Description**\n - no"
    assert one(spark, text.entities, many) == ["A b", "C."] and one(spark, text.entities, "nothing") == []


def test_validators(spark):
    assert one(spark, text.keeps_brackets, "[a] x [b]", "[b] y [a]") and not one(spark, text.keeps_brackets, "[a]", "y")
    assert one(spark, text.valid_paraphrase, "a worm [x]", "the Worm [x]") and not one(spark, text.valid_paraphrase, "a worm", "a thing")
    assert one(spark, text.malware_terms, "Spyware operation") == ["spyware", "rat", "spy"]
    assert one(spark, text.question_lines, "Sure\n1. What?\n 12 things\n21. no\n3. yes: a. b\n\nplain") == ["What?", "12 things", "no", "yes: a. b"]
    assert one(spark, text.objective, ' "Find [x]." \n') == "Find [x]."


def test_replacements(spark):
    once = one(spark, lambda t: text.replace_once(t, [F.lit("[m]"), F.lit("[m]")], [F.lit("$1\\"), F.lit("b")]), "[m] and [m] and [m]")
    assert once == "$1\\ and b and [m]"
    assert one(spark, lambda t: text.replace_map(t, F.create_map(F.lit("m"), F.lit("x"))), "[m] [m] [n]") == "x x [n]"
    assert one(spark, text.placeholders, "[a] and [b c]") == ["a", "b c"]
    assert one(spark, lambda c: text.pick(text.variations(c, ";"), "first"), " ab; a longer one; c") == "ab"
    assert one(spark, lambda c: text.pick(text.variations(c, ";"), "longest"), "ab; a longer one; c") == "a longer one"
    assert one(spark, lambda c: text.pick(text.variations(c, ";"), "longest"), " ; ") is None
    assert one(spark, text.capitalised, "common") == "Common"


def test_closest_names(spark):
    wanted = spark.createDataFrame([("RedFx",), ("qqqqq",)], "entity string")
    names = spark.createDataFrame([("RedFox",), ("BlueJay",)], "name string")
    assert [(r["entity"], r["name"]) for r in closest(wanted, names).collect()] == [("RedFx", "RedFox")]


def small_graph(spark):
    edges = [("Fox", "malware", "is_malware_type", 0), ("Jay", "malware", "is_malware_type", 1), ("Lure", "pattern", "is_pattern_type", 2), ("Fox", "Lure", "uses_pattern", 3), ("Fox", "Fox is a worm. It spreads.", "description", 4)]
    return graphs.Graph.of(spark.createDataFrame(edges, "src string, dst string, label string, pos long").cache())


def templates(spark, *rows):
    return spark.createDataFrame(list(rows), "section string, idx int, question string, path array<string>, target array<string>")


def test_expansion_with_one_and_no_entity(spark):
    rows = templates(spark, ("s", 0, "What does [malware] use?", ["uses_pattern"], ["patterns of [malware]"]), ("t", 0, "All?", ["is_malware_type", "page_rank 3"], ["all"]), ("t", 1, "[none] x", ["a"], ["y"]))
    varied = spark.createDataFrame([("All?", ["Every?", "Each?"])], "question string, variations array<string>")
    targets = spark.createDataFrame([("All?", ["everything"])], "question string, variations array<string>")
    got = {r["question"]: r["response"] for r in expand.expand(spark, rows, small_graph(spark), varied, targets).collect()}
    assert set(got) == {"What does Fox use?", "What does Jay use?", "Every?", "Each?"}
    assert "Description: Fox is a worm.\n" in got["What does Fox use?"] and "Description:" not in got["What does Jay use?"]
    assert got["What does Fox use?"].endswith("<PATH>uses_pattern</PATH>")
    assert "Step 1: Follow 'uses_pattern' relationship to reach patterns of Fox, marking the conclusion of our path." in got["What does Fox use?"]
    assert "Step 2: Follow 'page_rank 3' relationship to reach the top 3 everything, marking the conclusion of our path." in got["Every?"]


def test_expansion_with_three_entities_is_disjoint(spark):
    edges = [(f"{t}{i}", t, f"is_{t}_type", 10 * k + i) for k, t in enumerate(("aa", "bb")) for i in range(6)]
    graph = graphs.Graph.of(spark.createDataFrame(edges, "src string, dst string, label string, pos long"))
    rows = templates(spark, ("entity_in_path", 0, "[aa] and [bb] and [aa]", ["select <<aa>> <<bb>>", "is_aa_type"], ["t"]))
    got = expand.expand(spark, rows, graph).collect()
    assert 1 <= len(got) <= 3 and all("select aa" in r["response"] for r in got)
    assert expand.disjoint_combinations([["a", "b"], ["b", "c"]], 9) == [("a", "b")] and expand.disjoint_combinations([["a", "b"], ["c", "d"]], 9) == [("a", "c"), ("b", "d")]


def test_pair_samples_are_different_and_whole(spark):
    edges = [(f"{t}{i}", t, f"is_{t}_type", 100 * k + i) for k, t in enumerate(("aa", "b_b")) for i in range(100)]
    graph = graphs.Graph.of(spark.createDataFrame(edges, "src string, dst string, label string, pos long"))
    got = expand.expand(spark, templates(spark, ("s", 0, "[aa] [b-b]", ["x <<aa>>"], ["t"])), graph).collect()
    assert len(got) == 10 == len({r["question"] for r in got})


def test_split_sizes(spark):
    sizes = {0: 1, 1: 2, 2: 3, 3: 5, 4: 6, 5: 15, 6: 16, 7: 100}
    rows = spark.createDataFrame([(f"q{s}_{i}", f"s{s}") for s, n in sizes.items() for i in range(n)], "question string, section string")
    got = {}
    for r in splits.split(rows).groupBy("section", "split").count().collect():
        got.setdefault(int(r["section"][1:]), {})[r["split"]] = r["count"]
    triple = lambda s: tuple(got[s].get(k, 0) for k in ("train", "validation", "test"))
    assert [triple(k) for k in range(8)] == [(1, 0, 0), (1, 0, 1), (2, 1, 0), (4, 1, 0), (4, 1, 1), (12, 1, 2), (12, 1, 3), (80, 5, 15)]
    with pytest.raises(ValueError):
        splits.check_ratios(0.5, 0.2, 0.2)
    assert {r["split"] for r in splits.split(rows, 1.0, 0.0, 0.0).collect()} == {"train"}


def test_sections_and_targets(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "question string")
    sections = spark.createDataFrame([("a", "one", 1), ("a", "two", 2)], "question string, section string, ord int")
    assert [tuple(r) for r in splits.with_sections(rows, sections).collect()] == [("a", "two")]
    assert splits.unmapped(splits.with_sections(rows, sections, False).replace("Unknown", None, "section")).first()["unmapped"] == 1
    updated = splits.update_targets(spark.createDataFrame([("a", "x"), ("b", "y")], "question string, target string"), spark.createDataFrame([("a", "z"), ("b", "y")], "question string, new_target string"))
    assert {tuple(r) for r in updated.collect()} == {("a", "z", True), ("b", "y", False)}


def test_readers_and_writers(spark, tmp_path):
    path = f"file://{tmp_path}"
    edges = spark.createDataFrame([("a", "b", "x", 1), ("b", "c", "is_y_type", 2)], "src string, dst string, label string, pos long")
    writers.write_edges(edges, f"{path}/store")
    assert sorted(readers.read_edges(spark, f"{path}/store").collect()) == sorted(edges.collect())
    writers.write_graphml(edges, f"{path}/graph.xml")
    assert sorted((r["src"], r["dst"], r["label"]) for r in readers.read_graphml(spark, f"{path}/graph.xml").collect()) == [("a", "b", "x"), ("b", "c", "is_y_type")]
    writers.write_edge_log(edges, f"{path}/log")
    assert sorted(r["value"] for r in spark.read.text(f"{path}/log").collect()) == ["a - x -> b", "b - is_y_type -> c"]
    (tmp_path / "names.txt").write_text("Fox\n\n Jay \nFox\n")
    assert sorted(r["name"] for r in readers.read_names(spark, f"{path}/names.txt").collect()) == ["Fox", "Jay"]
    (tmp_path / "rel.txt").write_text("SOURCE: a, TARGET: b, DESCRIPTION: c, d\nbroken\n")
    assert [tuple(r)[:3] for r in readers.read_relation_texts(spark, f"{path}/rel.txt").collect()] == [("a", "b", "c, d")]
    (tmp_path / "t.json").write_text(json.dumps({"templates": {"s": [{"question": "q", "path": ["a"], "target": ["t"]}, "bad"], "u": [{"question": "p", "path": [], "target": "whole"}]}}))
    assert sorted(tuple(r) for r in readers.read_templates(spark, f"{path}/t.json").collect()) == [("s", 0, "q", ["a"], ["t"]), ("u", 0, "p", [], ["whole"])]
    rows = spark.createDataFrame([("q, 1", ['say "a"', "b"]), ("q2", [])], "question string, variations array<string>")
    writers.write_variations(rows, f"{path}/v.csv")
    assert sorted(tuple(r) for r in readers.read_variations(spark, f"{path}/v.csv").collect()) == [("q, 1", ['say "a"', "b"]), ("q2", [])]
    assert readers.read_variations(spark, f"{path}/missing.csv").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.require(spark, f"{path}/missing.csv", "variations")
    (tmp_path / "sections.json").write_text(json.dumps({"one": [{"question": "a"}, {"question": "b"}], "two": [{"question": "a"}]}, indent=2))
    assert sorted((r["question"], r["section"]) for r in readers.read_sections(spark, f"{path}/sections.json").collect()) == [("a", "one"), ("a", "two"), ("b", "one")]
    split_rows = spark.createDataFrame([("q1", "<PATH>a</PATH>", "train"), ("q2", None, "train"), ("q3", "<PATH>b</PATH>", "test")], "Question string, Path string, split string")
    writers.write_splits(split_rows, f"{path}/splits")
    assert sorted((r["split"], r["Question"]) for r in readers.read_splits(spark, f"{path}/splits").collect()) == [("test", "q3"), ("train", "q1")]
    targets = spark.createDataFrame([("a", "t")], "question string, target string")
    assert writers.write_targets(targets, f"{path}/out", dry_run=True) is None
    assert [writers.write_targets(targets, f"{path}/out")[-6:] for _ in range(2)] == ["v00000", "v00001"]
    histogram = graphs.relation_histogram(graphs.Graph.of(edges))
    writers.write_relation_map(histogram, f"{path}/map")
    assert spark.read.json(f"{path}/map").count() == 2


def test_new_bundles_are_appended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = str(tmp_path / "store")
    files = [
        [{"id": "m--1", "type": "m", "name": "N", "revoked": False}, {"name": "no id"}, {"id": "r--1", "type": "relationship", "source_ref": "m--1", "target_ref": "t--1", "relationship_type": "uses"}],
        [{"id": "t--1", "type": "t", "name": "T"}, {"id": "m--1", "type": "m", "name": "M"}],
    ]
    for k, objects in enumerate(files):
        path = tmp_path / "in" / f"{'ba'[k]}.json"
        path.write_text(json.dumps({"objects": objects}, indent=2))
        os.utime(path, (1_700_000_000 + 20_000 * k,) * 2)  # later by more than a few hours, though first by name
        append_objects(spark, str(tmp_path / "in"), store, str(tmp_path / "ck")).awaitTermination()
    edges = {(r["src"], r["label"], r["dst"]) for r in bundles.bundle_edges(stored_objects(spark, store)).collect()}
    assert edges == {("N", "is_m_type", "m"), ("N", "name", "N"), ("N", "revoked", "False"), ("T", "is_t_type", "t"), ("T", "name", "T"), ("M", "is_m_type", "m"), ("M", "name", "M"), ("M", "uses_t", "T"), ("T", "used_by_m", "M")}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.2, 1.0])
def test_closest_names_equal_all_pairs(spark, monkeypatch, threshold):
    rng = random.Random(3)
    made = lambda: "".join(rng.choice("abcABC #1é") for _ in range(rng.randrange(0, 30)))
    wanted, names = [*(made() for _ in range(40)), "ab", "ABCD", "qz", "", "x"], [*(made() for _ in range(120)), "qy", "abcd", "ABCx", ""]
    monkeypatch.setattr(match, "ENTITY_BLOCK", 10)
    monkeypatch.setattr(match, "NAME_BLOCK", 25)
    got = match.closest(spark.createDataFrame([(w,) for w in [*wanted, None]], "entity string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string").repartition(3), threshold)
    expected = {}
    for w in set(wanted):
        score, name = min((-SequenceMatcher(None, w, n).ratio(), n) for n in names)
        if -score >= threshold:
            expected[w] = (name, -score)
    assert {r["entity"]: (r["name"], r["score"]) for r in got.collect()} == expected
    if threshold == 0.5:
        assert expected["qz"] == ("qy", 0.5) and expected["ABCD"] == ("ABCx", 0.75)


def test_bands_never_part_names_that_are_near(spark):
    lengths = spark.range(1, 400).selectExpr("cast(id as int) n", "repeat('x', cast(id as int)) t")
    for threshold in (0.3, 0.5, 0.6, 0.75, 0.9):
        bands = {r["n"]: r["b"] for r in lengths.select("n", match.band(F.col("t"), threshold).alias("b")).collect()}
        for n in bands:
            for m in range(n, min(400, int(n * (2 - threshold) / threshold) + 1)):
                assert 2 * n / (n + m) < threshold or bands[m] - bands[n] <= 1


def test_disjoint_combinations_equal_the_rule():
    rng = random.Random(4)
    for _ in range(300):
        slots = [rng.sample("abcdefg", rng.randrange(0, 5)) for _ in range(rng.randrange(1, 4))]
        expected, rest = [], list(itertools.product(*slots))
        while len(expected) < 3 and (rest := [c for c in rest if len(set(c)) == len(c) and not any(set(c) & set(e) for e in expected)]):
            expected.append(rest[0])
        assert expand.disjoint_combinations(slots, 3) == expected


def test_top_paraphrases_and_plain_variations(spark, tmp_path):
    offered = F.array(F.lit("a thing [x]"), F.lit("[x] worms"), F.lit("no"), F.lit("the worm [x]"), F.lit("worm [x]"))
    assert one(spark, lambda q: text.top_paraphrases(q, offered, 2), "A worm [x]") == ["[x] worms", "the worm [x]"]
    writers.write_variations(spark.createDataFrame([("q", "as it is"), ("p", None)], "question string, variations string"), f"file://{tmp_path}/v.csv")
    assert sorted(map(tuple, readers.read_csv(spark, f"file://{tmp_path}/v.csv").fillna("").collect())) == [("p", ""), ("q", "as it is")]


def test_template_documents_are_rewritten_with_a_backup(spark, tmp_path):
    document = {"templates": {"s": [{"question": 'say "q"', "path": ["a", "filter .NET"], "target": ["old: one"]}, "odd"], "t": [], "u": {"k": 1}}, "version": 2}
    new, scanned, changed = writers.updated_document(spark, document, spark.createDataFrame([('say "q"', "new"), ("other", "x")], "question string, new_target string"))
    assert (scanned, changed) == (1, 1) and new["templates"]["s"][0]["target"] == "new" and document["templates"]["s"][0]["target"] == ["old: one"]
    for name in ("t.yaml", "t.json"):
        path = f"file://{tmp_path}/{name}"
        writers.write_document(spark, document, path)
        writers.write_document(spark, new, path)
        assert "old: one" in (tmp_path / f"{name}.bak").read_text() and "old: one" not in (tmp_path / name).read_text()
    assert json.loads((tmp_path / "t.json").read_text()) == new
    assert (tmp_path / "t.yaml").read_text().splitlines() == [
        '"templates":', '  "s":', '    - "question": "say \\"q\\""', '      "path": ["a", "filter .NET"]', '      "target": "new"', '    - "odd"', '  "t": []', '  "u":', '    "k": 1', '"version": 2',
    ]


YAML = """# templates
templates:
  one_entity:   # same indent
  - question: "Which \\"x\\" of [a_b]?"
    path: [uses, filter .NET, "filter a, b", 'it''s']
    target: [user's passwords]

  - question : What is [a-b], then: more?
    path: []
    target: plain words  # a comment
  - odd
  other:
      - question: q
        path:
          - a
          - "b: c"
        target:
        - t
  empty:
version: 2
flag: true
deep: [[a, b], [], c]
"""


def test_yaml_templates(spark, tmp_path):
    expected = {
        "templates": {
            "one_entity": [{"question": 'Which "x" of [a_b]?', "path": ["uses", "filter .NET", "filter a, b", "it's"], "target": ["user's passwords"]}, {"question": "What is [a-b], then: more?", "path": [], "target": "plain words"}, "odd"],
            "other": [{"question": "q", "path": ["a", "b: c"], "target": ["t"]}], "empty": None,
        }, "version": 2, "flag": True, "deep": [["a", "b"], [], "c"],
    }
    assert yaml_documents.load(YAML) == expected
    assert yaml_documents.load("\n".join(writers.yaml_lines(expected))) == expected and yaml_documents.load("") is None
    for refused in ('a: "text over', "a: 'text over", "a: &x 1", "a: |\n  text", "a: [b", "a: b\n   c"):
        with pytest.raises(ValueError):
            yaml_documents.load(refused)
    (tmp_path / "t.yaml").write_text(YAML)
    rows = [tuple(r) for r in readers.read_templates(spark, f"file://{tmp_path}/t.yaml").collect()]
    assert rows[0] == ("one_entity", 0, 'Which "x" of [a_b]?', ["uses", "filter .NET", "filter a, b", "it's"], ["user's passwords"]) and len(rows) == 3
    (tmp_path / "v.csv").write_text("Original Question,Variations\nq,short; longest one\n")
    for _ in range(2):  # the second run keeps what the first wrote
        cli.main(["update-targets", "--templates", "--csv", f"file://{tmp_path}/v.csv", "--input", f"file://{tmp_path}/t.yaml", "--out", f"file://{tmp_path}/new.yaml", "--pick", "longest"])
    assert yaml_documents.load((tmp_path / "new.yaml").read_text())["templates"]["other"][0]["target"] == "longest one"
    assert (tmp_path / "new.yaml.bak").exists()


def test_dropped_rows_are_counted(spark, tmp_path):
    (tmp_path / "train.csv").write_text("Question,Path\nq,p\n,p\nq2,\n")
    (tmp_path / "test.csv").write_text("Question,Path\nq,p\n")
    got = {tuple(r) for r in readers.dropped_rows(spark, f"file://{tmp_path}").collect()}
    assert got == {("train", 3, 2), ("test", 1, 0)}


def test_known_types_have_their_glossary_line_and_the_section_its_cap(spark):
    edges = [(f"M{k:04d}", "malware", "is_malware_type", k) for k in range(700)]
    graph = graphs.Graph.of(spark.createDataFrame(edges, "src string, dst string, label string, pos long"))
    rows = templates(spark, ("entity_in_path", 0, "[malware]?", ["a"], ["t"]), ("s", 0, "All of [malware]?", ["a"], ["t"]))
    got = expand.expand(spark, rows, graph).collect()
    capped = [r["question"] for r in got if r["section"] == "entity_in_path"]
    assert sorted(capped) == [f"M{k:04d}?" for k in range(600)] and len(got) == 1300
    assert all("\nDescription of 'malware': Malicious code/software.\n" in r["response"] for r in got)


def test_what_has_no_place_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(bundles, "KEYS_AN_OBJECT", 6)
    monkeypatch.setattr(bundles, "OBJECTS_A_FILE", 4)

    def edges(file_ord, obj_pos, n_keys):
        keys = "".join(f', "k{k}": 1' for k in range(n_keys - 3))
        df = spark.createDataFrame([(file_ord, obj_pos, f'{{"id": "a", "type": "t", "name": "n"{keys}}}')], "file_ord long, obj_pos int, object string")
        return bundles.attribute_edges(readers.keyed_objects(df)).collect()

    assert [len(edges(0, 3, 6)), len(edges(bundles.FILES - 1, 0, 3))] == [5, 2]
    for file_ord, obj_pos, n_keys in ((0, 0, 7), (0, 4, 3), (bundles.FILES, 0, 3)):
        with pytest.raises(Exception, match="no place for"):
            edges(file_ord, obj_pos, n_keys)
