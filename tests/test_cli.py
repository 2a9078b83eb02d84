"""The command line, from bundles to splits."""

import json

import pytest

from trailgraph import cli
from trailgraph.operators import graph as graphs
from trailgraph.plans.execute import start, trace_many
from trailgraph.sources import readers, writers


def test_from_bundles_to_splits(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    objects = [{"id": f"malware--{k}", "type": "malware", "name": f"Fox{k}", "description": "A worm. More."} for k in range(8)]
    (tmp_path / "in" / "a.json").write_text(json.dumps({"objects": objects}))
    path = f"file://{tmp_path}"
    cli.main(["build-graph", "--base", f"{path}/in", "--out", f"{path}/store", "--log", f"{path}/log", "--graphml", f"{path}/g.xml"])
    template = {"templates": {"s": [{"question": "What is [malware]?", "path": ["is_malware_type"], "target": ["the malware"]}, {"question": "x", "path": ["a", "b"], "target": ["t"]}]}}
    (tmp_path / "t.json").write_text(json.dumps(template))
    cli.main(["expand", "--templates", f"{path}/t.json", "--graph", f"{path}/store", "--out", f"{path}/qa", "--out-sections", f"{path}/by", "--out-relations", f"{path}/rel", "--skip-path", "a<SEP>b"])
    items = spark.read.json(f"{path}/qa")
    assert items.count() == 8 and items.columns == ["question", "response"]
    items.withColumnRenamed("question", "Question").drop("response").write.csv(f"{path}/qa.csv", header=True)
    (tmp_path / "sections.json").write_text(json.dumps({"s": [{"question": r["question"]} for r in items.collect()]}))
    cli.main(["split", "--csv", f"{path}/qa.csv", "--sections", f"{path}/sections.json", "--out", f"{path}/splits"])
    assert [spark.read.csv(f"{path}/splits/{s}.csv", header=True).count() for s in ("train", "validation", "test")] == [6, 1, 1]
    (tmp_path / "list.json").write_text(json.dumps([{"question": "q", "response": "r", "target": "old"}]))
    (tmp_path / "v.csv").write_text("Original Question,Variations\nq,short; a longer one\n")
    cli.main(["update-targets", "--csv", f"{path}/v.csv", "--input", f"{path}/list.json", "--out", f"{path}/new", "--pick", "longest"])
    assert "scanned 1, updated 1" in capsys.readouterr().out
    assert spark.read.json(f"{path}/new/v00000").first()["target"] == "a longer one"


@pytest.mark.parametrize("document", [[], ["--document"]])
def test_no_row_is_lost_from_expansion_to_splits(spark, tmp_path, document):
    edges = [(f'M"{k},\n', "malware", "is_malware_type", k) for k in range(40)] + [(f"T{k}", "tool", "is_tool_type", 100 + k) for k in range(30)]
    path = f"file://{tmp_path}"
    writers.write_edges(spark.createDataFrame(edges, "src string, dst string, label string, pos long"), f"{path}/store")
    entry = lambda q: {"question": q, "path": ["a"], "target": ["t"]}
    (tmp_path / "t.json").write_text(json.dumps({"templates": {"2": [entry("What is [malware]?")], "x/=y": [entry("Is [tool] one?")], "none": []}}))
    cli.main(["expand", "--templates", f"{path}/t.json", "--graph", f"{path}/store", "--out", f"{path}/qa", "--out-sections", f"{path}/by", "--out-relations", f"{path}/rel", *document])
    items = readers.read_questions(spark, f"{path}/qa")
    assert items.count() == 70 and set(items.columns) == {"question", "response"}
    sections = readers.read_sections(spark, f"{path}/by").groupBy("section").count().collect()
    assert {r["section"]: r["count"] for r in sections} == {"2": 40, "x/=y": 30}
    if document:
        assert len(json.loads((tmp_path / "qa").read_text())) == 70
        assert {k: len(v) for k, v in json.loads((tmp_path / "by").read_text()).items()} == {"2": 40, "x/=y": 30, "none": 0}
        assert json.loads((tmp_path / "rel").read_text()) == {"is_malware_type": {"malware": 40}, "is_tool_type": {"tool": 30}}
    cli.main(["to-csv", "--input", f"{path}/qa", "--out", f"{path}/qa.csv"])
    cli.main(["split", "--csv", f"{path}/qa.csv", "--sections", f"{path}/by", "--out", f"{path}/splits"])
    rows = [r for s in ("train", "validation", "test") for r in readers.read_csv(spark, f"{path}/splits/{s}.csv").collect()]
    asked = [f'What is M"{k},\n?' for k in range(40)] + [f"Is T{k} one?" for k in range(30)]
    assert sorted(r["Question"] for r in rows) == sorted(asked) and {r["section"] for r in rows} == {"2", "x/=y"}


def test_lines_of_several_entities(spark):
    edges = [("A", "m", "is_m_type", 0), ("B", "m", "is_m_type", 1), ("T", "t", "is_t_type", 2), ("A", "T", "uses", 3), ("B", "T", "uses", 4)]
    graph = graphs.Graph.of(spark.createDataFrame(edges, "src string, dst string, label string, pos long"))
    rows = trace_many(graph, start(spark, ["A", "B"]), ["select x", "uses", "filter q", "is_m_type", "exec_common t", "exec_x t"]).collect()
    lines = [(r["step"], r["entity"], r["line"]) for r in sorted(rows, key=lambda r: (r["step"], r["entity"] or "", r["ord"], r["line"]))]
    assert lines[:7] == [
        (1, None, "[!] Step 1: Selecting entities. Results:"), (1, None, "   - A"), (1, None, "   - B"),
        (2, "A", "[!] Step 2: Following relation 'uses'."), (2, "A", "   - T (t)"), (2, "B", "[!] Step 2: Following relation 'uses'."), (2, "B", "   - T (t)"),
    ]
    assert (3, "A", "[!] Step 3: Filtering nodes by keywords 'q'. Kept 0 nodes.") in lines
    assert (4, "B", "[!] Step 4: Seeding from relation 'is_m_type'. Found 2 sources.") in lines
    assert (5, None, "   - T") in lines and (6, None, "[ERROR] Unknown operation 'x'.") in lines
