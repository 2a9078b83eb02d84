"""What is written is read back whole, over several part files, by this library's readers and by others'."""

import json
import xml.etree.ElementTree as xml

import pytest
from pyspark.sql import functions as F

from trailgraph.operators import graph as graphs, splits
from trailgraph.sources import documents, readers, writers

ODD = ["plain", 'quo"te', "back\\slash", "line\nbreak", "tab\t", "<a & b>", "é 🙂", "", " spaced ", "[x", "{", ",", "\u2028", "null"]


def items(spark, n=120, parts=7):
    rows = [(f"s{k % 3}" if k % 4 else "2", k % 5, f"{ODD[k % len(ODD)]}{k % 60}", None if k % 11 == 0 else ODD[-1 - k % len(ODD)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "section string, idx int, question string, response string").repartition(parts)


@pytest.mark.parametrize("document", [False, True])
def test_questions_round_trip(spark, tmp_path, document):
    rows, df = items(spark)
    path = f"file://{tmp_path}/qa"
    writers.write_questions(df.select("question", "response"), path, document)
    back = readers.read_questions(spark, path)
    assert sorted(map(repr, ((r["question"], r["response"]) for r in back.collect()))) == sorted(map(repr, ((q, a) for _, _, q, a in rows)))
    if document:
        assert sorted(map(repr, ((e["question"], e["response"]) for e in json.loads((tmp_path / "qa").read_text())))) == sorted(map(repr, ((q, a) for _, _, q, a in rows)))


@pytest.mark.parametrize("document", [False, True])
def test_sections_round_trip(spark, tmp_path, document):
    rows, df = items(spark)
    path = f"file://{tmp_path}/by"
    writers.write_sections(df, path, document, spark.createDataFrame([("empty",), ("2",)], "section string"))
    assert sorted((r["section"], r["question"]) for r in readers.read_sections(spark, path).collect()) == sorted((s, q) for s, _, q, _ in rows)
    if document:
        found = json.loads((tmp_path / "by").read_text())
        assert found["empty"] == [] and {k: len(v) for k, v in found.items() if v} == {s: sum(r[0] == s for r in rows) for s in {r[0] for r in rows}}


def test_lists_of_others_and_single_lines_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n  [\n {\"question\": \"a\",\n \"response\": \"b\"}, {\"question\": \"c\", \"response\": null}]")
    (tmp_path / "b.json").write_text('{"question": "a", "response": "b"}\n{"question": "c", "response": "d"}\n')
    assert [readers.read_questions(spark, f"file://{tmp_path}/{n}.json").count() for n in "ab"] == [2, 2]


def test_nothing_gives_empty_documents(spark, tmp_path):
    _, df = items(spark, 1)
    none = df.limit(0)
    writers.write_questions(none.select("question", "response"), f"file://{tmp_path}/qa", True)
    writers.write_sections(none, f"file://{tmp_path}/by", True)
    assert json.loads((tmp_path / "qa").read_text()) == [] and json.loads((tmp_path / "by").read_text()) == {}
    assert readers.read_questions(spark, f"file://{tmp_path}/qa").count() == 0


def test_a_document_takes_the_place_of_what_was_there(spark, tmp_path):
    _, df = items(spark, 20)
    for n in (20, 3):
        writers.write_questions(df.limit(n).select("question", "response"), f"file://{tmp_path}/qa", True)
        assert len(json.loads((tmp_path / "qa").read_text())) == n
    assert not (tmp_path / "qa.unfinished").exists()


def test_graphml_is_read_by_an_xml_parser_and_keeps_places(spark, tmp_path):
    names = [f"{o}{k}" for k, o in enumerate(ODD)]
    edges = [(names[k % len(names)], names[(k * 5 + 1) % len(names)] + str(k % 3), f"l{k % 4}<{k % 2}>", 10 * k + 3) for k in range(90)]
    df = spark.createDataFrame(edges, "src string, dst string, label string, pos long").repartition(5)
    writers.write_graphml(df, f"file://{tmp_path}/g.graphml")
    back = [tuple(r) for r in readers.read_graphml(spark, f"file://{tmp_path}/g.graphml").collect()]
    assert sorted(back) == sorted(edges)
    ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
    root = xml.parse(tmp_path / "g.graphml").getroot()
    keys = {k.get("id"): k.get("attr.name") for k in root.findall("g:key", ns)}
    nodes = [n.get("id") for n in root.findall("g:graph/g:node", ns)]
    found = [(e.get("source"), e.get("target"), *({keys[d.get("key")]: d.text for d in e.findall("g:data", ns)}[n] for n in ("label", "pos"))) for e in root.findall("g:graph/g:edge", ns)]
    assert found == [(s, d, lab, str(p)) for s, d, lab, p in edges]  # in order of their places
    assert len(nodes) == len(set(nodes)) and set(nodes) == {x for e in edges for x in e[:2]}


def test_graphml_of_others(spark, tmp_path):
    (tmp_path / "g.xml").write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d7" for="edge" attr.name="label" attr.type="string" /><key id="d0" for="node" attr.name="weight" attr.type="string" />
<graph edgedefault="directed"><node id="a"><data key="d0">1</data></node><node id="b" /><edge source="a" target="b"><data key="d7">uses &amp; has</data></edge>
<edge source="b" target="a" ><data key="d7">x</data></edge></graph></graphml>""")
    rows = sorted(tuple(r)[:3] for r in readers.read_graphml(spark, f"file://{tmp_path}/g.xml").collect())
    assert rows == [("a", "b", "uses & has"), ("b", "a", "x")]


def test_json_text(spark):
    df = spark.createDataFrame([(o,) for o in [*ODD, "\x01"]], "t string")
    assert [json.loads(r["j"]) for r in df.select(documents.json_text(F.col("t")).alias("j")).collect()] == [*ODD, "\x01"]


def test_repeated_questions_take_their_first_or_last_row(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Original Question,Variations\nq,a; b\np,x\nq,c\nr,\nr,y\n")
    first, last = ({r["question"]: r["variations"] for r in readers.read_variations(spark, f"file://{tmp_path}/v.csv", which).collect()} for which in ("first", "last"))
    assert first == {"q": ["a", "b"], "p": ["x"], "r": []} and last == {"q": ["c"], "p": ["x"], "r": ["y"]}


def test_columns_of_the_user_don_t_clash(spark):
    rows = spark.createDataFrame([("q", "old", "m", "n", "t")], "question string, target string, mapped_question string, new_question string, new_target string")
    new = spark.createDataFrame([("q", "new")], "question string, new_target string")
    assert tuple(splits.update_targets(rows, new).first()) == ("q", "new", "m", "n", "t", True)
    assert splits.with_sections(rows, spark.createDataFrame([("q", "s", 1)], "question string, section string, ord long")).first()["section"] == "s"


def test_a_label_has_as_many_files_as_its_size_asks_for(spark, tmp_path):
    edges = [(f"s{k}", f"d{k}", "big" if k < 20_000 else f"small{k % 3}", k) for k in range(20_030)]
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "64k")
        writers.write_edges(spark.createDataFrame(edges, "src string, dst string, label string, pos long").repartition(6), f"file://{tmp_path}/store")
    finally:
        spark.conf.set(size, before)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "store").glob("label=*")}
    assert files.pop("label=big") > 1 and set(files.values()) == {1}
    assert readers.read_edges(spark, f"file://{tmp_path}/store").count() == 20_030
    assert graphs.Graph.of(readers.read_edges(spark, f"file://{tmp_path}/store")).slice("big").count() == 20_000
