"""Bundles that are read in splits, against the same read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trailgraph.sources import readers
from trailgraph.sources.large_bundles import large_bundle_objects

ODD = ['plain', '}', '{"', '"objects": [{', "\\\\", '\\"', "]}", "é日🙂", "line\nbreak", '"objects" : [', ""]


def an_object(rng, k):
    extra = {rng.choice(ODD) + str(i): rng.choice([*ODD, 1, None, True, [rng.choice(ODD)], {"objects": [{"x": rng.choice(ODD)}]}, [[{"a": "}"}], 2]]) for i in range(rng.randrange(5))}
    return {"id": f"m--{k}", "type": "m", "name": f"N{k}", **extra}


def files_of(rng, folder, n=4):
    for k in range(n):
        objects = [an_object(rng, 100 * k + i) for i in range(rng.randrange(0, 9))]
        document = {"type": "bundle", "other": [{"id": "no", "type": "no"}, {"objects": [{"id": "deep", "type": "no"}]}], "objects": objects, "after": {"objects": [{"id": "late", "type": "no"}]}}
        if k % 3 == 1:
            document = {"objects": objects}
        text = json.dumps(document, indent=[None, 1, 4][k % 3], ensure_ascii=k % 2 == 0)
        (folder / f"f{k}.json").write_text(text + "\n" * (k % 2))
    (folder / "broken.json").write_text('{"objects": [{"id": "a", "type": "b", "name": "c"}, {"id": "a"')
    (folder / "string.json").write_text('{"objects": [{"id": "a", "type": "b", "name": "c}')
    (folder / "empty.json").write_text("")
    (folder / "none.json").write_text("{}")


def rows_of(df):
    return sorted(map(repr, df.select("file_ord", "obj_pos", F.map_entries("keys").alias("keys")).collect()))


@pytest.mark.parametrize("seed, size", [(1, "150"), (2, "1000")])
def test_objects_read_in_splits_are_those_read_whole(spark, tmp_path, seed, size):
    files_of(random.Random(seed), tmp_path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    base = f"file://{tmp_path}"
    whole = readers.read_bundles(spark, base, large=1 << 40).select("obj_pos", F.map_entries("keys").alias("keys"))
    expected = sorted(repr(r["keys"]) for r in whole.collect())
    try:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")
        found = large_bundle_objects(spark, base)
        assert found.sparkSession.read.option("lineSep", "}").text(base + "/f3.json").rdd.getNumPartitions() > 1
        each = [(r["path"].rsplit("/", 1)[-1], r["obj_pos"], json.loads(r["object"])) for r in found.collect()]
        split = sorted(repr(r["keys"]) for r in readers.read_bundles(spark, base, large=0).select(F.map_entries("keys").alias("keys")).collect())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    for k in range(4):
        document = json.loads((tmp_path / f"f{k}.json").read_text())
        assert [o for _, _, o in sorted((x for x in each if x[0] == f"f{k}.json"), key=lambda x: x[1])] == document["objects"]
        assert sorted(p for name, p, _ in each if name == f"f{k}.json") == list(range(len(document["objects"])))
    assert {name for name, _, _ in each} <= {f"f{k}.json" for k in range(4)} and split == expected


def test_small_and_large_files_are_numbered_together(spark, tmp_path):
    for k, n in enumerate([2, 300, 1]):
        (tmp_path / f"{k}.json").write_text(json.dumps({"objects": [{"id": f"m--{k}-{i}", "type": "m", "name": f"{k} {i}"} for i in range(n)]}))
    got = readers.read_bundles(spark, f"file://{tmp_path}", large=1000).select("file_ord", "obj_pos", F.col("keys")["name"].alias("name")).collect()
    assert sorted((r["file_ord"], r["obj_pos"], r["name"]) for r in got) == sorted((k, i, f"{k} {i}") for k, n in enumerate([2, 300, 1]) for i in range(n))
