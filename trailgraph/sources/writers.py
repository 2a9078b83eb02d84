"""Edge stores, logs, question lists, maps and splits.  All go through Spark's writers: any store, committed once."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgraph.functions.text import joined_variations
from trailgraph.operators.graph import nodes
from trailgraph.operators.splits import update_targets
from trailgraph.sources import documents


def write_edges(edges: DataFrame, path: str) -> None:
    """Parquet, one directory a label: a step over a label reads that directory alone.  Edges are brought together by label, and
    a label that is larger than a partition ought to be is dealt to several tasks by its size: small labels are one file,
    and one that most edges have is not one task's."""
    edges.hint("rebalance", "label").write.partitionBy("label").mode("overwrite").parquet(path)


def write_sorted_edges(edges: DataFrame, path: str) -> None:
    """Parquet, a file a task, in order of label and place: a step over a label reads that label's pages alone.  No edge is moved
    for it.  Neighbours are alike, so that columns are kept as differences, without dictionaries."""
    ordered = edges.sortWithinPartitions("label", "pos").write.option("compression", "zstd").mode("overwrite")
    ordered.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(path)


def write_graphml(edges: DataFrame, path: str) -> None:
    """One GraphML document: nodes, then edges, with their labels and places."""
    documents.write_graphml(nodes(edges), edges, path)


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("", "src", F.lit(" - "), "label", F.lit(" -> "), "dst").alias("value"))


def write_edge_log(edges: DataFrame, path: str) -> None:
    edge_lines(edges).write.mode("overwrite").text(path)


def write_questions(items: DataFrame, path: str, document: bool = False) -> None:
    """A folder of JSON lines, or (``document``) one JSON list."""
    if document:
        documents.write_list(items, path, *items.columns)
    else:
        items.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def write_sections(items: DataFrame, path: str, document: bool = False, sections: DataFrame | None = None) -> None:
    """A folder of JSON lines, or (``document``) one JSON object from section to its questions.

    sections: further sections, which have an empty list in the document.
    """
    if not document:
        items.write.option("ignoreNullFields", "false").mode("overwrite").json(path)
        return
    rows = items.select("section", "idx", "question", F.struct("question", "response").alias("item"))
    if sections is not None:
        none = sections.select("section").distinct().join(items.select("section").distinct(), "section", "left_anti")
        rows = rows.unionByName(none.select("section", F.lit(0).alias("idx"), F.lit(None).cast("string").alias("question"), F.lit(None).cast(rows.schema["item"].dataType).alias("item")))
    # Equal rows differ by their number, so that one of them is the first and one the last.
    placed = rows.withColumn("number", F.row_number().over(Window.partitionBy("section", "idx", "question").orderBy("item")))
    documents.write_lists_by_key(placed, path, "section", ["section", "idx", "question", "number"], F.col("item"))


def write_relation_map(histogram: DataFrame, path: str, document: bool = False) -> None:
    """An object a label, from target type to count: JSON lines, or (``document``) one object from label to its object."""
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("target_type", "n"))))
    rows = histogram.groupBy("label").agg(each.alias("types"))
    if document:
        documents.write_object(rows, path, "label", F.to_json("types"))
    else:
        rows.write.mode("overwrite").json(path)


def write_variations(rows: DataFrame, path: str) -> None:
    """``question, variations`` (arrays, or text as it is) as the two-column CSV."""
    listed = rows.schema["variations"].dataType.typeName() == "array"
    out = rows.select(F.col("question").alias("Original Question"), joined_variations(F.col("variations"), listed).alias("Variations"))
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; quotes are doubled, and a value may have several lines."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_splits(rows: DataFrame, folder: str) -> None:
    """A CSV directory for each of train, validation and test."""
    for split in ("train", "validation", "test"):
        rows.filter(F.col("split") == split).drop("split").write.mode("overwrite").csv(f"{folder}/{split}.csv", header=True, escape='"')


def write_targets(rows: DataFrame, path: str, dry_run: bool = False, backup: bool = True) -> str | None:
    """Writes rewritten rows to a new version below ``path``, as JSON lines; earlier ones are the backup.  Returns where, or
    nothing for a dry run."""
    if dry_run:
        return None
    version = "current"
    if backup:
        jvm = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
        version = f"v{len(fs.listStatus(jvm)) if fs.exists(jvm) else 0:05d}"
    rows.write.option("ignoreNullFields", "false").mode("overwrite").json(f"{path}/{version}")
    return f"{path}/{version}"


# -- template documents: small, on the driver ---------------------------------------------------------------------------


def document_questions(spark: SparkSession, document: Mapping) -> DataFrame:
    """``section, at, question, target`` (JSON text) of the entries of a template document that have a question."""
    found = [
        (section, at, entry["question"], json.dumps(entry.get("target"), ensure_ascii=False))
        for section, entries in document["templates"].items() if isinstance(entries, list)
        for at, entry in enumerate(entries) if isinstance(entry, Mapping) and entry.get("question")
    ]
    return spark.createDataFrame(found, "section string, at int, question string, target string")


def updated_document(spark: SparkSession, document: Mapping, targets: DataFrame) -> tuple[dict, int, int]:
    """The document with each question's new target where there is one, and the questions scanned and changed.

    targets: question, new_target.  A document is small: its changed entries come back to the driver.
    """
    rows = document_questions(spark, document)
    spelled = targets.select("question", F.when(F.col("new_target") != "", documents.json_text(F.col("new_target"))).alias("new_target"))
    changed = update_targets(rows, spelled).filter("updated").collect()
    new = {(r["section"], r["at"]): json.loads(r["target"]) for r in changed}
    sections = {
        section: [{**entry, "target": new[section, at]} if (section, at) in new else entry for at, entry in enumerate(entries)] if isinstance(entries, list) else entries
        for section, entries in document["templates"].items()
    }
    return {**document, "templates": sections}, rows.count(), len(new)


def yaml_lines(value: object, indent: int = 0) -> list[str]:
    """Mappings and lists of mappings in block style, all else in flow style with JSON's spelling, which YAML reads alike."""
    pad = "  " * indent
    if isinstance(value, Mapping) and value:
        out = []
        for key, item in value.items():
            nested = yaml_lines(item, indent + 1) if isinstance(item, Mapping) and item or isinstance(item, list) and any(isinstance(x, Mapping) for x in item) else None
            out += [f"{pad}{json.dumps(key, ensure_ascii=False)}:", *nested] if nested else [f"{pad}{json.dumps(key, ensure_ascii=False)}: {json.dumps(item, ensure_ascii=False)}"]
        return out
    if isinstance(value, list):
        out = []
        for item in value:
            first, *rest = yaml_lines(item, indent + 1)
            out += [f"{pad}- {first.lstrip()}", *rest]
        return out
    return [f"{pad}{json.dumps(value, ensure_ascii=False)}"]


def write_document(spark: SparkSession, document: Mapping, path: str, backup: bool = True) -> None:
    """A template document as JSON or, by its name, YAML, through Hadoop's file systems; what was there goes to ``.bak``."""
    as_yaml = path.lower().endswith((".yaml", ".yml"))
    text = "\n".join(yaml_lines(document)) + "\n" if as_yaml else json.dumps(document, ensure_ascii=False, indent=2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if backup and fs.exists(target):
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, jvm.org.apache.hadoop.fs.Path(path + ".bak"), False, True, conf)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
