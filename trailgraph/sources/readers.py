"""Bundles, graphs, templates, variations, names, relation texts, questions and splits as DataFrames."""

from __future__ import annotations

import json
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trailgraph.functions.text import pick, strip, variations
from trailgraph.sources import documents, yaml_documents
from trailgraph.sources.large_bundles import large_bundle_objects
from trailgraph.storage import stored


#: Bytes of a bundle file beyond which it is read in splits.
LARGE_BUNDLE = 1 << 27


def read_bundles(spark: SparkSession, base: str, large: int = LARGE_BUNDLE) -> DataFrame:
    """``file_ord, obj_pos, keys, kinds``: the objects of all JSON files below ``base``, files in path order.

    A file that doesn't parse, or an object without id and type, is left out.  A file of more than ``large`` bytes is never
    one string.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(base, wholetext=True)
    path = F.col("_metadata.file_path").alias("path")
    small = files.filter(F.col("_metadata.file_size") <= large).select(path, "value")
    names = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").format("binaryFile").load(base).select("path", "length")
    has_large = not names.filter(F.col("length") > large).isEmpty()
    parsed = small.select("path", F.from_json("value", "objects array<string>").alias("bundle")).filter("bundle.objects is not null")
    objects = parsed.select("path", F.posexplode("bundle.objects").alias("obj_pos", "object"))
    if has_large:
        objects = stored(objects.unionByName(large_bundle_objects(spark, base, large)))
    ranked = in_order((objects.select("path") if has_large else small.select("path")).distinct(), "path").withColumnRenamed("number", "file_ord")
    return keyed_objects(objects.join(ranked, "path"))


def in_order(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``number``, from 0, in the column's order: rows are sorted by ranges of it, and each range starts where the ones
    before it end, so that no task needs all rows."""
    placed = stored(rows.sort(column).withColumn("__at", F.monotonically_increasing_id()))
    part, bits = F.shiftright("__at", 33), (1 << 33) - 1
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return placed.join(starts, part == F.col("__part")).withColumn("number", F.col("__start") + F.col("__at").bitwiseAND(F.lit(bits))).drop("__at", "__part", "__start")


def objects_of(files: DataFrame) -> DataFrame:
    """``file_ord, obj_pos, keys, kinds`` from ``file_ord, value``: an object's keys in order, as text and as variants, which
    tell what each value is."""
    parsed = files.select("file_ord", F.from_json("value", "objects array<string>").alias("bundle")).filter("bundle.objects is not null")
    return keyed_objects(parsed.select("file_ord", F.posexplode("bundle.objects").alias("obj_pos", "object")))


@F.pandas_udf(StringType())
def last_of_repeats(objects: pd.Series) -> pd.Series:
    """JSON objects whose repeated keys, nested ones too, are one: with the last value, at the first one's place."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False)
        except ValueError:
            return None

    return objects.map(one)


#: Stated as not deterministic, so that the filters over what it gives stay above it: below it they would run it, and parse, once more.
_spelled_once = last_of_repeats.asNondeterministic()


def keyed_objects(objects: DataFrame) -> DataFrame:
    """The same from ``file_ord, obj_pos, object`` (JSON text).

    A variant can't have a key twice, and a map has both: only objects with repeated keys are spelled anew first.  Objects are
    dealt before they are parsed: a file, or a small table that they are made of, is one task's."""

    def maps(text: F.Column) -> dict[str, F.Column]:
        return {"keys": F.from_json(text, "map<string,string>"), "kinds": F.from_json(text, "map<string,variant>")}

    keyed = objects.select("file_ord", "obj_pos", "object").repartition("file_ord", "obj_pos").withColumns(maps(F.col("object")))
    names = F.map_keys("keys")
    repeated = F.col("keys").isNotNull() & (F.col("kinds").isNull() | (F.size(names) != F.size(F.array_distinct(names))))
    spelled = keyed.withColumn("spelled", _spelled_once(F.when(repeated, F.col("object"))))
    again = {k: F.when(F.col("spelled").isNotNull(), c).otherwise(F.col(k)) for k, c in maps(F.col("spelled")).items()}
    keyed = spelled.withColumns(again).drop("spelled", "object")
    return keyed.filter(F.col("keys")["id"].isNotNull() & (F.col("keys")["id"] != "") & F.col("keys")["type"].isNotNull() & (F.col("keys")["type"] != ""))


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, label, pos`` of a GraphML file's edges: the data whose key is named "label", and the place by the key named
    "pos", else in order of the file."""
    def elements(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)

    keys = elements("key", "_id string, _for string, `_attr.name` string").filter("_for is null or _for in ('edge', 'all')")
    named = {r["_attr.name"]: r["_id"] for r in keys.collect()}  # one row an attribute
    edges = elements("edge", "_source string, _target string, data array<struct<_VALUE:string,_key:string>>")

    def value(name: str) -> F.Column:
        wanted = named.get(name, "d0" if name == "label" else None)
        return F.try_element_at(F.filter("data", lambda d: d["_key"] == F.lit(wanted)), F.lit(1))["_VALUE"]

    place = F.coalesce(value("pos").try_cast("long"), F.monotonically_increasing_id())
    return edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(value("label"), F.lit("")).alias("label"), place.alias("pos"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet store, one directory a label."""
    return spark.read.schema("src string, dst string, pos long, label string").parquet(path).select("src", "dst", "label", "pos")


def read_names(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    names = spark.read.text(path).select(strip(F.col("value")).alias("name"))
    return (names if keep_blank else names.filter("name != ''")).distinct()


def read_relation_texts(spark: SparkSession, path: str) -> DataFrame:
    """``source, target, description, line_no`` of lines "SOURCE: a, TARGET: b, DESCRIPTION: c"; others are left out."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    return parse_relation_texts(lines)


def parse_relation_texts(lines: DataFrame) -> DataFrame:
    def field(name: str) -> F.Column:
        return F.regexp_extract("value", rf"(?s){name}:(.*)", 1)

    whole = lines.filter(F.col("value").contains("SOURCE:") & F.col("value").contains("TARGET:") & F.col("value").contains("DESCRIPTION:"))
    cut = whole.select(
        strip(F.substring_index(field("SOURCE"), ",", 1)).alias("source"), strip(F.substring_index(field("TARGET"), ",", 1)).alias("target"),
        strip(field("DESCRIPTION")).alias("description"), "line_no",
    )
    return cut.filter("source != '' and target != ''")


def templates_of(spark: SparkSession, document: dict) -> DataFrame:
    """``section, idx, question, path, target`` of a parsed template document; entries that aren't objects are left out."""
    rows = [(s, i, e["question"], list(e["path"]), [e["target"]] if isinstance(e["target"], str) else list(e["target"])) for s, entries in (document.get("templates") or {}).items() if isinstance(entries, list) for i, e in enumerate(entries) if isinstance(e, dict)]
    return spark.createDataFrame(rows, "section string, idx int, question string, path array<string>, target array<string>")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates of a YAML file or of a JSON file of the same form."""
    return templates_of(spark, read_document(spark, path))


def read_document(spark: SparkSession, path: str) -> dict:
    """A template document (one small file) on the driver."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text) if is_json(path) else yaml_documents.load(text)


def is_json(path: str) -> bool:
    return PurePath(path).suffix.lower() == ".json"


def is_yaml(path: str) -> bool:
    return PurePath(path).suffix.lower() in (".yaml", ".yml")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whichever file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def require(spark: SparkSession, path: str, label: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"{label} not found: {path}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_variations(spark: SparkSession, path: str, repeated: str = "first") -> DataFrame:
    """``question, variations``; without the file, no row.  ``repeated``: the row of a repeated question that counts, "first"
    (as for questions) or "last" (as for targets)."""
    if not exists(spark, path):
        return spark.createDataFrame([], "question string, variations array<string>")
    rows = read_csv(spark, path).withColumn("line", F.monotonically_increasing_id())
    picked = F.min_by if repeated == "first" else F.max_by
    one = rows.groupBy(F.col("Original Question").alias("question")).agg(picked(F.struct("Variations"), "line").alias("row"))
    return one.select("question", variations(F.coalesce("row.Variations", F.lit(""))).alias("variations"))


def target_map(rows: DataFrame, policy: str) -> DataFrame:
    """``question, new_target`` of ``question, variations`` text rows, by ``first`` or ``longest``; blank ones are left out."""
    cut = rows.select(strip(F.col("question")).alias("question"), pick(variations(F.col("variations"), ";"), policy).alias("new_target"))
    return cut.filter("question != '' and new_target is not null")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Objects of {question, response}: a JSON list, or JSON lines; a file, or a folder of either."""
    return spark.read.option("multiLine", documents.first_character(spark, path) == "[").json(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """``question, section, ord`` of a JSON object from section to questions, or of a folder of JSON lines that have both."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.read.schema("question string, section string").json(path).select("question", "section", F.monotonically_increasing_id().alias("ord"))
    whole = spark.read.text(path, wholetext=True)
    by_section = whole.select(F.from_json("value", "map<string,array<struct<question:string,response:string>>>").alias("m"))
    flat = by_section.select(F.posexplode("m").alias("section_ord", "section", "items"))
    return flat.select("section", "section_ord", F.posexplode("items").alias("item_ord", "item")).select(F.col("item.question").alias("question"), "section", (F.col("section_ord") * F.lit(1 << 32) + F.col("item_ord")).alias("ord"))


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """``split, Question, Path`` of the three CSV files that are there; both columns are asked for, nulls left out."""
    return all_splits(spark, folder).dropna(subset=["Question", "Path"])


def dropped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``split, scanned, dropped``: how many rows of each split lack a question or a path."""
    lacks = F.col("Question").isNull() | F.col("Path").isNull()
    return all_splits(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(lacks).alias("dropped"))


def all_splits(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the three CSV files that are there, with ``split``."""
    parts = []
    for split in ("train", "validation", "test"):
        path = f"{folder}/{split}.csv"
        if exists(spark, path):
            rows = read_csv(spark, path)
            missing = {"Question", "Path"} - set(rows.columns)
            if missing:
                raise ValueError(f"{path} lacks {sorted(missing)}")
            parts.append(rows.withColumn("split", F.lit(split)))
    if not parts:
        raise FileNotFoundError(f"no split in {folder}")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def questions_to_csv_columns(items: DataFrame) -> DataFrame:
    """With the column names of the CSV files."""
    return items.withColumnRenamed("question", "Question")
