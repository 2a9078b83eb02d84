"""One document made of many rows: a JSON list, a JSON object or a GraphML file that other tools read.

Tasks write the rows' text in order, as the part files of a folder; then the parts are joined to one file, which takes
its name only when it is whole.  The parts' bytes are copied from stream to stream in the JVM, in a few KB of memory:
nothing but the joining is done by one process, and that only because one file is asked for.  Stores of parts
(``writers``) don't need it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.storage import working_folder

SEPARATOR = ",\n"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def first_character(spark: SparkSession, path: str) -> str:
    """The first character but white space of a file, or of a folder's first file that has one; else empty."""
    at, fs = _file_system(spark, path)
    if not fs.exists(at):
        return ""
    files = fs.listFiles(at, True)
    while files.hasNext():
        found = files.next()
        if found.getLen() and not found.getPath().getName().startswith(("_", ".")):
            stream = fs.open(found.getPath())
            try:
                while (byte := stream.read()) >= 0:
                    if chr(byte).strip():
                        return chr(byte)
            finally:
                stream.close()
    return ""


def write_joined(parts: Sequence[DataFrame], path: str, header: str, footer: str, separator: str = SEPARATOR) -> None:
    """Writes the ``value`` column of each of ``parts``, in their order, as one file.

    Rows are set apart by ``separator``; the last is followed by the footer instead.
    """
    spark = parts[0].sparkSession
    folder = working_folder(spark)
    for k, rows in enumerate(parts):
        rows.select("value").write.option("lineSep", separator).text(f"{folder}/{k:03d}")
    at, fs = _file_system(spark, path)
    source, source_fs = _file_system(spark, folder)
    files = []
    for k in range(len(parts)):
        listed = source_fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k:03d}"))
        files += sorted((f.getPath().getName(), f.getLen(), f.getPath()) for f in listed if f.getLen() and f.getPath().getName().startswith("part-"))
    unfinished = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.unfinished")
    out = fs.create(unfinished, True)
    try:
        out.write(bytearray(header.encode()))
        for k, (_, length, name) in enumerate(files):
            stream = source_fs.open(name)
            try:
                last = k + 1 == len(files)
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, length - (len(separator.encode()) if last else 0))
            finally:
                stream.close()
        out.write(bytearray(footer.encode()))
    finally:
        out.close()
    fs.delete(at, True)
    if not fs.rename(unfinished, at):
        raise OSError(f"{path} could not be named; the document is in {path}.unfinished")
    source_fs.delete(source, True)


def json_text(c: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def write_list(rows: DataFrame, path: str, *order: str) -> None:
    """A JSON list of the rows, nulls included, in ``order``."""
    columns = [c for c in rows.columns]
    in_order = rows.sort(*order) if order else rows
    write_joined([in_order.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}).alias("value"))], path, "[\n", "\n]\n")


def write_object(rows: DataFrame, path: str, key: str, value: Column) -> None:
    """A JSON object from a column of unlike strings to ``value`` (JSON text)."""
    write_joined([rows.sort(key).select(F.concat(json_text(F.col(key)), F.lit(": "), value).alias("value"))], path, "{\n", "\n}\n")


def write_lists_by_key(rows: DataFrame, path: str, key: str, order: Sequence[str], item: Column) -> None:
    """A JSON object from each key to the list of its rows' ``item`` (a struct; null where a key has none).

    Keys come in the order of their first rows; a key's rows are written by many tasks, so that one key may have most.
    """
    numbered = rows.select(F.col(key).alias("key"), item.alias("item"), F.struct(*order).alias("place"))
    ends = numbered.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("rows_of_key"))
    side = ends.withColumnsRenamed({"key": "of_key"})
    joined = numbered.join(side, F.col("key") == F.col("of_key"))
    opened = F.when(F.col("place") == F.col("first"), F.concat(json_text(F.col("key")), F.lit(": ["))).otherwise("")
    closed = F.when(F.col("place") == F.col("last"), F.lit("]")).otherwise("")
    text = F.concat(opened, F.coalesce(F.when(F.col("item").isNotNull(), F.to_json("item", {"ignoreNullFields": "false"})), F.lit("")), closed)
    write_joined([joined.sort("first", "key", "place").select(text.alias("value"))], path, "{\n", "\n}\n")


# -- GraphML ---------------------------------------------------------------------------------------------------------

_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="edge" attr.name="label" attr.type="string"/>
<key id="d1" for="edge" attr.name="pos" attr.type="long"/>
<graph edgedefault="directed">
"""
_FOOT = "\n</graph>\n</graphml>\n"
#: Characters that XML has no way to write; they are replaced.
_UNWRITABLE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def xml_text(c: Column) -> Column:
    """As an attribute's value or an element's text; white space survives a reader's normalisation."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return F.regexp_replace(c, _UNWRITABLE, "�")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes: name, first_pos; edges: src, dst, label, pos.  Both are written in order of their places."""
    node = F.concat(F.lit('<node id="'), xml_text(F.col("name")), F.lit('"/>'))
    ends = [F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('">')]
    data = [F.lit('<data key="d0">'), xml_text(F.col("label")), F.lit('</data><data key="d1">'), F.col("pos").cast("string"), F.lit("</data></edge>")]
    parts = [nodes.sort("first_pos", "name").select(node.alias("value")), edges.sort("pos", "src", "dst", "label").select(F.concat(*ends, *data).alias("value"))]
    write_joined(parts, path, _HEAD, _FOOT, "\n")
