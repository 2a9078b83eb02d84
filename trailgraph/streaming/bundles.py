"""New bundle files as a stream of objects; edges are made of all objects so far when the store is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.sources.readers import in_order, keyed_objects


def stream_objects(spark: SparkSession, base: str) -> DataFrame:
    """``file, obj_pos, object``: the objects of files as they come, as JSON text; a file is its time and its path."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(base, wholetext=True)
    file = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"))
    parsed = files.select(file.alias("file"), F.from_json("value", "objects array<string>").alias("bundle")).filter("bundle.objects is not null")
    return parsed.select("file", F.posexplode("bundle.objects").alias("obj_pos", "object"))


def append_objects(spark: SparkSession, base: str, store: str, checkpoint: str):
    """Starts a query that appends the objects of new files to a Parquet store, and ends when none is left."""
    return stream_objects(spark, base).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_objects(spark: SparkSession, store: str) -> DataFrame:
    """``file_ord, obj_pos, keys, kinds`` of all objects of the store, files in order of time, then path: what
    ``bundle_edges`` takes, relationships between objects of different files too."""
    objects = spark.read.parquet(store)
    places = in_order(objects.select("file").distinct(), "file").select(F.col("file").alias("__file"), F.col("number").alias("file_ord"))
    return keyed_objects(objects.join(places, F.col("file") == F.col("__file")))
