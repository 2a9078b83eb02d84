"""Edge stores by bucket of the source: a hop joins them without moving an edge.

Edges are dealt to a fixed number of buckets by their source, and each label's bucket is one file, sorted by source.  A
join on the source shuffles the frontier to the same buckets and merges; the edges stay where they are.  Two stores (or
a store and what is derived from it by source) with as many buckets move nothing at all.

A store is Parquet below a path, and a table of the session's catalog, which holds how it is bucketed: ``opened``
registers a path in a new session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of one bucket, about.
BUCKET_EDGES = 4_000_000


def buckets_for(n: int) -> int:
    """Buckets of a store of n edges."""
    return max(1, -(-n // BUCKET_EDGES))


def write_bucketed(edges: DataFrame, path: str, table: str, buckets: int) -> DataFrame:
    """Writes ``src, dst, label, pos`` and gives the store's edges.  A task writes one bucket of all labels, so that a label has
    one file a bucket.  A source that very many edges have is one bucket's: its edges are one run in one file."""
    dealt = edges.select("src", "dst", "pos", "label").repartition(buckets, "src")
    writer = dealt.write.format("parquet").partitionBy("label").bucketBy(buckets, "src").sortBy("src")
    writer.mode("overwrite").option("path", path).saveAsTable(table)
    return opened(edges.sparkSession, path, table, buckets)


def opened(spark: SparkSession, path: str, table: str, buckets: int) -> DataFrame:
    """The edges of a store that ``write_bucketed`` wrote below ``path`` with so many buckets."""
    if not spark.catalog.tableExists(table):
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} (src STRING, dst STRING, pos BIGINT, label STRING) USING parquet "
            f"PARTITIONED BY (label) CLUSTERED BY (src) SORTED BY (src) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
        )
        spark.catalog.recoverPartitions(table)
    return spark.table(table).select("src", "dst", "label", "pos")


def bucketed_like(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    """Rows dealt as a store of so many buckets is, for joins that then move neither side."""
    return rows.repartition(buckets, F.col(column))
