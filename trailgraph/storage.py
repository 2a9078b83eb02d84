"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def _own_folder(spark: SparkSession) -> str:
    """A temporary folder that goes with the process: in local mode, all tasks run on this machine."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        folder = tempfile.mkdtemp(prefix="trailgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN.append(f"file://{folder}")
    return _OWN[0]


def working_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a temporary one (local mode only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what goes to a Python worker at once, by rows and by bytes, while a table is written; the session's settings
    are as before afterwards."""
    before = {key: spark.conf.get(key) for key in BATCH_LIMITS}
    try:
        for key, value in BATCH_LIMITS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Written and read again: cuts lineage, and survives lost executors.  ``by``: a column to have a directory a value of."""
    folder = working_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {re.split(r"/(?:[^/]*=[^/]*/)*[^/]*$", name)[0] for name in df.inputFiles()}:
            with contextlib.suppress(Exception):  # a leftover folder is no failure
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
