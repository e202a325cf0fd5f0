"""Shared scratch tables: lineage is cut by writing and rereading Parquet.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
session (tests, notebooks) may go without: it gets a folder of its own, for there
the driver and the executors are one process. A cluster without the setting is an
error, as no folder of one machine would do.
"""

from __future__ import annotations

import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Settings while a scratch table is written. Rows are whole documents, of which
#: batches of the default length would hold tens of MB in and beside the JVM; and
#: once the table is there, nobody needs the shuffle files that led to it.
_WHILE_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Settings are the session's, so threads write in turn.
_ONE_WRITER = threading.RLock()
#: Seconds between two calls that have the executors give heap back, and when the last was.
TRIM_EVERY = 10
_TRIMMED = {"at": -1e9}


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, from the session's own setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpuslake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/corpuslake/{name}-{uuid.uuid4().hex}"


def collect_garbage(spark: SparkSession) -> None:
    """A full collection in the JVM of every executor: one short task for each core, which idle executors get evenly."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def trim(spark: SparkSession) -> None:
    """Have executors give back heap that is no longer in use, at most every TRIM_EVERY seconds.

    An executor's heap grows to its limit though little of it is alive, and never shrinks by itself; in its container
    that takes the room of the Python workers. After a full collection the JVM keeps a few times what is alive. In a
    local session the executor is the driver, and nobody is short of room."""
    if spark.sparkContext.master.split("[")[0] != "local" and time.monotonic() - _TRIMMED["at"] >= TRIM_EVERY:
        collect_garbage(spark)
        _TRIMMED["at"] = time.monotonic()


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` to ``path`` as Parquet, in folders ``by`` columns; the shuffle files that led to it go."""
    spark = df.sparkSession
    with _ONE_WRITER:
        before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").partitionBy(*by).parquet(path)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """Run ``df`` once, keep it as a table in the shared folder, and read that.

    Later steps start from the table: a lost executor costs no recomputation of
    what lies before it, and no plan grows from round to round. Tables of earlier
    cuts in ``spent`` are deleted afterwards; no later step may read them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    write_table(df, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    discard(*spent)
    trim(spark)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads, and those that a result names as its own (``reads``)."""
    for table in [t for given in tables for t in (given, *getattr(given, "reads", ()))]:
        path = getattr(table, "scratch_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            table.scratch_path = None
