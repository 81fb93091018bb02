"""Written intermediate tables and the shared folder they live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_DIR_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: what the session names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a cluster a machine-local
    folder would be lost with its executor, so there the setting is required.
    """
    named = spark.conf.get(_DIR_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_DIR_SETTING} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="precis-"))
    return spark.sparkContext.getCheckpointDir()


_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder, or below that of the current run, that nothing else uses."""
    return f"{_RUN.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside go to one folder, which is removed at the end.

    Results must have been written or gathered by then, because they are read from these tables.
    """
    folder = fresh_path(spark, "run")
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove an intermediate table that no later job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder, or to the given path, and read it back.

    Cuts the lineage where several later passes need the same result: a lost executor costs a
    re-read, each pass prunes columns, and the planner sees the true size of the table.
    """
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)



def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like :func:`staged`, dealt out and sorted by ``keys``, so that later joins and sums on them move no row of it.

    Has as many buckets as the session has shuffle partitions. The files are below the shared folder; the
    session's catalog only names them.
    """
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    dealt = df.repartition(n, *keys)
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)
