"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Without its native library Hadoop sets the mode of each local folder and file by a child process, which until it runs its
#: own program has all of the executor's memory. A part costs three with Hadoop's checksums beside it and two without; these
#: options of a write leave them out for tables that live as long as the application.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_ROOTS: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when Python ends.

    Only where that setting is absent and the master is local (tests, local use) a temporary folder
    stands in: on a cluster each executor would write to a disk of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="seqlake-")
        _ROOTS[app] = f"{base.rstrip('/')}/seqlake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _ROOTS[app])
    return _ROOTS[app]


def remove(spark: SparkSession, folder: str) -> None:
    """A folder and all in it, unless the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables stored inside are removed at its end: for a step whose result has by then been written elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.options(**PLAIN).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
