"""Cutting lineage with written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in local mode only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="docpool-")
    return _OWN[context.applicationId]


def materialize(df: DataFrame, name: str = "table", outlives: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame it survives the loss of executors, and what follows
    does not compute df again. The files go when the JVM ends, or at the end of a `scratch` around the call; with
    `outlives`, at the end of the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docpool-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(target)
    paths = getattr(_WRITTEN, "outer" if outlives else "paths", None)
    if paths is not None:
        paths.append((files, target))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, in the end, what this thread materializes inside; what is to outlive it must have been written or collected."""
    outer, above = getattr(_WRITTEN, "paths", None), getattr(_WRITTEN, "outer", None)
    _WRITTEN.paths, _WRITTEN.outer = [], outer
    try:
        yield
    finally:
        for files, target in _WRITTEN.paths:
            files.delete(target, True)
            files.cancelDeleteOnExit(target)
        _WRITTEN.paths, _WRITTEN.outer = outer, above
