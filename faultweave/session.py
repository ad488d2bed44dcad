"""Where intermediate tables go and how long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a fresh temporary folder; on a
    cluster a machine-local folder would be unreadable from other executors.
    """
    sc = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows once to the shared folder and go on from the written copy.

    A Parquet copy outlives lost executors, lets each reader take only its columns, and
    has a known size by which Spark chooses joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    written = _written.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropping_tables(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that were materialised inside, at the end.

    For work whose results have been written by then: a micro-batch, or a batch run that
    writes its result inside. Without it they stay in the shared folder.
    """
    written: list[str] = []
    token = _written.set(written)
    try:
        yield
    finally:
        _written.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in written:
            path = hadoop.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_this_context(work: Callable) -> Callable:
    """``work`` for another thread, noting its tables where this thread does."""
    context = copy_context()
    return lambda: context.run(work)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
