"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_FOUND_SHARED: set[tuple[str, str]] = set()


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablelore")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABLELORE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir``.

    A checkpoint folder set on the context counts too. Only a local-mode session may
    fall back to a temporary folder, because there every task runs on this machine.
    ``file:`` is taken to be a mounted file system that all executors share. On a cluster
    a path without a scheme is tried out, once a session, if it leads to local files.
    """
    context = spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if not local and not urlsplit(configured).scheme:
            default = spark._jsparkSession.sessionState().newHadoopConf().get("fs.defaultFS", "file:///")
            if urlsplit(default).scheme == "file":
                address = f"file://{os.path.abspath(configured)}"
                if (context.applicationId, address) not in _FOUND_SHARED:
                    _try_out(spark, address)
                    _FOUND_SHARED.add((context.applicationId, address))
                return address
        return configured
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="tablelore-")
    return _LOCAL_SCRATCH[context.applicationId]


def _try_out(spark: SparkSession, address: str) -> None:
    """Refuse a folder of each machine: what tasks on all executors write there must be found again."""
    path = f"{address}/shared-{uuid.uuid4().hex}"
    tasks = 2 * spark.sparkContext.defaultParallelism
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        # the driver lists the files, tasks that need not have written them read them
        found = spark.read.schema("id bigint").parquet(path).count()
    except Exception as error:
        raise RuntimeError(f"tasks cannot write and read in {address}, set as spark.checkpoint.dir") from error
    finally:
        discard(spark, path)
    if found != tasks:
        raise RuntimeError(f"{address} is a folder of each machine; set spark.checkpoint.dir to one that all executors share")


def write_once(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute when executors are lost, and its size is
    known to the planner, so Spark itself decides whether it is small enough to
    broadcast.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediates when nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``write(df, label)`` as :func:`write_once`, into a folder that is removed at the end."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, label: write_once(df, label, folder)
    finally:
        discard(spark, folder)
