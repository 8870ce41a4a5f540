"""Session helpers: a builder for local use and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "mendery", cores: int | str = "*", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class NoSharedFolder(RuntimeError):
    """A cluster session without a folder for intermediate tables."""


def is_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made, but only if driver and executors are one
    process (``local`` masters). Anywhere else each executor would write to a disk of its own and rows would
    be lost without an error, so that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(found)
        return found.rstrip("/")
    if context.getCheckpointDir() is None:
        if not is_one_process(context.master):
            raise NoSharedFolder(
                f"The master is {context.master}: set spark.checkpoint.dir to a folder that the driver and all executors share"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="mendery-"))
    return context.getCheckpointDir().rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("scratch paths of the work at hand", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    paths = _made.get()
    if paths is not None:
        paths.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path that the caller made, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the scratch paths that were handed out inside. Nothing else is touched.

    For work that has written all its results by then; a frame that is still to be read must not depend on
    a path from here.
    """
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(token)
        for path in paths:
            remove_path(spark, path)


def settle_table(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage with files that outlive executors, and gives later plans the real size of the
    data, so that Spark can choose a broadcast by fact instead of by estimate.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
