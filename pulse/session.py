"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pulse")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


#: The folder of the innermost ``scratch`` block.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path on it, as Spark itself takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A block whose shared folders are removed at its end, also after an error.

    Results have to be written or collected within the block: a frame that still reads a removed folder fails.
    """
    folder = shared_dir(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        system, place = hadoop_path(spark, folder)
        system.delete(place, True)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Only a local master may fall back to a temporary folder: on a cluster the executors could not
    see it, so a missing setting is an error there. A folder without a scheme is on the default file system, and
    gets that one's name if it is not the local one, so that whoever opens it without Spark finds the same. Within
    a ``scratch`` block the folder is in the block's.
    """
    if _scratch.get():
        return f"{_scratch.get()}/{label}-{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        _, place = hadoop_path(spark, root)
        if place.toUri().getScheme() != "file":
            root = place.toString()
    return f"{root.rstrip('/')}/pulse-{label}-{uuid.uuid4().hex}"
