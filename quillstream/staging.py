"""Cutting lineage through tables written to the shared checkpoint folder.

Iterative operators write each round as Parquet under the folder that the session names in
``spark.checkpoint.dir``; every executor can read it, so the loss of an executor costs a
re-read and never the round. Only where the setting is absent on a single machine (tests, a laptop)
a folder of our own is made; on a cluster its absence is an error, as executors would write to
their own disks. What a run has staged is deleted at its end, on any file system.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are deleted at its end; else they stay until the driver happens to collect its garbage.
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_root: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session, or a temporary one where the session names none."""
    global _own_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="quillstream-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged table; a missing one is no error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove what a run has left; by the file system of the session while it lives, else locally."""
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter does
        parts = urlparse(path)
        if parts.scheme in ("", "file"):
            shutil.rmtree(parts.path, ignore_errors=True)


class Staging:
    """Writes intermediate tables and deletes those that later rounds have replaced.

    ``drop_shuffles``: the shuffle files of each table are deleted, too, as soon as it is written.
    """

    def __init__(self, spark: SparkSession, label: str, drop_shuffles: bool = False):
        self.spark = spark
        self.drop_shuffles = drop_shuffles
        self.base = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_delete_at_end, spark, self.base)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written table."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        was = self.spark.conf.get(SHUFFLES, None)
        if self.drop_shuffles:
            self.spark.conf.set(SHUFFLES, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if self.drop_shuffles:
                self.spark.conf.unset(SHUFFLES) if was is None else self.spark.conf.set(SHUFFLES, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for frame in frames:
            path = getattr(frame, "_staged_path", None)
            if path:
                delete(self.spark, path)
