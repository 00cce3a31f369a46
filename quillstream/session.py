"""Session factory with the settings the engine's expressions rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def get_session(app: str = "quillstream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, last-win map keys, AQE and Arrow transfer.

    ``master`` is used only when no session is active; on a cluster leave it unset.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, shuffle: int = 8, **conf: str) -> SparkSession:
    """A single-node session for tests and the benchmark."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return get_session(
        master=f"local[{n}]",
        **{
            "spark.sql.shuffle.partitions": str(shuffle),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            **conf,
        },
    )
