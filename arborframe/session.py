"""Sessions, and making the package known to Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 256
#: What Python workers, which live on between tasks, need to give freed memory back to the system.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304"}
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package; elsewhere ship it with --py-files.

    Two things of the session change for good: the environment of workers yet to start (LEAN, PYTHONPATH), and
    Arrow batches hold at most ROWS rows, as plans take that setting when they run.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    for name, value in LEAN.items():
        env.setdefault(name, value)
    # rows are whole documents: Spark's default of 10,000 a batch holds tens of MB several times over
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | more
    spark = SparkSession.builder.master(f"local[{cores}]").appName("arborframe").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
