"""Session construction and the one place that decides where checkpoints go."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tabloom", cores: str | int = "*", shuffle_partitions: int | None = None,
                driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster submits its own settings."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the cluster names it.

    Only a local session, whose executors share this machine's disk, gets a
    temporary folder when the setting is missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tabloom-ckpt-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


TOGETHER = 8  # pieces of work whose jobs are in the scheduler at once


def together(work: list[Callable]) -> list:
    """The results of pieces of work that do not need each other. Their jobs share the cluster, so that one's
    planning and last tasks do not leave it idle."""
    if len(work) < 2:
        return [w() for w in work]
    with ThreadPoolExecutor(min(TOGETHER, len(work))) as pool:
        running = [pool.submit(w) for w in work]
        return [r.result() for r in running]
