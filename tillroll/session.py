"""Session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(app: str, cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set; pass the folder to write to")
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """``shared_folder``; on one machine that names none, a temporary folder becomes it."""
    if is_local(spark) and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-"))
    return shared_folder(spark)


def at_once(spark: SparkSession, *jobs: Callable[[], Any]) -> list:
    """The results of ``jobs``, run at the same time: one's last tasks leave no cores idle."""
    inherit = inheritable_thread_target(spark)
    # Without pinned threads there is nothing to inherit.
    run = inherit(lambda job: job()) if callable(inherit) else lambda job: job()
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(run, jobs))


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in this process (``local-cluster`` is a cluster)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def hadoop_path(spark: SparkSession, folder: str):
    """The Hadoop file system of ``folder`` and its path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(path)


def require_reachable(spark: SparkSession, folder: str) -> str:
    """``folder``, unless it lies on the disk of one machine while tasks run on others.

    What lies below ``spark.checkpoint.dir`` is shared by that setting's meaning.
    """
    if is_local(spark):
        return folder
    files, path = hadoop_path(spark, folder)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    shared = named and str(path).startswith(str(hadoop_path(spark, named)[1]).rstrip("/") + "/")
    if files.getUri().getScheme() == "file" and not shared:
        raise ValueError(f"{folder} is a local folder; executors on other machines would not share it")
    return folder
