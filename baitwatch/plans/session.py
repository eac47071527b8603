"""Session settings for local runs and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("baitwatch")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_local: dict[str, str] = {}


def _run_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared folder."""
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if not shared:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{CHECKPOINT_DIR} has to name a shared folder on {master}")
    run = spark.sparkContext.applicationId
    if not shared:
        shared = _local.get(run) or _local.setdefault(run, tempfile.mkdtemp(prefix="baitwatch-"))
    return f"{shared.rstrip('/')}/run-{run}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is not set, a temporary folder stands in for it if the master is
    ``local[...]``, where there is one machine only. Elsewhere that is an error. All folders
    of an application have one parent, which ``clear_work`` removes.
    """
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Removes one work folder of this application that nothing reads any more."""
    if not folder.startswith(f"{_run_folder(spark)}/"):
        raise ValueError(f"{folder} is no work folder of this application")
    _remove(spark, folder)


def clear_work(spark: SparkSession) -> None:
    """Removes all work folders of this application, once its results are stored elsewhere."""
    _remove(spark, _run_folder(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
