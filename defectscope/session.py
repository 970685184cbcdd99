"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED_DIR: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "defectscope", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; `conf` overrides any of them.

    No shuffle partition count is forced: on a cluster AQE coalesces from
    `spark.sql.adaptive.coalescePartitions.initialPartitionNum`.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local master may run without the setting; it then gets one temporary
    folder per application, because driver and executors share the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_SHARED_DIR:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            _LOCAL_SHARED_DIR[app] = tempfile.mkdtemp(prefix="defectscope-")
        configured = _LOCAL_SHARED_DIR[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written between two stages of one job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: for wide frames that later steps read in part."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
