"""Session settings used by the jobs, the bench and the tests."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """Session with the engine's defaults; a cluster's own spark-defaults win for all else."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it is removed when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def stored(df, name: str):
    """``df`` written to the shared folder and read again, for plans that use it several times."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        removed(spark, folder)
    except Exception:  # the JVM has gone already; the cluster's own clean-up has to do it
        pass


def shared_folder(spark: SparkSession) -> str:
    """Shared folder for staged tables, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a folder of its own; a cluster must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return folder
