"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. In local mode (tests) a local one stands in where none is named;
    elsewhere a machine's folder isn't shared, so none is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or "/tmp/checkpoints/quarry"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared one; what is there is removed when the driver ends."""
    folder = f"{checkpoint_folder(spark)}/{name}_{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
