"""Where written tables go: the folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; unset, a local folder, but only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for written tables."""
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
