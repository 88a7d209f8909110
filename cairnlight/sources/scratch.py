"""A folder that driver and executors share, for files that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; one process takes a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairnlight-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base}/files-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def local_path(path: str) -> str:
    """The path that Python opens: a mounted file system, the same on all machines."""
    plain = re.sub("^file:/+", "/", path)
    if "://" in plain:
        raise ValueError(f"not a mounted file system: {path}")
    return plain
