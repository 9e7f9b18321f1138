"""Folders that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: local sessions without a shared folder: one JVM, which any temporary folder serves
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes with the session. Only a local master may leave that setting out."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="trackmill-"))
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
