"""Tables in the folder that driver and executors share: written once, read by many passes."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_local_root: str | None = None


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; in local mode without it, in a temporary folder."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local_root = root = _local_root or "file://" + tempfile.mkdtemp(prefix="kinfold-")
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """``df`` written once and read back, so that no later pass makes it again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, partitionBy=[by] if by else [])
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession):
    """Deletes what was staged inside, also after a failure; so use results inside."""
    before = len(_written)
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        while len(_written) > before:
            path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(conf).delete(path, True)
