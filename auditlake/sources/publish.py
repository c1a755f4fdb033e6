"""Publishing a table only after it was read back and found right."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


def publish(df: DataFrame, path: str, holds: Callable[[DataFrame], bool]) -> None:
    """Write beside ``path``, read back, check, and rename; nothing is left at ``path`` where the check fails.

    Refuses a path that exists; the rename is one step of the file system that holds the folder.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    try:
        df.write.parquet(staged.toString())
        if not holds(spark.read.schema(df.schema).parquet(staged.toString())):
            raise ValueError(f"what was written for {path} does not hold")
        if not files.rename(staged, target):
            raise OSError(f"{path} could not be renamed")
    finally:
        files.delete(staged, True)
