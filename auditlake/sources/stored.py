"""Tables written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table under spark.checkpoint.dir: its work is done once, and a lost executor costs the tasks it had.

    The setting is required on a cluster; without executors (tests) a folder of this machine takes its place.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints/auditlake"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
