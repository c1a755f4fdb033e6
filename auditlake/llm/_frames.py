"""Small helpers that several operators share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARTS = 64
#: Rows of ids that are broadcast at most, so that the texts they choose stay where they lie (some 16 bytes a row).
FEW = 1 << 21


def chunk_bytes(total: int) -> int:
    """Bytes of text that one chunk of documents holds, about, for ``total`` bytes in all.

    Chunks and buckets both grow with the root of the corpus, so that a message from a chunk to
    a bucket stays packed; 2 MB up to some tens of gigabytes, 64 MB from some tens of terabytes.
    """
    return min(64 << 20, max(2 << 20, math.isqrt(64 * total)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset and there are no executors, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints/auditlake"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(ids: DataFrame, few: int = FEW) -> DataFrame:
    """``ids``, a table read back, to be joined without moving the other side where it has at most ``few`` rows."""
    return F.broadcast(ids) if ids.count() <= few else ids


def least_by_hash(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """The ``most`` rows of each group with the least hash of their key.

    Ranked first within ``_PARTS`` parts of a group, then among what is left, so that the last task
    holds at most ``_PARTS`` * ``most`` rows of a group, however large it is.
    """
    by_hash = [F.xxhash64(key), F.col(key)]
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(key, F.lit("part")), F.lit(_PARTS)))
    for within in ([group, "_part"], [group]):
        parts = parts.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by_hash))).where(F.col("_rank") <= most).drop("_rank")
    return parts.drop("_part")


def checked_name(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks column(s): {', '.join(missing)}")
