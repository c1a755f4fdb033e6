"""Exact duplicates: group, process once, restore; inverse index of shared targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer duplicates than this are not worth a cache.
LEAST_DUPLICATES = 64


def templates(df: DataFrame, content: str, key: str) -> DataFrame:
    """``key``, ``template`` (the least key with the same content) and ``copies``.

    Contents are grouped by their SHA-256, so that large ones are not shuffled; a hot content is
    pre-aggregated, and AQE splits its join.
    """
    hashed = df.select(key, F.sha2(F.col(content), 256).alias("__h"))
    groups = hashed.groupBy("__h").agg(F.min(key).alias("template"), F.count("*").alias("copies"))
    return hashed.join(groups, "__h").select(key, "template", "copies")


def duplicate_summary(df: DataFrame, content: str) -> DataFrame:
    each = df.groupBy(F.sha2(F.col(content), 256).alias("h")).count()
    return each.agg(F.sum("count").alias("total"), F.count("*").alias("distinct_contents"), F.sum(F.col("count") - 1).alias("duplicates"), F.count_if(F.col("count") > 1).alias("groups"))


def worth_caching(summary: DataFrame, least: int = LEAST_DUPLICATES) -> DataFrame:
    return summary.select("duplicates", (F.col("duplicates") >= least).alias("allowed"))


def once_each(df: DataFrame, content: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``process`` on the distinct contents alone (columns ``h`` and the content) and bring its columns back to every row."""
    keyed = df.withColumn("h", F.sha2(F.col(content), 256))
    done = process(keyed.select("h", content).dropDuplicates(["h"])).drop(content)
    return keyed.join(done, "h").drop("h")


def shared_targets(df: DataFrame, target: str, key: str) -> DataFrame:
    """Targets that several keys point to: ``target``, sorted ``keys``, reported at the least of them."""
    groups = df.groupBy(target).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return groups.where(F.size("keys") > 1).withColumn(key, F.get("keys", F.lit(0)))
