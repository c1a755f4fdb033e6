"""Ordinals, offsets, occurrences and running depth.  Every window is partitioned by its document or smaller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, within: list[str], order: list, name: str) -> DataFrame:
    """1-based place in ``order`` within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


def offsets(df: DataFrame, within: list[str], order: list, text: str, name: str = "run_start") -> DataFrame:
    """Characters of all earlier rows; empty rows advance by nothing."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)).cast("long"))


def occurrence(df: DataFrame, within: list[str], text: str, order: list, name: str = "occurrence") -> DataFrame:
    """Which time the same text appears in its group."""
    return ordinal(df, [*within, text], order, name)


def clamped_depth(df: DataFrame, within: list[str], order: list, step: Column, name: str = "depth") -> DataFrame:
    """Running sum that never falls below zero: the sum less the least prefix sum, where that is negative."""
    so_far = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__sum", F.sum(step).over(so_far))
    return df.withColumn(name, (F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(so_far))).cast("long")).drop("__sum")


def complete(df: DataFrame, within: list[str], number: str, total: Column | None = None) -> DataFrame:
    """Whether the numbers of each group are exactly 1..total: finds missing, repeated and out-of-range ones.  Without a total the highest number is it.

    Uses counts, not lists, so that a large group is never gathered.
    """
    n = F.col(number)
    most = F.max(n if total is None else total)
    inside = F.count_if(n >= 1 if total is None else n.between(1, total))
    return df.groupBy(*within).agg(((F.count("*") == most) & (inside == most) & (F.countDistinct(number) == most)).alias("complete"))


def allocated(df: DataFrame, existing: DataFrame, key: str, order: list, name: str = "new_id") -> DataFrame:
    """New ids after the greatest existing one of each key."""
    top = existing.groupBy(key).agg(F.max("id").alias("__top"))
    df = ordinal(df.join(top, key, "left"), [key], order, "__n")
    return df.withColumn(name, F.coalesce("__top", F.lit(0)) + F.col("__n")).drop("__n", "__top")
