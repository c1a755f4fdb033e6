"""Two versions of the same thing: positional diff, content gate, prefixes, offsets, coverage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.dealt import dealt_by

MISSING = "<MISSING>"


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, p, plain``: the lines of each text, numbered from 1; a null text has none."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "plain")).withColumn("p", F.col("p").cast("long") + 1)


def positional_diff(one: DataFrame, two: DataFrame, key: str = "doc_id", most: int = 60, width: int = 180) -> DataFrame:
    """Positions where the versions differ, the first ``most`` of each document, clipped; a missing side says so."""
    both = one.withColumnRenamed("plain", "a").join(two.withColumnRenamed("plain", "b"), [key, "p"], "full_outer")
    differ = both.where(~F.col("a").eqNullSafe(F.col("b")))
    differ = differ.select(key, "p", *(F.left(F.coalesce(c, F.lit(MISSING)), F.lit(width)).alias(c) for c in ("a", "b")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("p"))
    return differ.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def content_gate(one: DataFrame, two: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts, differences and the state of the candidate version."""
    both = one.withColumnRenamed("plain", "a").join(two.withColumnRenamed("plain", "b"), [key, "p"], "full_outer")
    out = both.groupBy(key).agg(F.count("a").alias("source_paragraphs"), F.count("b").alias("candidate_paragraphs"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differences"))
    state = F.when(F.col("differences") == 0, "exact").when(F.col("candidate_paragraphs") < F.col("source_paragraphs"), "unexpected_loss").when(F.col("candidate_paragraphs") > F.col("source_paragraphs"), "unexpected_excess").otherwise("content_drift")
    return out.withColumn("paragraph_count_equal", F.col("source_paragraphs") == F.col("candidate_paragraphs")).withColumn("state", state)


def frozen_prefix(one: DataFrame, two: DataFrame, first: DataFrame, fields: list[str], key: str = "doc_id", most: int = 20) -> DataFrame:
    """Rows before ``first`` (key, first) whose signature changed, the first ``most`` of each document."""
    signature = F.struct(*fields)
    a, b = one.select(key, "p", signature.alias("a")), two.select(key, "p", signature.alias("b"))
    changed = a.join(b, [key, "p"], "full_outer").join(first, key).where(F.col("p") < F.col("first")).where(~F.col("a").eqNullSafe(F.col("b")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("p"))
    return changed.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "p")


def offset_stability(one: DataFrame, two: DataFrame, offset: Column, key: str, least: int = 5, shortest: int = 4) -> DataFrame:
    """Compare ``two`` at p with ``one`` at p - offset; stable after ``least`` compared texts and no mismatch.

    Rows without a partner are errors; texts shorter than ``shortest`` prove nothing.
    """
    moved = two.withColumn("source_p", F.col("p") - offset).withColumnRenamed("plain", "b")
    pairs = moved.join(one.select(key, F.col("p").alias("source_p"), F.col("plain").alias("a")), [key, "source_p"], "left")
    checked = F.col("a").isNotNull() & (F.length("b") >= shortest)
    out = pairs.groupBy(key).agg(F.count_if(checked).alias("checked"), F.count_if(checked & (F.col("a") != F.col("b"))).alias("mismatches"), F.count_if(F.col("a").isNull()).alias("out_of_range"))
    return out.withColumn("stable", (F.col("checked") >= least) & (F.col("mismatches") == 0))


def unique_anchor(anchors: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """For each (key, anchor), the one row of the same key that contains it; otherwise how many do."""
    hits = anchors.join(rows, key, "left").where(F.col("plain").isNull() | F.contains("plain", "anchor"))
    found = hits.groupBy(key, "anchor").agg(F.count("plain").alias("hits"), F.min("p").alias("p"))
    return anchors.join(found, [key, "anchor"], "left").select(key, "anchor", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("p")).alias("p"))


def ordinal_pairs(one: DataFrame, two: DataFrame, ordinal: str) -> DataFrame:
    """Rows of both sides by ordinal, only where both sides have the same number of rows; else none."""
    counts = one.agg(F.count("*").alias("a"), F.lit(1).alias("one")).join(two.agg(F.count("*").alias("b"), F.lit(1).alias("one")), "one")
    return one.join(two, ordinal).withColumn("one", F.lit(1)).join(F.broadcast(counts.where("a = b").select("one")), "one").drop("one")


def two_way_coverage(expected: DataFrame, found: DataFrame, key: list[str], tasks: int | None = None) -> DataFrame:
    """Keys on one side only, with the side they lack; one grouping of both sides.  A key with a null is like no other.

    ``tasks``: into how many tasks the rows are dealt by key.
    """
    sides = expected.select(*key, F.lit(True).alias("__e"), F.lit(False).alias("__f")).unionByName(found.select(*key, F.lit(False).alias("__e"), F.lit(True).alias("__f")))
    both = dealt_by(sides, key, tasks).groupBy(*key).agg(F.max("__e").alias("__e"), F.max("__f").alias("__f"))
    unlike = reduce(or_, (F.col(k).isNull() for k in key))
    missing, extra = (F.when(F.col(one) & (~F.col(other) | unlike), F.lit(kind)) for one, other, kind in (("__e", "__f", "missing"), ("__f", "__e", "extra")))
    return both.where(~(F.col("__e") & F.col("__f")) | unlike).select(*key, F.explode(F.array_compact(F.array(missing, extra))).alias("kind"))


def several_owners(targets: DataFrame, scope: list[str], ordinals: str = "ordinals", owner: str = "target", tasks: int | None = None) -> DataFrame:
    """Ordinals of a map (the columns of ``scope``) that belong to more than one of its targets, or to one target twice.

    ``tasks``: into how many tasks the rows are dealt by ordinal.
    """
    each = dealt_by(targets.select(*scope, owner, F.explode(ordinals).alias("ordinal")), [*scope, "ordinal"], tasks)
    return each.groupBy(*scope, "ordinal").agg(F.count("*").alias("owners"), F.countDistinct(owner).alias("targets")).where("owners > 1")


def assembled(targets: DataFrame, exports: DataFrame, key: str, scope: list[str], joiner: str = "\n") -> DataFrame:
    """Texts of the ordinals of each target, in the order of its map; ordinals count within ``scope`` (a document)."""
    columns = list(dict.fromkeys([*scope, key]))
    each = targets.select(*columns, F.posexplode("ordinals").alias("at", "ordinal")).join(exports, [*scope, "ordinal"])
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return each.groupBy(*columns).agg(F.array_join(F.transform(parts, lambda x: x["text"]), joiner).alias("text"))


def union_flags(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Keys of either side and on which sides they are."""
    a, b = one.select(key).distinct().withColumn("a", F.lit(True)), two.select(key).distinct().withColumn("b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(False)).alias("in_one"), F.coalesce("b", F.lit(False)).alias("in_two"))


def section_equality(one: DataFrame, two: DataFrame, key: str, section: str, value: str) -> DataFrame:
    """Equal only if both have the same sections and each pair agrees."""
    both = one.select(key, section, F.col(value).alias("a"), F.lit(1).alias("x")).join(two.select(key, section, F.col(value).alias("b"), F.lit(1).alias("y")), [key, section], "full_outer")
    same = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy(key).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("equal"), F.count("x").alias("sections_one"), F.count("y").alias("sections_two"))
