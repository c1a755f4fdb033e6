"""Edits as tables: positions in a paragraph's text are found, then dealt to the nodes that hold them.

An edit is (document, node, offset, old, new); whatever writes packages applies the rows and
nothing else, and refuses where ``old`` is not what it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a token puts into a paragraph's text.
MARKS = {"br": "\n", "tab": "\t", "object": "￼", "math": "￼", "drawing": "￼"}


def projected(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Each token's text, and where it begins and ends in its paragraph (0-based, end excluded)."""
    text = F.when(F.col("kind") == "text", F.coalesce("text", F.lit("")))
    for kind, mark in MARKS.items():
        text = text.when(F.col("kind") == kind, mark)
    rows = tokens.withColumn("shown", text.otherwise(""))
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("shown")).over(w).cast("long"))
    return rows.withColumn("start", F.col("end") - F.length("shown"))


def paragraph_text(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), "").alias("plain"))


def match_ends(texts: DataFrame, key: list[str], pattern: str) -> DataFrame:
    """0-based position of the last character of each match, for matches that stand for themselves (no overlap)."""
    parts = F.split(F.regexp_replace("plain", f"({pattern})", "$1\u0001"), "\u0001")
    sizes = F.transform(parts, lambda x: F.length(x))
    each = texts.select(*key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))).alias("n", "upto"), F.size(sizes).alias("parts"))
    return each.where(F.col("n") < F.col("parts") - 1).select(*key, (F.col("upto") - 1).cast("long").alias("at"))


def dealt(positions: DataFrame, rows: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """Edits of single characters, each with the node whose span holds it; what is not ``old`` there is left out.

    A range join inside the equality of the paragraph.
    """
    held = positions.join(rows.where("start < end"), key).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    offset = F.col("at") - F.col("start")
    return held.where(F.substring("shown", (offset + 1).cast("int"), F.lit(1)) == old).select(*key, "pos", offset.alias("offset"), F.lit(old).alias("old"), F.lit(new).alias("new"))


def eligible_body(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Text outside fields, tables, formulas, instructions and headers."""
    step = F.when(F.col("kind") == "fldBegin", 1).when(F.col("kind") == "fldEnd", -1).otherwise(0)
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("__sum", F.sum(step).over(w))
    rows = rows.withColumn("depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w))).drop("__sum")
    body = (F.col("kind") == "text") & (F.col("depth") == 0) & ~F.coalesce("in_header", F.lit(False))
    return rows.withColumn("eligible", body)


def shell_calibration(plan: DataFrame, objects: DataFrame, key: list[str], wanted: Column | None = None) -> DataFrame:
    """Size edits of objects: what is asked for, or all that the plan may apply on its own."""
    rows = plan.join(objects, key)
    rows = rows.where(F.col("auto_apply") if wanted is None else wanted)
    return rows.select(*key, F.col("width").alias("old_width"), F.round(F.col("width") * F.col("scale"), 2).alias("new_width"), F.round(F.col("height") * F.col("scale"), 2).alias("new_height"))


def page_styles(source: DataFrame, working: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits that bring borders back, and documents where that is refused, with the reason."""
    a = source.groupBy("doc_id").agg(F.count("*").alias("a"), F.bool_or("has_media_rel").alias("media"))
    b = working.groupBy("doc_id").agg(F.count("*").alias("b"))
    state = a.join(b, "doc_id", "left").withColumn("reason", F.when(F.col("media"), "media_reference").when(~F.col("a").eqNullSafe(F.col("b")), "section_count"))
    refused = state.where("reason is not null").select("doc_id", "reason")
    pairs = source.join(working.select("doc_id", "section", F.col("borders").alias("now")), ["doc_id", "section"]).join(refused, "doc_id", "left_anti")
    return pairs.where(~F.col("borders").eqNullSafe(F.col("now"))).select("doc_id", "section", F.col("now").alias("old"), F.col("borders").alias("new")), refused
