"""Local layout of a converted document: which objects to split, the plan to do it, and the proof that nothing else changed.

``source`` holds the paragraphs of the original (key, p, plain, formulas, first_ordinal), ``working`` those of the
converted document (key, p, plain, formulas, objects, width, text_width); p counts from 1.  Paragraphs of both are
related by one offset per document, found by a text that stands once in each and proved by the texts after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators import compare
from auditlake.operators.rules import errors, holds

#: Points by which an object may pass the text before it counts as too wide.
SLACK = 2.0
#: A paragraph's meaning for the frozen part before the first repair.
SIGNATURE = ["plain", "objects", "formulas", "soft_breaks"]
SPLIT = "M2_SOURCE_VISUAL_LINE_SPLIT"


def anchored(source: DataFrame, working: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """For each (key, anchor): its paragraph on both sides, their offset, and why there is none."""
    a = compare.unique_anchor(anchors, source, key).select(key, "anchor", F.col("hits").alias("source_hits"), F.col("p").alias("source_anchor"))
    b = compare.unique_anchor(anchors, working, key).select(key, "anchor", F.col("hits").alias("working_hits"), F.col("p").alias("working_anchor"))
    reason = F.when(F.coalesce("anchor", F.lit("")) == "", "empty_anchor").when(F.col("source_hits") != 1, "source_anchor_not_unique").when(F.col("working_hits") != 1, "working_anchor_not_unique")
    both = a.join(b.withColumnRenamed("anchor", "b"), key).where(F.col("anchor").eqNullSafe(F.col("b"))).drop("b")
    return both.withColumn("reason", reason).withColumn("offset", F.when(reason.isNull(), F.col("working_anchor") - F.col("source_anchor")))


def offset_proof(source: DataFrame, working: DataFrame, spans: DataFrame, key: str, least: int = 5, shortest: int = 4, most: int = 8) -> DataFrame:
    """Does the offset of each span (key, offset, start, end in source paragraphs) hold for all texts within?

    Texts are compared in order up to the ``most``-th mismatch; those shorter than ``shortest`` prove nothing, and a
    text without a paragraph on the other side is a mismatch that was not compared.  Stable after ``least`` compared
    texts without mismatch.  Only the first mismatches of a document are ranked, so a long one is not sorted whole.
    """
    texts = source.select(key, "p", "plain").join(spans, key).where(F.col("p").between(F.col("start"), F.col("end")) & (F.length("plain") >= shortest))
    other = working.select(key, (F.col("p")).alias("w"), F.col("plain").alias("b"))
    pairs = texts.withColumn("w", F.col("p") + F.col("offset")).join(other, [key, "w"], "left")
    pairs = pairs.select(key, "p", F.col("b").isNotNull().alias("there"), holds(F.col("plain") == F.col("b")).alias("same"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("p"))
    stop = pairs.where(~F.col("same")).withColumn("nth", nth).where(F.col("nth") <= most).where(F.col("nth") == most).select(key, F.col("p").alias("stop"))
    seen = pairs.join(stop, key, "left").where(F.col("stop").isNull() | (F.col("p") <= F.col("stop")))
    told = seen.groupBy(key).agg(F.count_if("there").alias("checked"), F.count_if("same").alias("matches"), F.count_if(~F.col("same")).alias("mismatches"))
    zero = F.lit(0).cast("long")
    out = spans.join(told, key, "left").select(spans["*"], *(F.coalesce(c, zero).alias(c) for c in ("checked", "matches", "mismatches")))
    return out.withColumn("stable", (F.col("checked") >= least) & (F.col("mismatches") == 0))


def overflow_targets(source: DataFrame, working: DataFrame, found: DataFrame, key: str, slack: float = SLACK) -> DataFrame:
    """Working paragraphs behind the anchor with an object wider than the text, their source paragraph, and why one cannot be a target."""
    located = found.where("reason is null").select(key, "offset", "working_anchor")
    wide = working.where(F.col("width") > F.col("text_width") + slack).join(located, key).where(F.col("p") > F.col("working_anchor"))
    wide = wide.select(key, F.col("p").alias("working_p"), (F.col("p") - F.col("offset")).alias("source_p"), "objects", "width", "text_width")
    there = source.select(key, F.col("p").alias("source_p"), F.col("formulas").alias("source_formulas"), "first_ordinal")
    error = F.when(F.col("source_formulas").isNull(), "outside_source").when(F.col("objects") != 1, "not_one_object").when(F.col("source_formulas") != 1, "not_one_formula")
    both = wide.join(there, [key, "source_p"], "left").withColumn("error", error)
    return both.select(key, "working_p", "source_p", F.when(error.isNull(), F.col("first_ordinal")).alias("ordinal"), (F.col("width") - F.col("text_width")).alias("overflow"), "error")


def local_layout(source: DataFrame, working: DataFrame, anchors: DataFrame, probes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents, targets): what is to be split by line, for each document that has an anchor.

    documents: status ``refused`` with its reason, ``repair_required`` or ``ready_no_local_overflow``; offset, checked,
    matches, mismatches, and how many targets are kept.  targets: overflowing paragraphs, their error if they cannot be
    split, and ``kept`` where a probe (key, ordinal, success, multiline) says that the source breaks the formula into lines.
    """
    found = anchored(source, working, anchors, key)
    targets = overflow_targets(source, working, found, key)
    last = targets.where("error is null").groupBy(key).agg(F.max("source_p").alias("last"))
    spans = found.where("reason is null").join(last, key, "left").select(key, "offset", F.col("source_anchor").alias("start"), F.coalesce("last", "source_anchor").alias("end"))
    proof = offset_proof(source, working, spans, key).select(key, "checked", "matches", "mismatches", "stable")
    left = working.groupBy(key).agg(F.sum("formulas").alias("left"))
    said = probes.where(holds(F.col("success")) & holds(F.col("multiline"))).select(key, "ordinal").distinct().withColumn("lines", F.lit(True))
    states = found.join(left, key, "left").join(proof, key, "left")
    reason = F.when(F.coalesce("left", F.lit(0)) > 0, "native_formulas_left").when(F.col("reason").isNotNull(), F.col("reason")).when(~holds(F.col("stable")), "offset_not_stable")
    states = states.withColumn("reason", reason)
    usable = states.where("reason is null").select(key, F.lit(True).alias("usable"))
    judged = targets.join(said, [key, "ordinal"], "left").join(usable, key, "left")
    kept = F.col("error").isNull() & holds(F.col("lines")) & holds(F.col("usable"))
    judged = judged.select(key, "working_p", "source_p", "ordinal", "overflow", "error", kept.alias("kept"))
    counts = judged.groupBy(key).agg(F.count_if("kept").alias("kept"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.min(F.when(F.col("kept"), F.col("working_p"))).alias("first_repair"))
    status = F.when(F.col("reason").isNotNull(), "refused").when(F.col("kept") > 0, "repair_required").otherwise("ready_no_local_overflow")
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("checked", "matches", "mismatches", "kept", "errors")]
    documents = states.join(counts, key, "left").select(key, "reason", "offset", *numbers, "first_repair").withColumn("status", status)
    return documents, judged


def local_plan(formulas: DataFrame, objects: DataFrame, requested: DataFrame, found: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """A row for each requested ordinal (key, ordinal): its source and working paragraph, or why it has none, and whether it is planned.

    A document with an anchor (``found``, from ``anchored``) is mapped by offset: the paragraph lies behind the anchor and
    holds exactly one object.  One without is mapped by ordinal, and only where ``states`` (key, state) says that counts are
    exact.  One refusal leaves the whole document without a plan.  ``formulas`` and ``objects``: key, ordinal, p.
    """
    wanted = requested.select(key, "ordinal").distinct()
    rows = wanted.join(formulas.select(key, "ordinal", F.col("p").alias("source_p")), [key, "ordinal"], "left")
    rows = rows.join(found.select(key, F.col("reason").alias("anchor_reason"), "offset", "working_anchor", F.lit(True).alias("by_offset")), key, "left").join(states.select(key, "state"), key, "left")
    rows = rows.join(objects.select(key, "ordinal", F.col("p").alias("object_p")), [key, "ordinal"], "left")
    by_offset = holds(F.col("by_offset"))
    rows = rows.withColumn("working_p", F.when(by_offset, F.col("source_p") + F.col("offset")).otherwise(F.col("object_p")))
    counted = objects.groupBy(key, F.col("p").alias("working_p")).agg(F.count("*").alias("objects"))
    refusal = (
        F.when(by_offset & F.col("anchor_reason").isNotNull(), F.col("anchor_reason"))
        .when(F.col("source_p").isNull(), "source_ordinal_not_found")
        .when(by_offset & (F.col("working_p") <= F.col("working_anchor")), "before_anchor")
        .when(by_offset & (F.coalesce("objects", F.lit(0)) != 1), "not_one_object")
        .when(~by_offset & ~holds(F.col("state") == "exact"), "counts_not_exact")
        .when(~by_offset & F.col("object_p").isNull(), "working_ordinal_not_found")
    )
    rows = rows.join(counted, [key, "working_p"], "left").withColumn("refusal", refusal)
    refused = rows.where("refusal is not null").select(key).distinct().withColumn("refused", F.lit(True))
    mode = F.when(by_offset, "offset").otherwise("exact_count").alias("mode")
    return rows.join(refused, key, "left").select(key, "ordinal", mode, "source_p", F.when(refusal.isNull(), F.col("working_p")).alias("working_p"), "refusal", F.col("refused").isNull().alias("planned"))


def _flat(paragraphs: DataFrame, key: str, name: str) -> DataFrame:
    """Hash of all text of a document, whatever paragraphs it stands in."""
    ordered = F.array_sort(F.collect_list(F.struct("p", F.coalesce("plain", F.lit("")).alias("plain"))))
    return paragraphs.groupBy(key).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["plain"]), ""), 256).alias(name))


def validated_by_map(maps: DataFrame, files: DataFrame, baseline: DataFrame, candidate: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``key, rule, priority`` for each rule that a repaired document breaks; the map itself says which source it was made from.

    ``maps``: repair_class, source (a path of ``files``: path, sha256), source_sha256, working_sha256, now_working, first_repair,
    expected_objects.  ``targets``: key, p, expected_objects, expected_breaks.  Paragraphs have p and the fields of SIGNATURE.
    """
    a = baseline.select(key, "p", F.lit(True).alias("in_a"), F.struct(*SIGNATURE).alias("a"))
    b = candidate.select(key, "p", F.lit(True).alias("in_b"), F.struct(*SIGNATURE).alias("b"))
    first = maps.select(key, "first_repair")
    moved = F.col("p") < F.col("first_repair")
    both = a.join(b, [key, "p"], "full_outer").join(first, key)
    sums = both.groupBy(key).agg(
        F.count("in_a").alias("paragraphs_a"), F.count("in_b").alias("paragraphs_b"), F.coalesce(F.sum("a.formulas"), F.lit(0)).alias("native_a"), F.coalesce(F.sum("b.formulas"), F.lit(0)).alias("native_b"),
        F.coalesce(F.sum("b.objects"), F.lit(0)).alias("objects_b"), F.count_if(moved & ~F.col("a").eqNullSafe(F.col("b"))).alias("prefix"),
        F.count_if(~F.col("a.plain").eqNullSafe(F.col("b.plain"))).alias("texts"),
    )
    # only documents with a text that moved are put together
    odd = sums.where("texts > 0").select(key)
    flat = _flat(baseline.join(odd, key, "left_semi"), key, "x").join(_flat(candidate.join(odd, key, "left_semi"), key, "y"), key, "full_outer").select(key, F.col("x").eqNullSafe(F.col("y")).alias("flat"))
    hit = targets.join(candidate.select(key, "p", "objects", "soft_breaks"), [key, "p"], "left")
    passed = holds(F.col("objects") == F.col("expected_objects")) & holds(F.col("soft_breaks") >= F.col("expected_breaks"))
    hit = hit.groupBy(key).agg(F.count_if(F.col("objects").isNull()).alias("outside"), F.count_if(F.col("objects").isNotNull() & ~passed).alias("failed"))
    out = maps.join(files.select(F.col("path").alias("source"), F.col("sha256").alias("now_source")), "source", "left").join(sums, key, "left").join(flat, key, "left").join(hit, key, "left")
    none = F.lit(0)
    return errors(
        out, key, ("repair_class", F.col("repair_class") == SPLIT), ("source_missing", F.col("now_source").isNotNull()), ("source_changed", F.lower("now_source") == F.lower("source_sha256")),
        ("working_changed", F.lower("now_working") == F.lower("working_sha256")), ("paragraph_count", F.col("paragraphs_a") == F.col("paragraphs_b")), ("native_left", (F.col("native_a") == 0) & (F.col("native_b") == 0)),
        ("object_count", F.col("objects_b") == F.col("expected_objects")), ("frozen_prefix", F.col("prefix") == 0), ("text_changed", F.coalesce("flat", F.lit(True))),
        ("target_outside", F.coalesce("outside", none) == 0), ("target_failed", F.coalesce("failed", none) == 0),
    )

