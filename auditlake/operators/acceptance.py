"""Acceptance of a converted document: gates over tables that are made once, in order, with the first that blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.functions.tex import STRUCTURE, structure_udf
from auditlake.operators.formulas import delimiter_present
from auditlake.operators.rules import holds


@dataclass(frozen=True)
class Gate:
    """A check: the documents that fail it; one that ``stops`` leaves later gates unread."""

    name: str
    failing: DataFrame
    stops: bool = False


def run_gates(keys: DataFrame, gates: list[Gate], key: str) -> DataFrame:
    """``key, nth, gate, state`` with state passed, failed or not_run, for every key and gate, in the order of ``gates``.

    Failures of all gates are one table, so keys are joined once, however many gates there are.
    """
    names = F.array(*(F.struct(F.lit(n).alias("nth"), F.lit(g.name).alias("gate")) for n, g in enumerate(gates, 1)))
    failed = [g.failing.select(key).distinct().select(key, F.lit(n).alias("nth"), F.lit(g.stops).alias("stops")) for n, g in enumerate(gates, 1)]
    union = failed[0]
    for other in failed[1:]:
        union = union.unionByName(other)
    lists = union.groupBy(key).agg(F.collect_set("nth").alias("failed"), F.min(F.when(F.col("stops"), F.col("nth"))).alias("stop"))
    rows = keys.select(key).distinct().join(lists, key, "left").select(key, "failed", "stop", F.explode(names).alias("g"))
    state = F.when(F.col("g.nth") > F.col("stop"), "not_run").when(holds(F.array_contains("failed", F.col("g.nth"))), "failed").otherwise("passed")
    return rows.select(key, F.col("g.nth").alias("nth"), F.col("g.gate").alias("gate"), state.alias("state"))


def verdict(states: DataFrame, key: str) -> DataFrame:
    """``key, status, first_block, failed``: refused where a stopping gate left others unread, else whether review is due."""
    bad = F.col("state") == "failed"
    out = states.groupBy(key).agg(F.min(F.when(bad, F.struct("nth", "gate"))).alias("first"), F.count_if(bad).alias("failed"), F.count_if(F.col("state") == "not_run").alias("unread"))
    status = F.when(F.col("unread") > 0, "refused").when(F.col("failed") > 0, "hard_content_failed").otherwise("awaiting_visual_review")
    return out.select(key, status.alias("status"), F.col("first.gate").alias("first_block"), "failed")


def content_flags(source: DataFrame, candidate: DataFrame, key: str, scope: str = "preserve") -> DataFrame:
    """How the texts of two versions agree: by paragraph, as one text, and with the list labels of the source brought to the scope's form.

    Rows are key, p, plain (without objects) and contract (with marks for them).  ``expected_changes`` counts the labels that
    the scope changes.  Paragraphs are compared by hash; only documents with a difference are put together as one text.
    """
    normal = X.normalize_labels(F.col("contract"), scope)
    marks = F.length("contract") - F.length(F.translate("contract", "、", "")) - (F.length(normal) - F.length(F.translate(normal, "、", "")))
    a = source.select(key, "p", F.xxhash64("plain").alias("ap"), F.xxhash64(normal).alias("ac"), marks.alias("marks"), F.lit(1).alias("a"))
    b = candidate.select(key, "p", F.xxhash64("plain").alias("bp"), F.xxhash64("contract").alias("bc"), F.lit(1).alias("b"))
    differ = lambda x, y: F.count_if(F.col("a").isNull() | F.col("b").isNull() | (F.col(x) != F.col(y)))
    sums = a.join(b, [key, "p"], "full_outer").groupBy(key).agg(F.count("a").alias("source_paragraphs"), F.count("b").alias("candidate_paragraphs"), differ("ap", "bp").alias("differences"), differ("ac", "bc").alias("normal_differences"), F.coalesce(F.sum("marks"), F.lit(0)).alias("expected_changes"))
    odd = sums.where("differences > 0 or normal_differences > 0").select(key)

    def whole(rows: DataFrame, text: Column, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("p", text.alias("x"))))
        return rows.join(odd, key, "left_semi").groupBy(key).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["x"]), ""), 256).alias(name))

    empty = F.sha2(F.lit(""), 256)
    flat = odd
    for rows, text, name in ((source, F.col("plain"), "sp"), (candidate, F.col("plain"), "cp"), (source, normal, "sc"), (candidate, F.col("contract"), "cc")):
        flat = flat.join(whole(rows, text, name), key, "left").withColumn(name, F.coalesce(name, empty))
    both = sums.join(flat, key, "left")
    exact, normalised = F.col("differences") == 0, F.col("normal_differences") == 0
    return both.select(
        key, "source_paragraphs", "candidate_paragraphs", "differences", exact.alias("exact"), F.coalesce(F.col("sp") == F.col("cp"), F.lit(True)).alias("flat_exact"), normalised.alias("normalised_exact"),
        F.coalesce(F.col("sc") == F.col("cc"), F.lit(True)).alias("normalised_flat_exact"), (exact | normalised).alias("contract_exact"), F.col("expected_changes").cast("long").alias("expected_changes"),
    )


def structure_counts(rows: DataFrame, key: list[str], tex: str) -> DataFrame:
    """``key, field, name, n``: structure, relations and operators of each formula, without zeros."""
    found = rows.select(*key, structure_udf(tex).alias("s"))
    own = F.array(*(F.struct(F.lit("structure").alias("field"), F.lit(n).alias("name"), F.col(f"s.{n}").alias("n")) for n in STRUCTURE))

    def counts(field: str) -> Column:
        return F.transform(F.map_entries(f"s.{field}"), lambda e: F.struct(F.lit(field).alias("field"), e["key"].alias("name"), e["value"].alias("n")))

    maps = [counts("relations"), counts("operators")]
    return found.select(*key, F.explode(F.concat(own, *maps)).alias("c")).where("c.n > 0").select(*key, "c.field", "c.name", "c.n")


def structure_differences(expected: DataFrame, actual: DataFrame, key: list[str], exact: bool = False) -> DataFrame:
    """``key, reason, expected, actual`` for every name (key, field, name, n) whose counts differ, or in at-least mode fall short.

    Names of either side count in exact mode, a name that is absent as 0.  Keys are those of ``expected`` and ``actual``.
    """
    both = expected.withColumnRenamed("n", "e").join(actual.withColumnRenamed("n", "a"), [*key, "field", "name"], "full_outer" if exact else "left")
    e, a = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    label = F.when(F.col("field") == "structure", F.concat("name", F.lit("_structure"))).otherwise(F.concat_ws("_", "field", "name"))
    reason = F.concat(label, F.lit("_count_mismatch" if exact else "_missing"))
    return both.where(e != a if exact else a < e).select(*key, reason.alias("reason"), e.cast("int").alias("expected"), a.cast("int").alias("actual"))


def delimiters_missing(expected: DataFrame, rows: DataFrame, key: list[str], tex: str, signs: list[str]) -> DataFrame:
    """``key, reason, sign`` for each expected delimiter (key, sign, side) that a formula does not show on its side; ``signs`` are those that may be asked for."""
    sides = {"begin": "opening_delimiter_missing", "end": "closing_delimiter_missing"}
    told = rows.select(*key, *(delimiter_present(F.coalesce(tex, F.lit("")), s, side).alias(f"{side}_{n}") for side in sides for n, s in enumerate(signs)))
    there = F.coalesce(*(F.when((F.col("sign") == s) & (F.col("side") == side), F.col(f"{side}_{n}")) for side in sides for n, s in enumerate(signs)), F.lit(False))
    reason = F.when(F.col("side") == "begin", sides["begin"]).otherwise(sides["end"])
    return expected.join(told, key, "left").where(~there).select(*key, reason.alias("reason"), "sign")
