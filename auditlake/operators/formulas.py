"""Formulas in their paragraphs: groups, standalone ones, scripts of limits, context, previews, numbering candidates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import issues, occurrences
from auditlake.operators.rules import all_hold, holds

# Sides of a script by the kind of node that carries it; signs and the commands that stand for them.
SCRIPT_SIDES = {"limLow": ("below",), "sSub": ("below",), "limUpp": ("above",), "sSup": ("above",), "sSubSup": ("below", "above")}
DELIMITER_COMMANDS = {"⟨": "langle", "⟩": "rangle", "⌊": "lfloor", "⌋": "rfloor", "⌈": "lceil", "⌉": "rceil"}
BAR_COMMANDS = {"begin": ("lvert", "left", "bigl", "Bigl", "biggl", "Biggl"), "end": ("rvert", "right", "bigr", "Bigr", "biggr", "Biggr")}
STATUS_FIELDS = ("schema", "status", "state", "source", "frozen_source", "working_docx", "working", "final", "source_sha256", "final_sha256", "internal_audit_pass", "acceptance_pass", "visual_review_passed", "visual_review_required", "next_actions")


def sibling_groups(formulas: DataFrame, group: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Display groups with more than one direct formula, and how many more than one."""
    out = formulas.groupBy(*group).agg(F.array_sort(F.collect_list(ordinal)).alias("ordinals"), F.count("*").alias("n"))
    return out.where("n > 1").select(*group, "ordinals", (F.col("n") - 1).alias("extra"))


def standalone(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that hold one direct formula and nothing else."""
    return paragraphs.where(all_hold(F.col("formulas") == 1, F.trim(F.coalesce("plain", F.lit(""))) == "", F.col("objects") == 0))


def limit_scripts(nodes: DataFrame) -> DataFrame:
    """Nodes whose base reads "lim", in any case, with the sides of their scripts."""
    sides = reduce(lambda w, k: w.when(F.col("tag") == k, F.array(*(F.lit(s) for s in SCRIPT_SIDES[k]))), list(SCRIPT_SIDES)[1:], F.when(F.col("tag") == "limLow", F.array(F.lit("below"))))
    return nodes.where(F.lower(F.trim("base")) == "lim").withColumn("placements", sides).where("placements is not null")


def inline_context(formulas: Column, before: Column, after: Column, alignment: Column) -> Column:
    """Why a formula stands in a line of text, and whether the evidence is strong: text after it alone is not."""
    some = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", "") != ""
    reasons = issues((formulas > 1, "multiple_omath_same_paragraph"), (some(before), "meaningful_content_before_formula"), (some(after), "meaningful_content_after_formula"))
    strong = holds(formulas > 1) | (some(before) & ~holds(alignment == 1))
    return F.struct(reasons.alias("reasons"), strong.alias("strong"))


def suspicious_preview(mean: Column, std: Column, ink: Column) -> Column:
    """An image that is blank, flat, or without ink."""
    return ((std < 2.0) & (mean > 245)) | ((std < 3.0) & (mean > 90) & (mean < 235)) | (ink < 0.0005)


def plausible_donor(width: Column, height: Column) -> Column:
    return holds((width > 4) & (width <= 2000) & (height > 8) & (height <= 1000))


def delimiter_present(tex: Column, sign: str, side: str) -> Column:
    """Whether a delimiter is there on its side; a bar needs a sized command, or two bars."""
    if sign == "|":
        close = F.regexp_replace(tex, r"\s+\|", "|")
        sized = reduce(or_, (F.contains(close, F.lit(f"\\{command}|")) for command in BAR_COMMANDS[side]))
        bare = occurrences(tex, "|") - occurrences(tex, "\\|")
        return sized | (bare >= 2) | (F.regexp_count(tex, F.lit(r"\\vert(?![A-Za-z])")) >= 2)
    if sign in ("{", "}"):
        return F.contains(tex, F.lit(f"\\{sign}"))
    here = F.contains(tex, F.lit(sign))
    return here | F.contains(tex, F.lit(f"\\{DELIMITER_COMMANDS[sign]}")) if sign in DELIMITER_COMMANDS else here


def mapping_mode(targets: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Geometry is compared only where each target has one output and nothing was added."""
    sizes = targets.groupBy(key).agg(F.coalesce(F.bool_and(holds(F.size("final_ordinals") == 1)), F.lit(True)).alias("single"))
    both = headers.join(sizes, key, "left")
    one = all_hold(F.col("mapping_pass"), F.coalesce("added", F.lit(0)) == 0, F.coalesce("single", F.lit(True)))
    return both.select(key, F.when(one, "source_final_map").when(holds(F.col("mapping_pass")), "visual_only_due_validated_formula_map").otherwise("unavailable").alias("mode"))


def service_error(status: Column, code: Column) -> Column:
    """Kind of failure of a service answer; null where it is fine.  Authentication is never retried."""
    denied = status.isin(401, 403) | code.isin("A0202", "A0211")
    return F.when(holds(denied), "authentication").when(~status.between(200, 399), "http").when(~holds(code == "0"), "business")


def numbering_candidates(paragraphs: DataFrame, styles: DataFrame, owner: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paragraphs that number or outline themselves: list, field, outline level, or a heading by name.

    Styles belong to their ``owner`` (a document, or the columns that name one).

    ``styles`` has what each style inherits (``num_id``, ``outline``) and ``heading``; the paragraph's own
    values come first, and a list number of 0 turns numbering off.
    """
    rows = paragraphs.join(styles.select(*owner, "style_id", F.col("num_id").alias("s_num"), F.col("outline").alias("s_outline"), "heading"), [*owner, "style_id"], "left")
    number, outline = F.coalesce("num_id", "s_num"), F.coalesce("outline", "s_outline")
    automatic = holds(number != "0")
    field = holds(F.upper("instr").rlike(r"\b(?:SEQ|LISTNUM|AUTONUM|AUTONUMLGL|AUTONUMOUT)\b"))
    heading = holds(F.col("heading"))
    outlined = holds(outline != "9") | (outline.isNull() & heading)
    out = rows.select(*owner, "p", automatic.alias("automatic"), field.alias("field"), outlined.alias("outline"), heading.alias("heading"))
    return out.where("automatic or field or outline or heading")


def status_view(reports: DataFrame) -> DataFrame:
    """The known fields of each report as text, as they stand; acceptance is never inferred."""
    return reports.select("name", *(F.get_json_object("value", f"$.{f}").alias(f) for f in STATUS_FIELDS))
