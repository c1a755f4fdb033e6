"""Repairs and runs: where targets lie, triage before an expensive probe, reviews and gates of a run, its names and files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import blank
from auditlake.operators.rules import all_hold, errors, holds

#: Widest shell, in points, that cannot hold more than one character.
TINY_WIDTH = 10.0


def ordinal_locations(objects: DataFrame, key: list[str]) -> DataFrame:
    """Paragraph and place in it of every object, by its ordinal in the document."""
    return objects.withColumn("local", F.row_number().over(Window.partitionBy(*key, "p").orderBy("ordinal"))).select(*key, "ordinal", "p", "local")


def located(targets: DataFrame, objects: DataFrame, key: list[str]) -> DataFrame:
    """The object each row of a map means: by paragraph and place in it where the row says so, else by ordinal; ``found`` is its ordinal."""
    at = ordinal_locations(objects, key)
    placed = targets.where("p is not null and local is not null").join(at.withColumnRenamed("ordinal", "found"), [*key, "p", "local"], "left")
    others = targets.where("p is null or local is null").join(at.select(*key, "ordinal", F.col("ordinal").alias("found")), [*key, "ordinal"], "left")
    columns = [*key, "ordinal", "found"]
    return placed.select(*columns).unionByName(others.select(*columns))


def triage(objects: DataFrame, probes: DataFrame, key: list[str]) -> DataFrame:
    """Suspicious objects by their width alone, and what a probe of the wide ones says; probes that failed count for nothing.

    ``objects``: width, section_width, source text; ``probes``: success, multiline.
    """
    tiny = holds(F.col("width") <= TINY_WIDTH) & (F.length(F.regexp_replace(F.coalesce("source", F.lit("")), r"(?U)\s", "")) > 1)
    wide = holds(F.col("width") > F.col("section_width"))
    suspects = objects.where(tiny | wide).withColumn("tiny", tiny)
    said = probes.where(holds(F.col("success"))).select(*key, "multiline")
    kind = F.when(F.col("tiny"), "CLASS_E_SEMANTIC_REBUILD").when(holds(F.col("multiline")), "M2_SOURCE_VISUAL_WRAP_LOSS").otherwise("OVERWIDE_SOURCE_SINGLELINE_REVIEW")
    return suspects.join(said, key, "left").select(*key, "width", kind.alias("repair_class"))


def structure_candidates(counts: DataFrame, parts: list[str]) -> DataFrame:
    """Formulas with any structure; those without are no candidates."""
    return counts.where(reduce(or_, (F.coalesce(F.col(p), F.lit(0)) > 0 for p in parts)))


def prime_reviews(headers: DataFrame, required: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whether the review of a document's primes holds: bound to its files, one passed row with evidence for each ordinal required."""
    wanted = required.groupBy(key).agg(F.array_sort(F.collect_list("ordinal")).alias("wanted"))
    passed = all_hold(F.col("source_semantics_match"), F.col("contract_verified"), ~blank(F.col("evidence")))
    given = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.coalesce("ordinal", F.lit(0)))).alias("given"), F.bool_and(passed).alias("passed"))
    both = headers.join(wanted, key, "left").join(given, key, "left")
    bound = all_hold(F.endswith("schema", F.lit("prime-semantic-review/v1")), F.col("source_sha256") == F.col("now_source"), F.col("working_sha256") == F.col("now_working"))
    return both.select(key, (F.col("wanted").isNull() | (bound & all_hold(F.col("given") == F.col("wanted"), F.col("passed")))).alias("verified"))


def conversion_success(runs: DataFrame, key: str) -> DataFrame:
    """A conversion succeeded when every one of these is known and holds."""
    none = [F.col(c) == 0 for c in ("exit_code", "native_left", "foreign_source", "foreign_candidate", "outside_source", "outside_candidate")]
    flags = [F.col(c) for c in ("complete", "count_acceptable", "paragraphs_equal", "text_exact", "source_unchanged")]
    return runs.select(key, all_hold(*none, *flags).alias("success"))


def calibration_binding(plans: DataFrame, key: str) -> DataFrame:
    """A plan is used only on the file it was made for."""
    return errors(
        plans, key, ("schema", F.endswith("schema", F.lit("geometry-audit/v2"))), ("unbound", ~blank(F.col("planned_path")) & ~blank(F.col("planned_sha256"))),
        ("other_file", F.col("planned_path") == F.col("path")), ("stale", F.col("planned_sha256") == F.col("sha256")),
    )


def chosen_document(files: DataFrame, key: str) -> DataFrame:
    """The document of each archive: the only full.docx, else the only .docx; else why there is none."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    full = name == "full.docx"
    found = files.withColumn("is_doc", F.endswith(name, F.lit(".docx"))).groupBy(key).agg(
        F.count_if("is_doc").alias("n"), F.count_if(full).alias("full"), F.min(F.when(full, F.col("path"))).alias("named"), F.min(F.when(F.col("is_doc"), F.col("path"))).alias("only")
    )
    choice = F.when(F.col("full") == 1, F.col("named")).when(F.col("n") == 1, F.col("only"))
    return found.select(key, choice.alias("path"), F.when(choice.isNotNull(), None).when(F.col("n") == 0, "no_document").otherwise("several_documents").alias("reason"))


def run_names(starts: DataFrame, root: str, stamp: Column, order: list[str]) -> DataFrame:
    """A folder name for each start; a later start of the same root and second gets a number."""
    rows = starts.withColumn("stamp", stamp)
    n = F.row_number().over(Window.partitionBy(root, "stamp").orderBy(*order))
    return rows.withColumn("run", F.concat(F.lit("run-"), F.col("stamp"), F.when(n > 1, F.concat(F.lit("-"), n)).otherwise("")))
