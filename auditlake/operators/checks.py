"""Contract validators over evidence tables; each is a table of errors (see ``rules.errors``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.dealt import dealt_by
from auditlake.functions.text import blank, has_control
from auditlake.operators.rules import errors, holds

# Most ordinals in one batch, by kind of work; kinds of targets in a map; decisions of a review.
BATCH_LIMITS = {"baseline": 3, "inline": 12, "review": 24, "export": 48}
TARGET_KINDS = ("source_formula", "source_formula_visual", "added_body_math")
MAP_SCHEMA = "formula-map/v1"
DECISIONS = ("approved", "rebuild")
# Steps of a recognition job.
JOB_STEPS = {
    "created": ("submitting",), "submitting": ("uploading", "submit_unknown", "failed"), "uploading": ("polling", "upload_failed"), "upload_failed": ("uploading", "failed"),
    "polling": ("polling", "done", "failed", "timeout"), "timeout": ("polling",), "done": ("downloading",), "downloading": ("complete", "failed"), "submit_unknown": (), "failed": (), "complete": (),
}


def internal_audit(header: DataFrame, exports: DataFrame, key: str = "audit_id") -> DataFrame:
    """Header rules (tag, scope, hashes, flags, counts) and row rules (failed, empty, control) of one full export."""
    rows = exports.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct("ordinal").alias("kinds"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"),
        F.count_if(~holds(F.col("success"))).alias("failed_rows"), F.count_if(blank(F.col("tex"))).alias("empty_rows"), F.count_if(holds(has_control(F.col("tex")))).alias("control_rows"),
    )
    both = header.join(rows, key, "left")
    total = F.col("axmath_count")
    return errors(
        both, key, ("schema", F.endswith("schema", F.lit("internal-tex-diagnostic/v1"))), ("scope", F.col("scope") == "full"), ("stale_hash", F.lower("docx_sha256") == F.lower("expected_sha256")),
        ("changed_while_read", F.lower("sha_before") == F.lower("sha_after")), ("not_successful", F.col("success")), ("count", F.col("n") == total), ("ordinals", (F.col("kinds") == total) & (F.col("low") == 1) & (F.col("high") == total)),
        ("failed_export", F.col("failed_rows") == 0), ("empty_export", F.col("empty_rows") == 0), ("control_character", F.col("control_rows") == 0),
    )


def formula_map(header: DataFrame, targets: DataFrame, key: str = "map_id") -> DataFrame:
    """Is a map bound to its two documents, and has every formula of both exactly one owner?  ``key, rule, priority``.

    ``header``: schema, source_path, source_sha256, source_count and final_path, final_sha256, final_count as the map says, and the
    same with ``now_``.  ``targets``: target_id, kind, source_ordinal, source_anchor, expected_tex, final_ordinals.
    """
    with_output = holds(F.size("final_ordinals") > 0)
    # one row for each thing a target claims, and for each flaw of its own: a map is then judged by two groupings and one join
    claim = lambda what, name=None, o=None: F.struct(F.lit(what).alias("what"), F.lit(name).cast("string").alias("id"), F.lit(o).cast("long").alias("o"))
    flaws = {
        "bad_kind": ~holds(F.col("kind").isin(*TARGET_KINDS)), "no_anchor": blank(F.col("source_anchor")), "no_tex": blank(F.col("expected_tex")), "no_output": ~with_output,
        "repeated": F.size(F.array_distinct("final_ordinals")) < F.size("final_ordinals"),
    }
    own = F.array(claim("id", F.col("target_id")), F.when(holds(F.col("kind") == "source_formula") & with_output, claim("source", o=F.col("source_ordinal"))), *(F.when(wrong, claim(flaw)) for flaw, wrong in flaws.items()))
    outputs = F.coalesce(F.transform(F.array_distinct("final_ordinals"), lambda o: claim("final", o=o)), F.array())
    claims = targets.select(key, F.explode(F.concat(F.filter(own, lambda x: x.isNotNull()), outputs)).alias("c")).groupBy(key, "c.what", "c.id", "c.o").agg(F.count("*").alias("n"))
    is_a, o = (lambda what: F.col("what") == what), F.col("o")
    numbers = lambda what: [
        F.count_if(is_a(what) & (F.col("n") > 1)).alias(f"{what}_twice"), F.count_if(is_a(what) & o.isNull()).alias(f"{what}_nulls"), F.count_if(is_a(what) & o.isNotNull()).alias(f"{what}_kinds"),
        F.min(F.when(is_a(what), o)).alias(f"{what}_low"), F.max(F.when(is_a(what), o)).alias(f"{what}_high"),
    ]
    bad_id = is_a("id") & (blank(F.col("id")) | (F.col("n") > 1))
    made = claims.groupBy(key).agg(F.count_if(bad_id).alias("bad_ids"), *(F.count_if(is_a(flaw)).alias(flaw) for flaw in flaws), *numbers("final"), *numbers("source"))
    both = header.join(made, key, "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    zero = lambda c: count(c) == 0
    same = lambda c: F.col(c).eqNullSafe(F.col(f"now_{c}"))
    # all ordinals lie in a range if the least and the greatest do; an output without a number, or of a document of unknown size, lies outside
    final_inside = (zero("final_kinds") & zero("final_nulls")) | (zero("final_nulls") & (F.col("final_low") >= 1) & (F.col("final_high") <= F.col("now_final_count")))
    source_inside = F.coalesce(F.col("source_low") >= 1, F.lit(True)) & F.coalesce(F.col("source_high") <= F.col("now_source_count"), F.lit(True))
    return errors(
        both, key, ("schema", F.endswith("schema", F.lit(MAP_SCHEMA))), ("other_source", F.col("source_path") == F.col("now_source_path")), ("stale_source", F.lower("source_sha256") == F.lower("now_source_sha256")), ("source_count", same("source_count")),
        ("other_final", F.col("final_path") == F.col("now_final_path")), ("stale_final", F.lower("final_sha256") == F.lower("now_final_sha256")), ("final_count", same("final_count")), ("target_id", zero("bad_ids")), ("no_output", zero("no_output")),
        ("repeated_output", zero("repeated")), ("final_out_of_range", final_inside), ("several_owners", zero("final_twice")), ("source_ordinal", zero("source_nulls")), ("source_out_of_range", source_inside), ("source_mapped_twice", zero("source_twice")),
        ("source_anchor", zero("no_anchor")), ("expected_tex", zero("no_tex")), ("kind", zero("bad_kind")),
        ("source_coverage", (count("source_kinds") == F.col("now_source_count")) & source_inside & zero("source_nulls")), ("final_coverage", (count("final_kinds") == F.col("now_final_count")) & final_inside),
    )


def class_e_review(expected: DataFrame, reviews: DataFrame, identity: list[str], key: str = "ordinal") -> DataFrame:
    """Identity fields derived anew must agree; decisions are listed ones; what is empty or holds controls is not approved."""
    same = expected.select(key, F.struct(*identity).alias("want")).join(reviews.withColumn("got", F.struct(*identity)), key, "full_outer")
    tex = F.col("got.axmath_exported_tex")
    approved = F.col("decision") == "approved"
    return errors(
        same, key, ("missing", F.col("got").isNotNull()), ("extra", F.col("want").isNotNull()), ("identity", F.col("want").eqNullSafe(F.col("got"))), ("decision", F.col("decision").isin(*DECISIONS)),
        ("evidence", ~blank(F.col("evidence"))), ("approved_empty", ~holds(approved & (blank(tex) | holds(has_control(tex))))),
    )


def repair_ledger(source: DataFrame, working: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraph counts, no native formula left, text unchanged, and enough soft breaks in each target."""
    a = source.groupBy(key).agg(F.count("*").alias("a"))
    b = working.groupBy(key).agg(F.count("*").alias("b"), F.sum("native").alias("native"))
    flat = source.select(key, "p", F.regexp_replace("plain", r"\s", "").alias("x")).join(working.select(key, "p", F.regexp_replace("plain", r"\s", "").alias("y")), [key, "p"], "full_outer")
    flat = flat.groupBy(key).agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("moved"))
    breaks = targets.join(working.select(key, "p", "soft_breaks"), [key, "p"], "left").groupBy(key).agg(F.count_if(~holds(F.col("soft_breaks") >= F.col("lines") - 1)).alias("short"))
    both = a.join(b, key, "full_outer").join(flat, key, "left").join(breaks, key, "left")
    return errors(both, key, ("paragraph_count", F.col("a") == F.col("b")), ("native_left", F.col("native") == 0), ("text_changed", F.col("moved") == 0), ("soft_breaks", F.coalesce("short", F.lit(0)) == 0))


def resume_checkpoint(checkpoints: DataFrame, now: DataFrame, key: str = "run_id") -> DataFrame:
    """A run goes on only from the very files and counts that its checkpoint names."""
    both = checkpoints.join(now.select(key, *(F.col(c).alias(f"now_{c}") for c in ("source_sha256", "working_sha256", "remaining"))), key, "left")
    return errors(
        both, key, ("schema", F.endswith("schema", F.lit("conversion-checkpoint/v1"))), ("source_changed", F.lower("source_sha256") == F.lower("now_source_sha256")), ("working_changed", F.lower("working_sha256") == F.lower("now_working_sha256")),
        ("remaining", F.col("remaining") == F.col("now_remaining")),
    )


def restore_gate(header: DataFrame, before: DataFrame, after: DataFrame, key: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """A restored document has the original's formula count in every paragraph, zeros included.

    ``tasks``: into how many tasks the paragraphs of both are dealt by document.
    """
    a, b = before.select(key, "p", F.col("formulas").alias("x")), after.select(key, "p", F.col("formulas").alias("y"))
    moved = dealt_by(a.join(b, [key, "p"], "full_outer"), [key], tasks).groupBy(key).agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("moved"), F.sum("x").alias("total"))
    both = header.join(moved, key, "left")
    return errors(both, key, ("status", F.col("status") == "ready"), ("original_changed", F.lower("original_sha256") == F.lower("now_sha256")), ("counts", F.col("total") == F.col("formula_count")), ("paragraph_sequence", F.col("moved") == 0))


def repair_arithmetic(reports: DataFrame, key: str = "report_id") -> DataFrame:
    """What a repair must leave: counts that add up, no native formula, the same paragraphs, a bounded batch."""
    limit = F.lit(0)
    for kind, most in BATCH_LIMITS.items():
        limit = F.when(F.col("kind") == kind, most).otherwise(limit)
    return errors(
        reports, key, ("count", F.col("after") == F.col("before") + F.col("expected_increase")), ("native_left", F.col("native_after") == 0), ("paragraphs", F.col("paragraphs_before") == F.col("paragraphs_after")), ("batch_size", F.col("ordinals") <= limit)
    )


def allowed_steps(spark) -> DataFrame:
    rows = [(a, b) for a, following in JOB_STEPS.items() for b in following]
    return spark.createDataFrame(rows, "from_state string, to_state string")


def pdf_gate(files: DataFrame, key: str = "path", most_bytes: int = 200 << 20, most_pages: int = 600) -> DataFrame:
    return errors(files, key, ("empty", F.col("size") > 0), ("too_large", F.col("size") <= most_bytes), ("encrypted", ~F.col("encrypted")), ("pages", F.col("pages").between(1, most_pages)))


def picked_result(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """The first row that names the job's data or file, else the only row, else none."""
    hit = (F.col("data_id") == F.col("wanted_id")) | (F.col("file_name") == F.col("wanted_file"))
    out = rows.groupBy(key).agg(F.min_by("url", "n").alias("first"), F.count("*").alias("rows"), F.min(F.when(holds(hit), F.struct("n", "url"))).alias("hit"))
    return out.select(key, F.coalesce(F.col("hit.url"), F.when(F.col("rows") == 1, F.col("first"))).alias("url"))
