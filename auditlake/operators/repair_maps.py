"""Repair maps: which objects of a converted document to rebuild, from what source text.

Four kinds, each refused for a whole document unless its counts, hashes and lines prove it.  A map is a table with a row
for each target: its text, its place, its own refusal, and ``planned`` where no target of the document, and nothing about
the document itself, is refused.

``headers`` has one row a document with what its files say now: source_native and source_objects (formulas and objects of
the original), working_native and working_objects, and what each kind below names besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import tex as X
from auditlake.functions.dealt import dealt
from auditlake.functions.text import aligned, latex_reasons, prime_issues, prime_orders
from auditlake.operators.rules import count_state, holds

PLAN_SCHEMA = "local-layout-plan/v1"


def with_safe_tex(rows: DataFrame, tex: Column) -> DataFrame:
    """Adds safe_tex (the normal form without math delimiters), prime_orders, and ``rejected``, the rules it still breaks; empty text is rejected too."""
    value = F.coalesce(X.safe_udf(tex), F.lit(""))
    out = rows.withColumn("safe_tex", value)
    broken = F.array_distinct(F.concat(F.when(F.trim("safe_tex") == "", F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>")), X.limit_issues_udf("safe_tex"), prime_issues(F.col("safe_tex"))))
    return out.withColumn("prime_orders", prime_orders(F.col("safe_tex"))).withColumn("rejected", broken)


def _judged(rows: DataFrame, headers: DataFrame, key: str, refusals: list[tuple[str, Column]], about: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``refusal`` (of the document first, then of the row) and ``planned``; rules say what must not hold."""
    first = lambda rules: F.coalesce(*(F.when(~holds(~bad), code) for code, bad in rules))
    documents = headers.select(key, first(about).alias("about"))
    both = rows.withColumn("own", first(refusals)).join(documents, key, "left").withColumn("refusal", F.when(F.col("about").isNotNull(), F.col("about")).otherwise(F.col("own")))
    # a window over each document, so that its rows, made in Python, are made once
    return both.withColumn("planned", F.every(F.col("refusal").isNull()).over(Window.partitionBy(key))).drop("own", "about")


def limit_layout(headers: DataFrame, formulas: DataFrame, requested: DataFrame, scripts: DataFrame, primes: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """Rebuild formulas with scripted limits: the limits of the text are as many as the scripts seen in the source, and primes have the source's orders.

    ``formulas``: ordinal, tex; ``requested``: ordinal; ``scripts``: ordinal, n; ``primes``: ordinal, orders (only formulas that
    have any); ``locations``: ordinal, p, local.
    """
    rows = requested.select(key, "ordinal").distinct().join(formulas.select(key, "ordinal", "tex"), [key, "ordinal"], "left")
    rows = with_safe_tex(dealt(rows), F.col("tex")).withColumn("placements", X.limit_placements_udf("safe_tex"))
    for other in (scripts.select(key, "ordinal", F.col("n").alias("scripts")), primes.select(key, "ordinal", F.col("orders").alias("source_orders")), locations.select(key, "ordinal", "p", "local")):
        rows = rows.join(other, [key, "ordinal"], "left")
    own = [
        ("no_scripted_limit", F.col("scripts").isNull()),
        ("rejected_tex", F.size("rejected") > 0),
        ("limit_count_differs", F.size("placements") != F.col("scripts")),
        ("prime_orders_differ", F.col("source_orders").isNotNull() & ~F.col("source_orders").eqNullSafe(F.col("prime_orders"))),
        ("location_missing", F.col("p").isNull()),
    ]
    about = [
        ("source_has_objects", F.col("source_objects") > 0),
        ("no_native_formulas", F.col("source_native") == 0),
        ("native_formulas_left", F.col("working_native") > 0),
        ("counts_differ", F.col("working_objects") != F.col("source_native")),
    ]
    out = _judged(rows, headers, key, own, about)
    return out.select(key, "ordinal", F.concat(F.lit("$"), "safe_tex", F.lit("$")).alias("tex"), F.size("placements").alias("limits"), "placements", "prime_orders", "p", "local", "refusal", "planned")


def multisibling(headers: DataFrame, groups: DataFrame, formulas: DataFrame, key: str) -> DataFrame:
    """Give back the formulas of a display group that became one object; only where the missing objects are exactly those.

    ``groups``: p, ordinals (of one group); ``headers`` names its ``extra`` formulas; ``formulas``: ordinal, tex.
    """
    each = groups.select(key, "p", "ordinals", F.posexplode("ordinals").alias("at", "ordinal")).join(formulas.select(key, "ordinal", "tex"), [key, "ordinal"], "left")
    each = with_safe_tex(dealt(each), F.col("tex"))
    lists = F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("$"), "safe_tex", F.lit("$")).alias("tex"))))
    rows = each.groupBy(key, "p", "ordinals").agg(lists.alias("lines"), F.count_if(F.size("rejected") > 0).alias("bad"))
    state = count_state(F.col("source_native"), F.col("extra"), F.col("working_objects"), F.col("working_native"))
    out = _judged(rows, headers, key, [("rejected_tex", F.col("bad") > 0)], [("not_the_known_collapse", state != "known_multisibling_collapse")])
    return out.select(key, "p", "ordinals", F.transform("lines", lambda x: x["tex"]).alias("lines"), F.lit(1).alias("expected_now"), F.size("lines").alias("expected_after"), "refusal", "planned")


def chosen_lines(exports: DataFrame, key: str) -> DataFrame:
    """The text of every visual line: the one exported where it is sane, else that of the fragment; with why the export was not taken."""
    reasons = latex_reasons(F.col("exported"))
    rows = dealt(exports).withColumn("export_reasons", reasons)
    sane = F.size("export_reasons") == 0
    rows = with_safe_tex(rows, F.when(sane, X.exported_udf("exported")).otherwise(F.col("fragment")))
    return rows.withColumn("provenance", F.when(sane, "export").otherwise("fragment"))


def _lines(exports: DataFrame, key: str) -> DataFrame:
    """One row a formula: whether its export succeeded, its lines in order, and how many of them are rejected."""
    lines, there = chosen_lines(exports, key), F.col("line").isNotNull()
    ordered = F.array_sort(F.collect_list(F.when(there, F.struct("line", "safe_tex", "provenance"))))
    made = lines.groupBy(key, "ordinal").agg(F.bool_and(holds(F.col("success"))).alias("success"), ordered.alias("lines"), F.count_if(there & (F.size("rejected") > 0)).alias("bad")).withColumn("n", F.size("lines"))
    # without lines, neither they nor what is rejected of them is known
    return made.select(key, "ordinal", "success", *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("lines", "bad")), "n")


def visual_wrap(headers: DataFrame, exports: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """Formulas that the source shows on several lines become one aligned formula; those on one line need no repair.

    ``exports``: ordinal, success, line, exported, fragment (a row without line where nothing was exported); ``headers`` says
    whether the source is ``unchanged`` and has ``extra``; ``locations``: ordinal, p, local.
    """
    rows = _lines(exports, key).join(locations.select(key, "ordinal", "p", "local"), [key, "ordinal"], "left").where(~F.col("success") | (F.col("n") > 1))
    own = [("export_failed", ~F.col("success")), ("rejected_tex", F.col("bad") > 0), ("location_missing", F.col("p").isNull())]
    state = count_state(F.col("source_native"), F.col("extra"), F.col("working_objects"), F.col("working_native"))
    out = _judged(rows, headers, key, own, [("source_changed", ~F.col("unchanged")), ("counts_not_exact", state != "exact")])
    tex = F.concat(F.lit("$"), aligned(F.transform("lines", lambda x: x["safe_tex"])), F.lit("$"))
    return out.select(key, "ordinal", F.when(F.col("success"), tex).alias("tex"), F.col("n").alias("visual_lines"), F.transform("lines", lambda x: x["provenance"]).alias("provenance"), "p", "local", "refusal", "planned")


def visual_line_split(headers: DataFrame, plan: DataFrame, exports: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Each visual line of a planned formula becomes an object of its own, with soft breaks between them.

    ``plan``: ordinal, source_p, working_p.  ``headers`` binds it: unchanged, plan_schema, plan_working and now_working,
    plan_source and report_source (hashes), plan_paragraphs and now_paragraphs, plan_objects, working_objects, working_native.
    ``objects``: p, n (objects of each paragraph now).  The rows say how many objects and breaks a repair adds.
    """
    rows = plan.select(key, "ordinal", "source_p", "working_p").join(_lines(exports, key), [key, "ordinal"], "left")
    rows = rows.join(objects.select(key, F.col("p").alias("working_p"), F.col("n").alias("now")), [key, "working_p"], "left")
    same = lambda a, b: F.lower(a) == F.lower(b)
    own = [("export_missing", ~holds(F.col("success"))), ("fewer_than_two_lines", F.col("n") < 2), ("rejected_tex", F.col("bad") > 0), ("not_one_object", F.coalesce("now", F.lit(0)) != 1)]
    about = [
        ("source_changed", ~F.col("unchanged")), ("plan_schema", ~F.endswith("plan_schema", F.lit(PLAN_SCHEMA))), ("stale_working", ~same("plan_working", "now_working")), ("source_mismatch", ~same("plan_source", "report_source")),
        ("paragraph_count", F.col("plan_paragraphs") != F.col("now_paragraphs")), ("object_count", F.col("plan_objects") != F.col("working_objects")), ("native_formulas_left", F.col("working_native") > 0),
    ]
    out = _judged(rows, headers, key, own, about)
    texts = F.transform("lines", lambda x: F.concat(F.lit("$"), x["safe_tex"], F.lit("$")))
    return out.select(key, "ordinal", "source_p", "working_p", texts.alias("lines"), F.lit(1).alias("expected_now"), F.coalesce("n", F.lit(0)).alias("expected_after"), F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).alias("expected_breaks"), "refusal", "planned")


def map_totals(rows: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """For each document whose line splits are planned: objects added and expected at the end, and the first paragraph repaired."""
    sums = rows.where("planned").groupBy(key).agg(F.sum(F.col("expected_after") - 1).alias("increase"), F.min("working_p").alias("first_repair"), F.count("*").alias("targets"))
    return sums.join(headers.select(key, "working_objects"), key).select(key, "targets", "increase", (F.col("working_objects") + F.col("increase")).alias("expected_objects"), "first_repair")
