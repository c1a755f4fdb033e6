"""Validators, edit tables and job rules, over tables that play the part of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.operators import checks, edits
from auditlake.plans.registry import Tables, dealt_by, query, tasks_for

_AUDIT_SQL = """h AS (SELECT o_orderkey AS audit_id, CASE WHEN o_orderkey % 50 = 0 THEN 'x-other/v1' ELSE 'x-internal-tex-diagnostic/v1' END AS schema, CASE WHEN o_orderkey % 31 = 0 THEN 'selected' ELSE 'full' END AS scope,
  o_orderstatus <> 'P' AS success, o_orderkey % 37 = 0 AS stale, (SELECT 4) AS total FROM orders),
e AS (SELECT l_orderkey AS audit_id, count(*) AS n, count(DISTINCT l_linenumber) AS kinds, min(l_linenumber) AS low, max(l_linenumber) AS high, count(*) FILTER (WHERE l_returnflag = 'A') AS failed, count(*) FILTER (WHERE l_quantity > 49) AS empty FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_AUDIT_SQL}, b AS (SELECT * FROM h LEFT JOIN e USING (audit_id)), r AS (
SELECT audit_id, 'schema' AS rule, 1 AS priority FROM b WHERE schema NOT LIKE '%internal-tex-diagnostic/v1' UNION ALL SELECT audit_id, 'scope', 2 FROM b WHERE scope <> 'full' UNION ALL SELECT audit_id, 'stale_hash', 3 FROM b WHERE stale
UNION ALL SELECT audit_id, 'not_successful', 5 FROM b WHERE NOT success UNION ALL SELECT audit_id, 'count', 6 FROM b WHERE n IS NULL OR n <> total UNION ALL SELECT audit_id, 'ordinals', 7 FROM b WHERE n IS NULL OR NOT (kinds = total AND low = 1 AND high = total)
UNION ALL SELECT audit_id, 'failed_export', 8 FROM b WHERE coalesce(failed, 1) <> 0 UNION ALL SELECT audit_id, 'empty_export', 9 FROM b WHERE coalesce(empty, 1) <> 0 UNION ALL SELECT audit_id, 'control_character', 10 FROM b WHERE n IS NULL)
SELECT audit_id, rule, CAST(priority AS BIGINT) AS priority FROM r""")
def internal_audit_errors(t: Tables):
    """Orders as audits, their lines as exports; an order should have four."""
    o = F.col("o_orderkey")
    digest = F.sha2(o.cast("string"), 256)
    header = t.orders.select(
        o.alias("audit_id"), F.when(o % 50 == 0, "x-other/v1").otherwise("x-internal-tex-diagnostic/v1").alias("schema"), F.when(o % 31 == 0, "selected").otherwise("full").alias("scope"), (F.col("o_orderstatus") != "P").alias("success"),
        digest.alias("docx_sha256"), F.when(o % 37 == 0, "stale").otherwise(F.upper(digest)).alias("expected_sha256"), digest.alias("sha_before"), digest.alias("sha_after"), F.lit(4).alias("axmath_count"),
    )
    exports = t.lineitem.select(F.col("l_orderkey").alias("audit_id"), F.col("l_linenumber").alias("ordinal"), (F.col("l_returnflag") != "A").alias("success"), F.when(F.col("l_quantity") > 49, " ").otherwise("x").alias("tex"))
    return checks.internal_audit(header, exports)


@query("""WITH h AS (SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), r AS (SELECT k, n, unnest([CASE WHEN k % 40 = 1 THEN 'schema' END, CASE WHEN k % 40 = 2 THEN 'other_source' END, CASE WHEN k % 40 = 3 THEN 'stale_source' END, CASE WHEN k % 40 = 4 THEN 'source_count' END, CASE WHEN k % 40 = 5 THEN 'other_final' END, CASE WHEN k % 40 = 6 THEN 'stale_final' END,
  CASE WHEN k % 40 = 7 THEN 'final_count' END, CASE WHEN k % 40 = 32 THEN 'target_id' END, CASE WHEN k % 40 = 33 THEN 'no_output' END, CASE WHEN k % 40 = 34 THEN 'repeated_output' END, CASE WHEN k % 40 = 35 THEN 'final_out_of_range' END, CASE WHEN k % 40 = 36 AND n > 1 THEN 'several_owners' END, CASE WHEN k % 40 = 37 THEN 'source_ordinal' END,
  CASE WHEN k % 40 = 38 THEN 'source_out_of_range' END, CASE WHEN k % 40 = 39 AND n > 1 THEN 'source_mapped_twice' END, CASE WHEN k % 40 = 0 THEN 'source_anchor' END, CASE WHEN k % 40 = 0 THEN 'expected_tex' END, CASE WHEN k % 40 = 1 THEN 'kind' END,
  CASE WHEN k % 40 IN (1, 33, 37, 38) OR (k % 40 = 39 AND n > 1) THEN 'source_coverage' END, CASE WHEN k % 40 IN (33, 35) OR (k % 40 = 36 AND n > 1) THEN 'final_coverage' END]) AS rule FROM h) SELECT k AS map_id, rule FROM r WHERE rule IS NOT NULL""")
def formula_map_errors(t: Tables):
    """Every order is a map: its lines are formulas, every third of them has two outputs; one order in forty breaks each rule."""
    from pyspark.sql import Window

    # a line makes about four rows in the check; all steps by map follow in the tasks that lines are dealt to
    tasks = tasks_for(4 * t.lineitem.count())
    lines = dealt_by(t.lineitem.where(F.col("l_orderkey").isNotNull()).select("l_orderkey", "l_linenumber"), ["l_orderkey"], tasks)
    of_map = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    s, n = F.row_number().over(of_map), F.count("*").over(of_map.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # a third formula has two outputs, so the outputs before one are as many as formulas and thirds before it
    rows = lines.select(F.col("l_orderkey").alias("map_id"), s.alias("s"), n.alias("n")).select("map_id", "s", "n", (F.col("s") + F.floor((F.col("s") - 1) / 3)).alias("f"), F.when(F.col("s") % 3 == 0, 2).otherwise(1).alias("w"), (F.col("s") == 1).alias("first"))
    m, odd = F.col("map_id") % 40, lambda n: (F.col("map_id") % 40 == n) & F.col("first")
    own = F.when(F.col("w") == 2, F.array("f", F.col("f") + 1)).otherwise(F.array("f"))
    outputs = F.when(odd(33), F.array().cast("array<bigint>")).when(odd(34), F.array("f", "f")).when(odd(35), F.array("f", F.lit(10000).cast("bigint"))).when((m == 36) & (F.col("s") == 2), F.array(F.lit(1).cast("bigint"))).otherwise(own)
    targets = rows.select(
        "map_id", F.when(odd(32), " ").otherwise(F.format_string("SRC-%04d", "s")).alias("target_id"), F.when(odd(1), "other").otherwise("source_formula").alias("kind"),
        F.when(odd(37), None).when(odd(38), 999).when((m == 39) & (F.col("s") == 2), 1).otherwise(F.col("s")).cast("long").alias("source_ordinal"),
        F.when(odd(0), "").otherwise("near").alias("source_anchor"), F.when(odd(0), None).otherwise("x").alias("expected_tex"), outputs.alias("final_ordinals"),
    )
    # both sides are dealt alike: they are merged, nothing is broadcast
    orders = dealt_by(t.orders.select(F.col("o_orderkey").alias("map_id")), ["map_id"], tasks).hint("merge")
    header = rows.where("first").select("map_id", "n", (F.col("n") + F.floor(F.col("n") / 3)).alias("w")).join(orders, "map_id", "left_semi")
    when = lambda n, a, b: F.when(m == n, a).otherwise(b)
    header = header.select(
        "map_id", when(1, "other/v1", f"x-{checks.MAP_SCHEMA}").alias("schema"), F.lit("s").alias("source_path"), when(2, "t", "s").alias("now_source_path"), F.lit("AB").alias("source_sha256"), when(3, "ac", "ab").alias("now_source_sha256"), (F.col("n") + when(4, 1, 0)).alias("source_count"), F.col("n").alias("now_source_count"),
        F.lit("f").alias("final_path"), when(5, "g", "f").alias("now_final_path"), F.lit("cd").alias("final_sha256"), when(6, None, "CD").alias("now_final_sha256"), when(7, None, F.col("w")).alias("final_count"), F.col("w").alias("now_final_count"),
    )
    return checks.formula_map(header, targets).drop("priority")


@query("""WITH a AS (SELECT doc_id AS ordinal, sha256(text) AS h FROM documents), b AS (SELECT CASE WHEN doc_id % 23 = 0 THEN -1 - doc_id ELSE doc_id END AS ordinal, CASE WHEN doc_id % 17 = 0 THEN 'stale' ELSE sha256(text) END AS h, CASE WHEN doc_id % 5 = 0 THEN 'maybe' ELSE 'approved' END AS decision FROM documents),
j AS (SELECT coalesce(a.ordinal, b.ordinal) AS ordinal, a.ordinal IS NOT NULL AS w, b.ordinal IS NOT NULL AS g, a.h IS NOT DISTINCT FROM b.h AS same, decision FROM a FULL JOIN b USING (ordinal))
SELECT ordinal, 'missing' AS rule FROM j WHERE NOT g UNION ALL SELECT ordinal, 'extra' FROM j WHERE NOT w UNION ALL SELECT ordinal, 'identity' FROM j WHERE NOT (w AND g AND same) UNION ALL SELECT ordinal, 'decision' FROM j WHERE coalesce(decision, '') NOT IN ('approved', 'rebuild') UNION ALL SELECT ordinal, 'evidence' FROM j WHERE NOT g""")
def class_e_review_errors(t: Tables):
    """All documents as the work list, and a review of each."""
    docs = t.documents.select(F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("h"), F.lit("x").alias("axmath_exported_tex"))
    reviews = docs.withColumn("h", F.when(F.col("ordinal") % 17 == 0, "stale").otherwise(F.col("h")))
    reviews = reviews.withColumn("decision", F.when(F.col("ordinal") % 5 == 0, "maybe").otherwise("approved")).withColumn("evidence", F.lit("seen"))
    # a review filed under a number that no document has: one is missing, one is extra
    reviews = reviews.withColumn("ordinal", F.when(F.col("ordinal") % 23 == 0, -1 - F.col("ordinal")).otherwise(F.col("ordinal")))
    return checks.class_e_review(docs, reviews, ["h", "axmath_exported_tex"]).drop("priority")


@query("""SELECT user_id AS run_id, 'working_changed' AS rule FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 = 1 UNION ALL SELECT user_id, 'remaining' FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) WHERE n % 3 = 0""")
def resume_checkpoint_errors(t: Tables):
    runs = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"))
    said = runs.select("run_id", F.lit("x-conversion-checkpoint/v1").alias("schema"), F.lit("A").alias("source_sha256"), F.lit("b").alias("working_sha256"), F.col("n").alias("remaining"))
    now = runs.select("run_id", F.lit("a").alias("source_sha256"), F.when(F.col("run_id") % 4 == 1, "c").otherwise("B").alias("working_sha256"), (F.col("n") + F.when(F.col("n") % 3 == 0, 1).otherwise(0)).alias("remaining"))
    return checks.resume_checkpoint(said, now).drop("priority")


@query("""WITH r AS (SELECT o_orderkey AS report_id, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 24 ELSE 48 END AS most, o_custkey % 50 AS n, o_orderstatus AS s FROM orders)
SELECT report_id, 'count' AS rule FROM r WHERE s = 'P' UNION ALL SELECT report_id, 'native_left' FROM r WHERE n % 25 = 0 UNION ALL SELECT report_id, 'batch_size' FROM r WHERE n > most""")
def repair_arithmetic_errors(t: Tables):
    o, n = F.col("o_orderkey"), F.col("o_custkey") % 50
    kind = F.when(o % 4 == 0, "baseline").when(o % 4 == 1, "inline").when(o % 4 == 2, "review").otherwise("export")
    rows = t.orders.select(
        o.alias("report_id"), kind.alias("kind"), n.alias("ordinals"), F.lit(10).alias("before"), F.lit(3).alias("expected_increase"), F.when(F.col("o_orderstatus") == "P", 12).otherwise(13).alias("after"),
        F.when(n % 25 == 0, 1).otherwise(0).alias("native_after"), F.lit(7).alias("paragraphs_before"), F.lit(7).alias("paragraphs_after"),
    )
    return checks.repair_arithmetic(rows).drop("priority")


@query("""SELECT p_name AS path, 'too_large' AS rule FROM part WHERE p_size > 45 UNION ALL SELECT p_name, 'pages' FROM part WHERE p_partkey % 30 = 0 OR p_partkey > 600""")
def pdf_gate_errors(t: Tables):
    rows = t.part.select(F.col("p_name").alias("path"), F.when(F.col("p_size") > 45, 300 << 20).otherwise(1000).alias("size"), F.lit(False).alias("encrypted"), F.when(F.col("p_partkey") % 30 == 0, 0).otherwise(F.col("p_partkey")).alias("pages"))
    return checks.pdf_gate(rows).drop("priority")


@query("""WITH r AS (SELECT user_id AS job_id, event_id AS n, event_type AS data_id, 'u' || event_id AS url FROM events)
SELECT job_id, coalesce(arg_min(url, n) FILTER (WHERE data_id = 'purchase'), CASE WHEN count(*) = 1 THEN min(url) END) AS url FROM r GROUP BY job_id""")
def picked_results(t: Tables):
    rows = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("n"), F.col("event_type").alias("data_id"), F.lit("purchase").alias("wanted_id"), F.lit(None).cast("string").alias("file_name"), F.lit("f").alias("wanted_file"), F.concat(F.lit("u"), F.col("event_id")).alias("url"))
    return checks.picked_result(rows)


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS pos, text AS shown, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
p AS (SELECT doc_id, string_agg(shown, '' ORDER BY pos) AS plain FROM c GROUP BY 1),
k AS (SELECT doc_id, i - 1 AS x FROM (SELECT doc_id, plain, unnest(range(1, length(plain) + 1)) AS i FROM p) WHERE plain[i] = ',' AND i > 1 AND plain[i - 1] = 'e')
SELECT k.doc_id, pos, CAST(x - (e - length(shown)) AS BIGINT) AS "offset", ',' AS old, ';' AS new FROM k JOIN c ON c.doc_id = k.doc_id AND x >= e - length(shown) AND x < e""")
def dealt_edits(t: Tables):
    """A mark after "e" is changed, also where the two lie in different runs."""
    tokens = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.lit("text").alias("kind"), "text")
    rows = edits.projected(tokens, ["doc_id"])
    ends = edits.match_ends(edits.paragraph_text(rows, ["doc_id"]), ["doc_id"], "e,")
    return edits.dealt(ends, rows, ["doc_id"], ",", ";")


@query("""WITH s AS (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
SELECT user_id, event_id, event_type NOT IN ('signup', 'error', 'view') AND s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) = 0 AND user_id % 7 <> 0 AS eligible FROM s""")
def body_eligibility(t: Tables):
    kind = F.when(F.col("event_type") == "signup", "fldBegin").when(F.col("event_type") == "error", "fldEnd").when(F.col("event_type") == "view", "instr").otherwise("text")
    tokens = t.events.select("user_id", "event_id", F.col("event_id").alias("pos"), kind.alias("kind"), (F.col("user_id") % 7 == 0).alias("in_header"))
    return edits.eligible_body(tokens, ["user_id"]).select("user_id", "event_id", "eligible")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS section, l_returnflag AS borders, l_tax > 0.075 AS m FROM lineitem), w AS (SELECT l_orderkey AS doc_id, l_linenumber AS section, CASE WHEN l_quantity > 40 THEN 'none' ELSE l_returnflag END AS borders FROM lineitem WHERE l_discount < 0.09),
r AS (SELECT a.doc_id FROM (SELECT doc_id, count(*) AS a, bool_or(m) AS m FROM s GROUP BY 1) a LEFT JOIN (SELECT doc_id, count(*) AS b FROM w GROUP BY 1) b USING (doc_id) WHERE m OR a IS DISTINCT FROM b)
SELECT s.doc_id, s.section, w.borders AS old, s.borders AS new FROM s JOIN w USING (doc_id, section) ANTI JOIN r ON r.doc_id = s.doc_id WHERE s.borders IS DISTINCT FROM w.borders""")
def page_style_edits(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section"), F.col("l_returnflag").alias("borders"), (F.col("l_tax") > 0.075).alias("has_media_rel"), "l_quantity", "l_discount")
    working = rows.where("l_discount < 0.09").withColumn("borders", F.when(F.col("l_quantity") > 40, "none").otherwise(F.col("borders")))
    return edits.page_styles(rows, working)[0]


@query("""WITH l AS (SELECT conv_id, turn, replace(regexp_replace(text, '[={}]', '', 'g'), ', ', CASE WHEN turn % 2 = 0 THEN ' = ' ELSE ' {=} ' END) AS x FROM conversations),
n AS (SELECT *, instr(regexp_replace(x, '\\{=\\}', '___', 'g'), '=') AS eq FROM l)
SELECT conv_id, '\\begin{aligned}' || string_agg(CASE WHEN eq > 0 THEN left(x, eq - 1) || '&' || x[eq:] ELSE '&' || x END, ' \\\\ ' ORDER BY turn) || '\\end{aligned}' AS tex FROM n GROUP BY conv_id""")
def aligned_assembly(t: Tables):
    """Whole turns as lines, aligned at their first equals sign outside braces, or at their begin."""
    text = F.regexp_replace("text", "[={}]", "")
    line = F.when(F.col("turn") % 2 == 0, F.replace(text, F.lit(", "), F.lit(" = "))).otherwise(F.replace(text, F.lit(", "), F.lit(" {=} ")))
    lines = t.conversations.select("conv_id", F.struct("turn", line.alias("x")).alias("line"))
    lists = lines.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("line")), lambda e: e["x"]).alias("lines"))
    return lists.select("conv_id", X.aligned(F.col("lines")).alias("tex"))
