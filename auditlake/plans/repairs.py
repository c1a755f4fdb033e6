"""Repairs, reviews and runs, over tables that play the part of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.operators import checks, edits, repairs
from auditlake.plans.registry import Tables, dealt_by, query, tasks_for

# Lines whose number is repeated in an order are one.
_LINES = "(SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL)"


def _lines(t: Tables, tasks: int | None = None):
    return dealt_by(t.lineitem, ["l_orderkey", "l_linenumber"], tasks).groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_tax", "l_discount")))


_DOLLARS = "CASE turn % 5 WHEN 0 THEN '$$' || text || '$$' WHEN 1 THEN '$' || text || '$' WHEN 2 THEN ' $' || text || ' ' WHEN 3 THEN text || '$$' ELSE text || '\\mathrm{' || chr(160) || '}' END"


def _dollars(t: Tables):
    n, text, one, two = F.col("turn") % 5, F.col("text"), F.lit("$"), F.lit("$$")
    made = F.when(n == 0, F.concat(two, text, two)).when(n == 1, F.concat(one, text, one)).when(n == 2, F.concat(F.lit(" $"), text, F.lit(" "))).when(n == 3, F.concat(text, two)).otherwise(F.concat(text, F.lit("\\mathrm{\u00a0}")))
    return t.conversations.select("conv_id", "turn", made.alias("tex"))


_SINGLE = "CASE WHEN starts_with(v, '$$') AND ends_with(v, '$$') AND length(v) >= 4 THEN '$' || substr(v, 3, length(v) - 4) || '$' WHEN starts_with(v, '$') AND ends_with(v, '$') THEN v ELSE '$' || trim(v, '$') || '$' END"


@query(f"""WITH d AS (SELECT conv_id, turn, regexp_replace({_DOLLARS}, '^\\s+|\\s+$', '', 'g') AS v FROM conversations)
SELECT conv_id, turn, {_SINGLE} AS single, replace({_SINGLE}, '\\mathrm{{' || chr(160) || '}}', '') AS inline FROM d""")
def formula_delimiters(t: Tables):
    return _dollars(t).select("conv_id", "turn", X.single_dollar(F.col("tex")).alias("single"), X.inline_tex(F.col("tex")).alias("inline"))


@query("SELECT conv_id, turn, replace(replace(text, ' ', CASE WHEN turn % 2 = 0 THEN chr(13) ELSE chr(7) END), chr(13), chr(10)).replace(chr(7), '') AS cleaned FROM conversations")
def cleaned_text(t: Tables):
    """Every turn with carriage returns or bells in place of spaces."""
    dirty = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\r"))).otherwise(F.replace("text", F.lit(" "), F.lit("\u0007")))
    return t.conversations.select("conv_id", "turn", X.clean_text(dirty).alias("cleaned"))


@query("""SELECT l_orderkey, l_linenumber, list_sort(list_distinct(regexp_extract_all(upper(x), '\\b(SEQ|LISTNUM|AUTONUMLGL|AUTONUMOUT|AUTONUM)\\b', 1))) AS fields, CASE WHEN l_tax > 0.05 THEN NULL WHEN l_tax > 0.03 THEN 'disabled' ELSE 'candidate' END AS state
FROM (SELECT *, ' ' || l_shipmode || CASE l_linenumber % 4 WHEN 0 THEN ' seq Figure  autonumlgl SEQ x' WHEN 1 THEN ' REF a ListNum' WHEN 2 THEN ' sequel' ELSE '' END AS x FROM (SELECT l_orderkey, l_linenumber, l_tax, 'AIR' AS l_shipmode FROM lineitem))""")
def numbering_states(t: Tables):
    """Field kinds of a line's instructions, and what its list number says."""
    n = F.col("l_linenumber") % 4
    instructions = F.concat(F.lit(" AIR"), F.when(n == 0, " seq Figure  autonumlgl SEQ x").when(n == 1, " REF a ListNum").when(n == 2, " sequel").otherwise(""))
    number = F.when(F.col("l_tax") > 0.05, None).when(F.col("l_tax") > 0.03, "0").otherwise("7")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.numbering_fields(instructions).alias("fields"), X.number_state(number).alias("state"))


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity AS old_width, round(l_quantity * 0.5, 2) AS new_width, round(l_linenumber * 0.5, 2) AS new_height FROM {_LINES} JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def shell_sizes(t: Tables):
    """Lines as objects; the plan of an order that is done may be applied on its own."""
    plan = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0.5).alias("scale"), (F.col("o_orderstatus") == "F").alias("auto_apply"))
    objects = _lines(t).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("width"), F.col("l_linenumber").cast("double").alias("height"))
    plan = plan.join(objects.select("l_orderkey", "l_linenumber"), "l_orderkey")
    return edits.shell_calibration(plan, objects, ["l_orderkey", "l_linenumber"])


@query("""WITH s AS (SELECT conv_id AS doc_id, turn AS p, regexp_replace(text, '\\s', '', 'g') AS x FROM conversations), c AS (SELECT doc_id, max(p) AS top, count(*) AS a, min(p) AS low FROM s GROUP BY 1),
w AS (SELECT s.doc_id, p, CASE WHEN ascii(x) % 7 = 0 THEN x || '!' ELSE x END AS y, CASE WHEN ascii(x) % 13 = 0 THEN 1 ELSE 0 END AS native, length(x) % 3 AS soft FROM s JOIN c USING (doc_id) WHERE NOT (a % 4 = 0 AND p = top)),
b AS (SELECT doc_id, count(*) AS b, sum(native) AS native FROM w GROUP BY 1), m AS (SELECT s.doc_id, count(*) FILTER (WHERE y IS DISTINCT FROM x) AS moved FROM s LEFT JOIN w USING (doc_id, p) GROUP BY 1),
k AS (SELECT c.doc_id, coalesce(soft, -1) >= 1 AS enough FROM c LEFT JOIN w ON w.doc_id = c.doc_id AND w.p = c.low),
j AS (SELECT c.doc_id, a, b, native, moved, enough FROM c LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, 'paragraph_count' AS rule FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT doc_id, 'native_left' FROM j WHERE coalesce(native <> 0, true) UNION ALL SELECT doc_id, 'text_changed' FROM j WHERE moved <> 0 UNION ALL SELECT doc_id, 'soft_breaks' FROM j WHERE NOT enough""")
def repair_ledger_errors(t: Tables):
    """Conversations as documents; the working version lacks some last turns, has some marks and some native formulas."""
    source = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("p"), F.col("text").alias("plain"))
    flat = F.regexp_replace("plain", r"\s", "")
    counts = source.groupBy("doc_id").agg(F.max("p").alias("top"), F.count("*").alias("a"), F.min("p").alias("low"))
    letter = F.ascii(flat)
    working = source.join(counts, "doc_id").where(~((F.col("a") % 4 == 0) & (F.col("p") == F.col("top"))))
    working = working.select("doc_id", "p", F.when(letter % 7 == 0, F.concat("plain", F.lit("!"))).otherwise(F.col("plain")).alias("plain"), F.when(letter % 13 == 0, 1).otherwise(0).alias("native"), (F.length(flat) % 3).alias("soft_breaks"))
    targets = counts.select("doc_id", F.col("low").alias("p"), F.lit(2).alias("lines"))
    return checks.repair_ledger(source, working, targets).drop("priority")


@query(f"""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS p, CAST(l_quantity AS BIGINT) AS f FROM {_LINES}), a AS (SELECT doc_id, p, CASE WHEN f = 50 THEN 0 ELSE f END AS f FROM b WHERE NOT (doc_id % 17 = 0 AND p = 1)),
m AS (SELECT b.doc_id, count(*) FILTER (WHERE a.f IS DISTINCT FROM b.f) AS moved, sum(b.f) AS total FROM b LEFT JOIN a USING (doc_id, p) GROUP BY 1),
h AS (SELECT o_orderkey AS doc_id, o_orderstatus, o_custkey FROM orders), j AS (SELECT h.*, moved, total FROM h LEFT JOIN m USING (doc_id))
SELECT doc_id, 'status' AS rule FROM j WHERE o_orderstatus = 'P' UNION ALL SELECT doc_id, 'original_changed' FROM j WHERE o_custkey % 9 = 0 UNION ALL SELECT doc_id, 'counts' FROM j WHERE coalesce(total > 100, true) UNION ALL SELECT doc_id, 'paragraph_sequence' FROM j WHERE coalesce(moved <> 0, true)""")
def restore_errors(t: Tables):
    """Lines as paragraphs, quantities as formula counts; a header names no more than a hundred."""
    tasks = tasks_for(t.lineitem.count())
    before = _lines(t, tasks).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("p"), F.col("l_quantity").cast("long").alias("formulas"))
    after = before.where(~((F.col("doc_id") % 17 == 0) & (F.col("p") == 1))).withColumn("formulas", F.when(F.col("formulas") == 50, 0).otherwise(F.col("formulas")))
    sums = dealt_by(before, ["doc_id"], tasks).groupBy("doc_id").agg(F.sum("formulas").alias("x"))
    header = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("ready").alias("status"), F.lit("A").alias("original_sha256"), F.when(F.col("o_custkey") % 9 == 0, "b").otherwise("a").alias("now_sha256"))
    header = dealt_by(header, ["doc_id"], tasks).join(sums, "doc_id", "left").select("doc_id", "status", "original_sha256", "now_sha256", F.least("x", F.lit(100)).alias("formula_count"))
    return checks.restore_gate(header, before, after, tasks=tasks).drop("priority")


_STATES = tuple(checks.JOB_STEPS)
_STEPS = ", ".join(f"('{a}', '{b}')" for a, following in checks.JOB_STEPS.items() for b in following)


@query(f"""WITH e AS (SELECT user_id, event_id, [{", ".join(f"'{s}'" for s in _STATES)}][event_id % {len(_STATES)} + 1] AS to_state, ts FROM events), s AS (SELECT *, lag(to_state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM e), a(f, g) AS (VALUES {_STEPS})
SELECT user_id, event_id, from_state, to_state FROM s WHERE from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE f = from_state AND g = to_state)""")
def job_step_errors(t: Tables):
    """Events as states of recognition jobs, against the steps that such a job may take."""
    from auditlake.operators import rules

    state = F.element_at(F.array(*(F.lit(s) for s in _STATES)), (F.col("event_id") % len(_STATES) + 1).cast("int"))
    rows = t.events.select("user_id", "event_id", "ts", state.alias("state"))
    return rules.bad_transitions(rows, "user_id", "state", ["ts", "event_id"], F.broadcast(checks.allowed_steps(t.spark))).select("user_id", "event_id", "from_state", "to_state")


_FILE = "CASE l_linenumber % 4 WHEN 0 THEN 'a/Full.docx' WHEN 1 THEN 'b/part' || l_suppkey || '.docx' WHEN 2 THEN 'c/page.md' ELSE 'd/image' || l_linenumber || '.png' END"


@query(f"""WITH f AS (SELECT l_orderkey, {_FILE} AS path FROM lineitem), c AS (SELECT l_orderkey, count(*) FILTER (WHERE path LIKE '%.docx') AS n, count(*) FILTER (WHERE path = 'a/Full.docx') AS u, min(path) FILTER (WHERE path LIKE '%.docx') AS sole FROM f GROUP BY 1)
SELECT l_orderkey, CASE WHEN u = 1 THEN 'a/Full.docx' WHEN n = 1 THEN sole END AS path, CASE WHEN u = 1 OR n = 1 THEN NULL WHEN n = 0 THEN 'no_document' ELSE 'several_documents' END AS reason FROM c""")
def chosen_documents(t: Tables):
    """Lines as files of an order's archive."""
    n = F.col("l_linenumber") % 4
    path = F.when(n == 0, "a/Full.docx").when(n == 1, F.concat(F.lit("b/part"), "l_suppkey", F.lit(".docx"))).when(n == 2, "c/page.md").otherwise(F.concat(F.lit("d/image"), "l_linenumber", F.lit(".png")))
    return repairs.chosen_document(t.lineitem.select("l_orderkey", path.alias("path")), "l_orderkey")


@query("""WITH r AS (SELECT event_id, user_id, event_id // 500 AS stamp, row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY event_id) AS n FROM events) SELECT event_id, user_id, 'run-' || stamp || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS run FROM r""")
def run_folders(t: Tables):
    return repairs.run_names(t.events, "user_id", F.floor(F.col("event_id") / 500).cast("string"), ["event_id"]).select("event_id", "user_id", "run")


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AND o_custkey % 11 <> 0 AND coalesce(n, 9) <= 4 AND o_orderpriority <> '5-LOW' AND o_custkey % 7 <> 3 AS success FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def conversion_results(t: Tables):
    """Orders as runs; what is unknown counts as failed."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    c = F.col("o_custkey")
    runs = t.orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("exit_code"), F.when(c % 11 == 0, 1).otherwise(0).alias("native_left"), *(F.lit(0).alias(x) for x in ("foreign_source", "foreign_candidate", "outside_source", "outside_candidate")),
        F.lit(True).alias("complete"), (F.col("n") <= 4).alias("count_acceptable"), (F.col("o_orderpriority") != "5-LOW").alias("paragraphs_equal"), F.when(c % 7 != 3, True).alias("text_exact"), F.lit(True).alias("source_unchanged"),
    )
    return repairs.conversion_success(runs, "o_orderkey")


@query("""WITH q AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), g AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS w, bool_and(l_tax <= 0.07 AND l_discount > 0.005) AS ok FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 49 GROUP BY 1)
SELECT o_orderkey AS k, q.w IS NULL OR coalesce(o_custkey % 8 <> 0 AND g.w = q.w AND ok, false) AS verified FROM orders LEFT JOIN q ON q.k = o_orderkey LEFT JOIN g ON g.k = o_orderkey""")
def prime_reviews(t: Tables):
    """Returned lines need a review; a few lack one, some are not passed or have no evidence."""
    lines = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal"), "l_quantity", "l_tax", "l_discount")
    rows = lines.where("l_quantity < 49").select("k", "ordinal", (F.col("l_tax") <= 0.07).alias("source_semantics_match"), F.lit(True).alias("contract_verified"), F.when(F.col("l_discount") > 0.005, "seen").otherwise(" ").alias("evidence"))
    headers = t.orders.select(
        F.col("o_orderkey").alias("k"), F.lit("x-prime-semantic-review/v1").alias("schema"), F.lit("s").alias("source_sha256"), F.when(F.col("o_custkey") % 8 == 0, "old").otherwise("s").alias("now_source"), F.lit("w").alias("working_sha256"), F.lit("w").alias("now_working")
    )
    return repairs.prime_reviews(headers, lines, rows, "k")


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity AS width, CASE WHEN l_quantity <= 10 AND l_linenumber > 1 THEN 'CLASS_E_SEMANTIC_REBUILD' WHEN l_tax <= 0.06 AND l_discount > 0.05 THEN 'M2_SOURCE_VISUAL_WRAP_LOSS' ELSE 'OVERWIDE_SOURCE_SINGLELINE_REVIEW' END AS repair_class
FROM {_LINES} WHERE l_quantity <= 10 AND l_linenumber > 1 OR l_quantity > 45""")
def fast_triage(t: Tables):
    """Lines as objects in sections of 45 points; a probe failed where the tax is high."""
    objects = _lines(t).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("width"), F.lit(45.0).alias("section_width"), F.repeat(F.lit("x "), F.col("l_linenumber").cast("int")).alias("source"))
    probes = _lines(t).select("l_orderkey", "l_linenumber", (F.col("l_tax") <= 0.06).alias("success"), (F.col("l_discount") > 0.05).alias("multiline"))
    return repairs.triage(objects, probes, ["l_orderkey", "l_linenumber"])


@query("""WITH o AS (SELECT user_id, event_id AS ordinal, event_id // 100 AS p, row_number() OVER (PARTITION BY user_id, event_id // 100 ORDER BY event_id) AS local FROM events), m AS (SELECT user_id, ordinal, CASE WHEN ordinal % 3 <> 0 THEN p END AS p, CASE WHEN ordinal % 2 = 0 THEN local + 1 ELSE local END AS local FROM o)
SELECT m.user_id, m.ordinal, CASE WHEN m.p IS NULL THEN m.ordinal ELSE o.ordinal END AS found FROM m LEFT JOIN o ON o.user_id = m.user_id AND o.p = m.p AND o.local = m.local""")
def located_targets(t: Tables):
    """Events as objects of a user's document; a map row names paragraph and place, or the ordinal alone."""
    objects = t.events.select("user_id", F.col("event_id").alias("ordinal"), F.floor(F.col("event_id") / 100).alias("p"))
    at = repairs.ordinal_locations(objects, ["user_id"])
    targets = at.select("user_id", "ordinal", F.when(F.col("ordinal") % 3 != 0, F.col("p")).alias("p"), (F.col("local") + F.when(F.col("ordinal") % 2 == 0, 1).otherwise(0)).alias("local"))
    return repairs.located(targets, objects, ["user_id"])


@query("""SELECT * FROM (SELECT doc_id, length(text) - length(replace(text, '/', '')) AS fractions, length(text) - length(replace(text, '=', '')) AS relations, length(text) - length(replace(text, '+', '')) AS operators FROM documents) WHERE fractions > 0 OR relations > 0 OR operators > 0""")
def structure_candidates(t: Tables):
    counts = t.documents.select("doc_id", *(X.occurrences(F.col("text"), sign).cast("long").alias(name) for sign, name in (("/", "fractions"), ("=", "relations"), ("+", "operators"))))
    return repairs.structure_candidates(counts, ["fractions", "relations", "operators"])


@query("""SELECT o_orderkey, 'schema' AS rule FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT o_orderkey, 'unbound' FROM orders WHERE o_custkey % 6 = 0 UNION ALL SELECT o_orderkey, 'other_file' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'stale' FROM orders WHERE o_custkey % 6 = 0 OR o_custkey % 4 = 1""")
def calibration_binding_errors(t: Tables):
    c = F.col("o_custkey")
    plans = t.orders.select(
        "o_orderkey", F.when(c % 10 == 0, "x-geometry-audit/v1").otherwise("x-geometry-audit/v2").alias("schema"), F.when(F.col("o_orderstatus") == "P", "b.docx").otherwise("a.docx").alias("planned_path"), F.lit("a.docx").alias("path"),
        F.when(c % 6 == 0, None).when(c % 4 == 1, "old").otherwise("new").alias("planned_sha256"), F.lit("new").alias("sha256"),
    )
    return repairs.calibration_binding(plans, "o_orderkey").drop("priority")
