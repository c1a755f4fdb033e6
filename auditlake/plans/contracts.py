"""Gates, reviews, dispatchers, queues and job states."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import rules as R
from auditlake.plans.registry import Tables, query


@query("SELECT coalesce(nullif(trim(CAST(l.quality AS VARCHAR)), ''), '<missing>') AS label, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_counter_missing(t: Tables):
    return R.label_counts(t.documents.join(t.labels, "doc_id", "left"), "quality")


@query("""SELECT doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0) ANTI JOIN (SELECT doc_id FROM labels WHERE doc_id % 3 = 0) USING (doc_id)""")
def queue_algebra(t: Tables):
    return R.queue_algebra(t.labels.where("toxic = 1"), t.labels.where("quality = 0"), t.labels.where("doc_id % 3 = 0"), "doc_id")


_REVIEW_SQL = """i AS (SELECT doc_id, sha256(text) AS digest FROM documents),
v AS (SELECT l.doc_id + CASE WHEN l.doc_id % 40 = 0 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN l.doc_id % 14 = 0 THEN 'stale' ELSE sha256(d.text) END AS digest, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN false END AS passed
  FROM labels l JOIN documents d USING (doc_id) UNION ALL SELECT doc_id, sha256(text), true FROM documents WHERE doc_id % 26 = 0),
c AS (SELECT doc_id, count(*) AS n, min(digest) AS lo, max(digest) AS hi, bool_and(coalesce(passed, false)) AS passed FROM v GROUP BY doc_id),
b AS (SELECT coalesce(i.doc_id, c.doc_id) AS doc_id, i.doc_id IS NOT NULL AS there, i.digest, n, lo, hi, passed FROM i FULL JOIN c USING (doc_id)),
e AS (SELECT doc_id, 'duplicate' AS rule FROM b WHERE n > 1 UNION ALL SELECT doc_id, 'missing' FROM b WHERE n IS NULL UNION ALL SELECT doc_id, 'extra' FROM b WHERE NOT there
  UNION ALL SELECT doc_id, 'hash_mismatch' FROM b WHERE there AND n IS NOT NULL AND (digest IS DISTINCT FROM lo OR digest IS DISTINCT FROM hi) UNION ALL SELECT doc_id, 'not_passed' FROM b WHERE there AND n IS NOT NULL AND NOT passed)"""


def _review(t: Tables):
    inventory = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    # hashed before the join, which then carries no text
    said = t.labels.join(t.documents.select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")
    passed = F.when(F.col("quality") == 1, True).when(F.col("toxic") == 1, False)
    digest = F.when(F.col("doc_id") % 14 == 0, "stale").otherwise(F.col("sha256"))
    first = said.select((F.col("doc_id") + F.when(F.col("doc_id") % 40 == 0, 1000000).otherwise(0)).alias("doc_id"), digest.alias("digest"), passed.alias("passed"))
    second = t.documents.where("doc_id % 26 = 0").select("doc_id", F.sha2("text", 256).alias("digest"), F.lit(True).alias("passed"))
    return inventory, R.review_errors(inventory, first.unionByName(second), "doc_id", "digest")


@query(f"WITH {_REVIEW_SQL} SELECT doc_id, rule FROM e")
def review_join_errors(t: Tables):
    return _review(t)[1]


@query(f"WITH {_REVIEW_SQL} SELECT i.doc_id, count(e.rule) AS errors, count(e.rule) = 0 AS acceptance_pass FROM i LEFT JOIN e USING (doc_id) GROUP BY i.doc_id")
def finalized_review(t: Tables):
    inventory, found = _review(t)
    return R.accepted(inventory, found, "doc_id")


@query("""SELECT l_orderkey, CASE WHEN l > 0 THEN 'residual_officemath' WHEN raw = c THEN 'exact' WHEN x > 0 AND raw - c = x THEN 'known_multisibling_collapse' WHEN raw > c THEN 'unexpected_formula_loss' ELSE 'unexpected_formula_excess' END AS state
FROM (SELECT l_orderkey, count(*) AS raw, count(*) FILTER (WHERE l_quantity > 30) AS x, count(*) FILTER (WHERE l_quantity <= 30 OR l_tax > 0.07) + count(*) FILTER (WHERE l_discount > 0.095) AS c, count(*) FILTER (WHERE l_discount < 0.005) AS l FROM lineitem GROUP BY 1)""")
def count_state(t: Tables):
    counts = t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("raw"), F.count_if(F.col("l_quantity") > 30).alias("x"), F.count_if(F.col("l_discount") < 0.005).alias("left"),
        (F.count_if((F.col("l_quantity") <= 30) | (F.col("l_tax") > 0.07)) + F.count_if(F.col("l_discount") > 0.095)).alias("c"),
    )
    return counts.select("l_orderkey", R.count_state(F.col("raw"), F.col("x"), F.col("c"), F.col("left")).alias("state"))


@query("""SELECT l_orderkey, CASE WHEN f > 0 THEN 'blocked' WHEN n > 0 AND c = 0 THEN 'ready_officemath' WHEN n > 0 AND c > 0 THEN 'mixed' WHEN c > 0 THEN 'already_axmath' ELSE 'no_native_math' END AS state
FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_tax > 0.078) AS f, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS c FROM lineitem GROUP BY 1)""")
def source_state(t: Tables):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_tax") > 0.078).alias("f"), F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("c"))
    return counts.select("l_orderkey", R.source_state(F.col("f"), F.col("n"), F.col("c")).alias("state"))


_RULES = [
    ("blocked_unhandled_embedded_math", "STOP_UNHANDLED_EMBEDDED_MATH", "foreign > 0"),
    ("blocked_content_drift", "STOP_CONTENT_DRIFT", "lines > 60"),
    ("repair_required", "M1_MULTISIBLING_OMATHPARA", "pipes > 20"),
    ("repair_review_required", "M2_LINE_SPLIT", "n_chars > 8000"),
    ("repair_review_required", "CLASS_E", "quality = 0"),
    ("repair_review_required", "PRIME", "digits > 40"),
]
_METRICS_SQL = """m AS (SELECT d.doc_id, n_chars, quality, len(regexp_extract_all(text, '[#$%&]')) // 50 AS foreign_, len(string_split(text, chr(10))) AS lines, len(text) - len(replace(text, '|', '')) AS pipes, len(regexp_extract_all(text, '[0-9]')) AS digits
  FROM documents d LEFT JOIN labels USING (doc_id)),
h AS (SELECT doc_id, 1 AS n, 'blocked_unhandled_embedded_math' AS status, 'STOP_UNHANDLED_EMBEDDED_MATH' AS repair_class FROM m WHERE foreign_ > 0
  UNION ALL SELECT doc_id, 2, 'blocked_content_drift', 'STOP_CONTENT_DRIFT' FROM m WHERE lines > 60 UNION ALL SELECT doc_id, 3, 'repair_required', 'M1_MULTISIBLING_OMATHPARA' FROM m WHERE pipes > 20
  UNION ALL SELECT doc_id, 4, 'repair_review_required', 'M2_LINE_SPLIT' FROM m WHERE n_chars > 8000 UNION ALL SELECT doc_id, 5, 'repair_review_required', 'CLASS_E' FROM m WHERE quality = 0
  UNION ALL SELECT doc_id, 6, 'repair_review_required', 'PRIME' FROM m WHERE digits > 40)"""


def _metrics(t: Tables):
    text = F.col("text")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "n_chars", "quality", F.floor(F.regexp_count(text, F.lit("[#$%&]")) / 50).alias("foreign"), F.size(F.split(text, "\n")).alias("lines"),
        (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))).alias("pipes"), F.regexp_count(text, F.lit("[0-9]")).alias("digits"),
    )


@query(f"""WITH {_METRICS_SQL} SELECT m.doc_id, coalesce(arg_min(status, n), 'ready_for_strict_final_compare') AS status, arg_min(repair_class, n) AS repair_class, count(n) AS hits FROM m LEFT JOIN h USING (doc_id) GROUP BY m.doc_id""")
def dispatcher_first_match(t: Tables):
    return R.dispatch(_metrics(t), "doc_id", _RULES)


@query(f"WITH {_METRICS_SQL} SELECT doc_id, repair_class FROM h")
def repair_queues(t: Tables):
    return R.queues(_metrics(t), "doc_id", _RULES)


@query(f"""WITH {_METRICS_SQL} SELECT repair_class, 'repair --class ' || repair_class || ' --ordinals ' || string_agg(doc_id, ',' ORDER BY doc_id) AS action FROM h GROUP BY repair_class""")
def next_actions(t: Tables):
    found = R.queues(_metrics(t), "doc_id", _RULES).groupBy("repair_class").agg(F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string")), ",").alias("o"))
    return found.select("repair_class", F.format_string("repair --class %s --ordinals %s", "repair_class", "o").alias("action"))


@query(f"""WITH {_METRICS_SQL} SELECT source, coalesce(bool_and(coalesce(foreign_ = 0, false)), true) AS no_foreign, coalesce(bool_and(coalesce(quality = 1, false)), true) AS all_reviewed, max(lines) <= 400 AS short_enough,
  coalesce(bool_and(coalesce(foreign_ = 0, false)), true) AND coalesce(bool_and(coalesce(quality = 1, false)), true) AND max(lines) <= 400 AS hard_content_pass,
  CASE WHEN count(*) FILTER (WHERE quality = 1) > 0 AND count(*) FILTER (WHERE quality = 0) = 0 THEN 'ready' WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN 'partial' ELSE 'blocked' END AS run_status
FROM m JOIN documents USING (doc_id) GROUP BY source""")
def acceptance_gates(t: Tables):
    """Unknown never passes."""
    rows = _metrics(t).join(t.documents.select("doc_id", "source"), "doc_id")
    out = rows.groupBy("source").agg(
        R.every(F.col("foreign") == 0).alias("no_foreign"), R.every(F.col("quality") == 1).alias("all_reviewed"), R.holds(F.max("lines") <= 400).alias("short_enough"),
        R.run_status(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).alias("run_status"),
    )
    return out.withColumn("hard_content_pass", R.all_hold(F.col("no_foreign"), F.col("all_reviewed"), F.col("short_enough")))


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 0 THEN 'schema' WHEN trim(text) = '' THEN 'empty_export' WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'control_character' WHEN quality IS NULL THEN 'not_reviewed' WHEN quality = 0 THEN 'rejected' END AS rule
FROM documents d LEFT JOIN labels USING (doc_id) WHERE rule IS NOT NULL""")
def internal_audit_first_error(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    found = R.errors(
        rows, "doc_id", ("schema", F.col("doc_id") % 9 != 0), ("empty_export", F.trim("text") != ""), ("control_character", ~F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")),
        ("not_reviewed", F.col("quality").isNotNull()), ("rejected", F.col("quality") == 1),
    )
    return R.first_error(found, "doc_id")


@query("""WITH e AS (SELECT source AS k, count(*) AS docs, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1), a AS (SELECT source AS k, count(*) AS docs, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1)
SELECT k, 'docs' AS metric, e.docs AS expected, a.docs AS actual FROM e LEFT JOIN a USING (k) WHERE coalesce(e.docs <> a.docs, true) UNION ALL SELECT k, 'langs', e.langs, a.langs FROM e LEFT JOIN a USING (k) WHERE coalesce(e.langs <> a.langs, true)
UNION ALL SELECT k, 'chars', e.chars, a.chars FROM e LEFT JOIN a USING (k) WHERE coalesce(e.chars <> a.chars, true)""")
def structure_defects(t: Tables):
    def counted(d):
        return d.groupBy(F.col("source").alias("k")).agg(F.count("*").alias("docs"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"))

    return R.structure_defects(counted(t.documents), counted(t.documents.where("doc_id % 7 <> 0")), "k", ["docs", "langs", "chars"], exact=True)


@query("SELECT DISTINCT l_partkey AS ordinal FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def requested_not_available(t: Tables):
    return R.not_available(t.lineitem.select(F.col("l_partkey").alias("ordinal")), t.part.where("p_size > 10").select(F.col("p_partkey").alias("ordinal")), "ordinal")


@query("SELECT doc_id, sha256(text) = CASE WHEN doc_id % 13 = 0 THEN sha256(text || ' ') ELSE lower(upper(sha256(text))) END AS bound FROM documents")
def hash_binding(t: Tables):
    stored = F.when(F.col("doc_id") % 13 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.upper(F.sha2("text", 256)))
    return t.documents.select("doc_id", (F.sha2("text", 256) == F.lower(stored)).alias("bound"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS updates FROM events GROUP BY user_id")
def latest_job_state(t: Tables):
    return R.latest_state(t.events, "user_id", "event_type", ["ts", "event_id"])


@query("""WITH s AS (SELECT user_id, ts, event_id, event_type AS to_state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
SELECT user_id, event_id, from_state, to_state FROM s WHERE from_state IS NOT NULL AND NOT (from_state = 'signup' OR to_state = 'click' OR from_state = to_state)""")
def job_transitions(t: Tables):
    kinds = t.events.select("event_type").distinct()
    pairs = kinds.select(F.col("event_type").alias("from_state"), F.lit(1).alias("j")).join(kinds.select(F.col("event_type").alias("to_state"), F.lit(1).alias("j")), "j").drop("j")
    allowed = F.broadcast(pairs.where("from_state = 'signup' or to_state = 'click' or from_state = to_state"))
    return R.bad_transitions(t.events, "user_id", "event_type", ["ts", "event_id"], allowed).select("user_id", "event_id", "from_state", "to_state")


@query("""SELECT user_id, event_id, value AS remaining, before FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value >= before""")
def monotone_progress(t: Tables):
    rows = t.events.withColumnRenamed("value", "remaining")
    return R.not_decreasing(rows, "user_id", ["ts", "event_id"], "remaining").select("user_id", "event_id", "remaining", "before")


@query("""SELECT vec_id, label, CASE WHEN label IS NULL THEN 'missing' WHEN vec_id % 24 = 0 THEN 'stale' ELSE 'ok' END AS state, count(*) OVER (PARTITION BY label) <= 24 AS bounded FROM embeddings""")
def bounded_batches(t: Tables):
    """A review takes a bounded number of ordinals at a time."""
    counted = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    rows = t.embeddings.select("vec_id", "label").join(counted, "label", "left")
    return rows.select("vec_id", "label", F.when(F.col("label").isNull(), "missing").when(F.col("vec_id") % 24 == 0, "stale").otherwise("ok").alias("state"), (F.col("n") <= 24).alias("bounded"))


@query("""SELECT conv_id, p, text, working_source_p FROM (SELECT c.conv_id, turn AS p, text, turn - 1 AS working_source_p, count(*) OVER (PARTITION BY c.conv_id, text) AS same FROM conversations c) WHERE same = 1 AND working_source_p >= 1""")
def local_layout_plan(t: Tables):
    """Targets found exactly once get the paragraph that lies one before."""
    counts = t.conversations.groupBy("conv_id", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("same")).where("same = 1")
    rows = t.conversations.withColumn("h", F.sha2("text", 256)).join(counts, ["conv_id", "h"])
    return rows.select("conv_id", F.col("turn").alias("p"), "text", (F.col("turn") - 1).alias("working_source_p")).where("working_source_p >= 1")


_PART_STYLES = """SELECT p_partkey // 50 AS doc_id, CAST(p_partkey AS VARCHAR) AS style_id, CASE WHEN p_size > 40 THEN p_size END AS num_id,
CAST(CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 3 WHEN p_partkey % 5 <> 0 THEN p_partkey + 1 END AS VARCHAR) AS based_on FROM part"""


@query(f"""WITH RECURSIVE s AS ({_PART_STYLES}),
up(doc_id, style_id, nxt, depth, seen, found) AS (SELECT doc_id, style_id, based_on, 0, [style_id], num_id FROM s
  UNION ALL SELECT u.doc_id, u.style_id, s.based_on, u.depth + 1, list_append(u.seen, s.style_id), s.num_id FROM up u JOIN s ON s.doc_id = u.doc_id AND s.style_id = u.nxt WHERE u.found IS NULL AND NOT list_contains(u.seen, s.style_id))
SELECT doc_id, style_id, arg_min(found, depth) FILTER (WHERE found IS NOT NULL) AS num_id FROM up GROUP BY doc_id, style_id""")
def style_ancestry_first_non_null(t: Tables):
    """Parts as styles, fifty a document; cycles and parents in another document end the search."""
    k = F.col("p_partkey")
    based_on = F.when(k % 50 == 49, k - 3).when(k % 5 != 0, k + 1).cast("string")
    styles = t.part.select(F.floor(k / 50).alias("doc_id"), k.cast("string").alias("style_id"), based_on.alias("based_on"), F.when(F.col("p_size") > 40, F.col("p_size")).alias("num_id"))
    return R.inherited_first(styles, "num_id", ["doc_id"])
