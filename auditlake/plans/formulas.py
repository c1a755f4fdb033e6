"""Queries on formulas in their paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from auditlake.operators import formulas as M
from auditlake.plans.registry import Tables, query


@query("SELECT l_orderkey, l_returnflag, list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber) AS ordinals, count(*) - 1 AS extra FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def multi_sibling_groups(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("long").alias("ordinal"))
    return M.sibling_groups(rows, ["l_orderkey", "l_returnflag"])


@query("SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') = 1 AND count(*) FILTER (WHERE l_returnflag = 'A') = 0 AND count(*) FILTER (WHERE l_quantity > 45) = 0")
def standalone_formulas(t: Tables):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("formulas"), F.count_if(F.col("l_returnflag") == "A").alias("objects"), F.when(F.count_if(F.col("l_quantity") > 45) > 0, "text").otherwise(" ").alias("plain"))
    return M.standalone(counts).select("doc_id")


_TAGS = ("limLow", "sSub", "limUpp", "sSup", "sSubSup", "rad")


@query("""WITH n AS (SELECT event_id, ['limLow', 'sSub', 'limUpp', 'sSup', 'sSubSup', 'rad'][event_id % 6 + 1] AS tag, CASE WHEN event_type = 'click' THEN ' Lim ' ELSE event_type END AS base FROM events)
SELECT event_id, CASE WHEN tag IN ('limLow', 'sSub') THEN ['below'] WHEN tag IN ('limUpp', 'sSup') THEN ['above'] ELSE ['below', 'above'] END AS placements FROM n WHERE lower(trim(base)) = 'lim' AND tag <> 'rad'""")
def limit_script_candidates(t: Tables):
    tags = F.array(*(F.lit(x) for x in _TAGS))
    nodes = t.events.select("event_id", F.element_at(tags, (F.col("event_id") % 6 + 1).cast("int")).alias("tag"), F.when(F.col("event_type") == "click", " Lim ").otherwise(F.col("event_type")).alias("base"))
    return M.limit_scripts(nodes).select("event_id", "placements")


@query("""WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) % 3 AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a, turn % 4 AS al FROM conversations)
SELECT conv_id, turn, list_filter([CASE WHEN n > 1 THEN 'multiple_omath_same_paragraph' END, CASE WHEN b IS NOT NULL THEN 'meaningful_content_before_formula' END, CASE WHEN a IS NOT NULL THEN 'meaningful_content_after_formula' END], lambda x: x IS NOT NULL) AS reasons,
  n > 1 OR (b IS NOT NULL AND al <> 1) AS strong FROM c""")
def inline_context(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    rows = t.conversations.select("conv_id", "turn", (F.count("*").over(w) % 3).alias("n"), F.lag("role").over(w.orderBy("turn")).alias("b"), F.lead("role").over(w.orderBy("turn")).alias("a"), (F.col("turn") % 4).alias("al"))
    return rows.select("conv_id", "turn", M.inline_context(F.col("n"), F.col("b"), F.col("a"), F.col("al")).alias("c")).select("conv_id", "turn", "c.reasons", "c.strong")


@query("""SELECT l_orderkey, l_linenumber, (l_tax * 40 < 2.0 AND l_quantity * 6 > 245) OR (l_tax * 40 < 3.0 AND l_quantity * 6 > 90 AND l_quantity * 6 < 235) OR l_discount / 100 < 0.0005 AS suspicious, l_quantity > 4 AND l_quantity <= 2000 AND l_extendedprice / 50 > 8 AND l_extendedprice / 50 <= 1000 AS donor FROM lineitem""")
def preview_flags(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", M.suspicious_preview(F.col("l_quantity") * 6, F.col("l_tax") * 40, F.col("l_discount") / 100).alias("suspicious"), M.plausible_donor(F.col("l_quantity"), F.col("l_extendedprice") / 50).alias("donor"))


_TEX = "CASE turn % 6 WHEN 0 THEN '\\left |' || text || '\\right|' WHEN 1 THEN '|' || text || '|' WHEN 2 THEN '\\bigg|' || text WHEN 3 THEN '\\{' || text || '\\}' WHEN 4 THEN '\\vert ' || text || '\\vert' ELSE '\\langle(' || text || '\\lfloor' END"


@query(f"""WITH d AS (SELECT conv_id, turn, {_TEX} AS x FROM conversations), c AS (SELECT *, len(replace(x, '\\|', '')) - len(replace(replace(x, '\\|', ''), '|', '')) >= 2 OR len(regexp_extract_all(x, '\\\\vert(?:[^A-Za-z]|$)')) >= 2 AS bars FROM d)
SELECT conv_id, turn, bars OR regexp_matches(x, '\\\\(lvert|left|bigl|Bigl|biggl|Biggl)\\s*\\|') AS bar_begin, bars OR regexp_matches(x, '\\\\(rvert|right|bigr|Bigr|biggr|Biggr)\\s*\\|') AS bar_end, contains(x, '\\{{') AS brace, contains(x, '(') AS paren,
  contains(x, '⟨') OR contains(x, '\\langle') AS angle, contains(x, '⌊') OR contains(x, '\\lfloor') AS floor FROM c""")
def delimiter_presence(t: Tables):
    """Every turn within one of six pairs of delimiters."""
    n, text = F.col("turn") % 6, F.col("text")
    forms = (("\\left |", "\\right|"), ("|", "|"), ("\\bigg|", ""), ("\\{", "\\}"), ("\\vert ", "\\vert"), ("\\langle(", "\\lfloor"))
    tex = reduce(lambda w, k: w.when(n == k, F.concat(F.lit(forms[k][0]), text, F.lit(forms[k][1]))), range(1, 6), F.when(n == 0, F.concat(F.lit(forms[0][0]), text, F.lit(forms[0][1]))))
    signs = (("|", "begin", "bar_begin"), ("|", "end", "bar_end"), ("{", "begin", "brace"), ("(", "begin", "paren"), ("⟨", "begin", "angle"), ("⌊", "begin", "floor"))
    return t.conversations.withColumn("tex", tex).select("conv_id", "turn", *(M.delimiter_present(F.col("tex"), s, side).alias(name) for s, side, name in signs))


@query("""WITH t AS (SELECT l_suppkey AS k, bool_and(l_quantity <= 45) AS single FROM lineitem GROUP BY 1)
SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 AND s_nationkey % 3 = 0 AND coalesce(single, true) THEN 'source_final_map' WHEN s_acctbal > 0 THEN 'visual_only_due_validated_formula_map' ELSE 'unavailable' END AS mode FROM supplier LEFT JOIN t ON k = s_suppkey""")
def mapping_modes(t: Tables):
    targets = t.lineitem.select(F.col("l_suppkey").alias("k"), F.when(F.col("l_quantity") > 45, F.array("l_linenumber", "l_partkey")).otherwise(F.array("l_linenumber")).alias("final_ordinals"))
    headers = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") > 0).alias("mapping_pass"), (F.col("s_nationkey") % 3).alias("added"))
    return M.mapping_mode(targets, headers, "k")


@query("""SELECT event_id, CASE WHEN s IN (401, 403) OR c = 'A0202' THEN 'authentication' WHEN NOT s BETWEEN 200 AND 399 THEN 'http' WHEN c IS NULL OR c <> '0' THEN 'business' END AS error
FROM (SELECT event_id, [200, 401, 500, 200, 302][event_id % 5 + 1] AS s, CASE event_type WHEN 'click' THEN '0' WHEN 'view' THEN 'A0202' WHEN 'error' THEN NULL ELSE '7' END AS c FROM events)""")
def service_errors(t: Tables):
    status = F.element_at(F.array(*(F.lit(x) for x in (200, 401, 500, 200, 302))), (F.col("event_id") % 5 + 1).cast("int"))
    code = F.when(F.col("event_type") == "click", "0").when(F.col("event_type") == "view", "A0202").when(F.col("event_type") == "error", None).otherwise("7")
    return t.events.select("event_id", M.service_error(status, code).alias("error"))


@query("""WITH s AS (SELECT s_suppkey % 10 AS doc_id, s_suppkey AS style_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS num_id, CASE WHEN s_suppkey % 4 = 1 THEN CAST(s_nationkey % 10 AS VARCHAR) END AS outline, s_acctbal < 0 AS heading FROM supplier),
p AS (SELECT l_suppkey % 10 AS doc_id, l_orderkey * 10 + l_linenumber AS p, l_suppkey AS style_id, CASE WHEN l_quantity < 3 THEN '0' END AS num_id, CASE WHEN l_quantity > 48 THEN '9' END AS outline, CASE WHEN l_tax > 0.07 THEN ' seq Figure ' WHEN l_tax > 0.06 THEN 'REF x' END AS instr FROM lineitem),
j AS (SELECT doc_id, p, coalesce(coalesce(p.num_id, s.num_id) <> '0', false) AS automatic, coalesce(regexp_matches(upper(instr), '\\b(SEQ|LISTNUM|AUTONUM|AUTONUMLGL|AUTONUMOUT)\\b'), false) AS field,
  coalesce(coalesce(p.outline, s.outline) <> '9', coalesce(heading, false)) AS outline, coalesce(heading, false) AS heading FROM p LEFT JOIN s USING (doc_id, style_id))
SELECT * FROM j WHERE automatic OR field OR outline OR heading""")
def numbering_candidates(t: Tables):
    """Lines as paragraphs, suppliers as their styles, ten documents."""
    k = F.col("s_suppkey")
    styles = t.supplier.select((k % 10).alias("doc_id"), k.alias("style_id"), F.when(k % 3 == 0, F.col("s_nationkey").cast("string")).alias("num_id"), F.when(k % 4 == 1, (F.col("s_nationkey") % 10).cast("string")).alias("outline"), (F.col("s_acctbal") < 0).alias("heading"))
    quantity, tax = F.col("l_quantity"), F.col("l_tax")
    paragraphs = t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"), F.col("l_suppkey").alias("style_id"),
        F.when(quantity < 3, "0").alias("num_id"), F.when(quantity > 48, "9").alias("outline"), F.when(tax > 0.07, " seq Figure ").when(tax > 0.06, "REF x").alias("instr"),
    )
    return M.numbering_candidates(paragraphs, styles)


@query("""SELECT CAST(event_id AS VARCHAR) AS name, """ + ", ".join(f"NULL::VARCHAR AS {f}" for f in M.STATUS_FIELDS if f not in ("status", "acceptance_pass")) + """, event_type AS status, CASE WHEN event_id % 2 = 0 THEN 'false' END AS acceptance_pass FROM events""")
def status_fields(t: Tables):
    """Fields that a report lacks stay unknown."""
    value = F.to_json(F.struct(F.col("event_type").alias("status"), F.when(F.col("event_id") % 2 == 0, False).alias("acceptance_pass"), F.lit(1).alias("other")))
    return M.status_view(t.events.select(F.col("event_id").cast("string").alias("name"), value.alias("value")))
