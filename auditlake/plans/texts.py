"""Text rules over whole tables; where these hold no formulas or labels, their texts are turned into such by letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import tex
from auditlake.functions import text as X
from auditlake.operators.numbering import offsets
from auditlake.plans.registry import Tables, dealt, query

_FROM, _TO = "aeioumnw,;", "′″‴²'_^{}⁺"
_TEX_SQL = f"SELECT conv_id, turn, '\\lim_{{x\\to0}} ' || translate(text, '{_FROM}', '{_TO.replace(chr(39), chr(39) * 2)}') || '\\smallint x' AS tex FROM conversations"
_LABELS_SQL = "SELECT conv_id, turn, '（' || turn || '）、' || replace(text, '. ', chr(10) || '3、') AS label FROM conversations"


def _formulas(t: Tables):
    """Every turn as a formula: some of its letters become primes, scripts and braces."""
    return dealt(t.conversations).select("conv_id", "turn", F.concat(F.lit("\\lim_{x\\to0} "), F.translate("text", _FROM, _TO), F.lit("\\smallint x")).alias("tex"))


def _labels(t: Tables):
    """Every turn as labelled lines."""
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("（"), F.col("turn"), F.lit("）、"), F.replace("text", F.lit(". "), F.lit("\n3、"))).alias("label"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h1')) AS headings, len(regexp_extract_all(html, '<li')) AS items, len(regexp_extract_all(html, '<h1')) > 0 OR len(regexp_extract_all(html, '<li')) > 8 AS candidate FROM pages")
def html_outline_candidates(t: Tables):
    count = lambda tag: F.regexp_count("html", F.lit(tag)).cast("long")
    return t.pages.select("page_id", count("<h1").alias("headings"), count("<li").alias("items"), ((count("<h1") > 0) | (count("<li") > 8)).alias("candidate"))


_TAGS = ("p", "div", "li", "a", "h1", "h2", "script")


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{g}[ >]')) AS n_{g}" for g in _TAGS) + " FROM pages")
def tag_structure_signature(t: Tables):
    return t.pages.select("page_id", *(F.regexp_count("html", F.lit(f"<{g}[ >]")).cast("long").alias(f"n_{g}") for g in _TAGS))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^()]', '', 'g'), '')) AS c, unnest(range(1, len(regexp_replace(text, '[^()]', '', 'g')) + 1)) AS n FROM documents),
d AS (SELECT doc_id, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY n) AS d, n FROM c WHERE c <> ''),
g AS (SELECT doc_id, min(d) AS least, arg_max(d, n) AS last FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(least >= 0 AND last = 0, true) AS balanced FROM documents LEFT JOIN g USING (doc_id)""")
def bracket_balance(t: Tables):
    return t.documents.select("doc_id", X.brace_balanced(F.translate(F.regexp_replace("text", r"[{}]", ""), "()", "{}")).alias("balanced"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS other, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS control FROM documents""")
def char_class_counts(t: Tables):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return t.documents.select("doc_id", n("[A-Z]").alias("upper"), n("[0-9]").alias("digits"), n(r"[^\x00-\x7F]").alias("other"), X.has_control(F.col("text")).alias("control"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[=<>+%&|$#@]'))) AS symbols FROM documents")
def distinct_symbols(t: Tables):
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([=<>+%&|$#@])"), F.lit(1)))).alias("symbols"))


@query("SELECT doc_id, substr(text, greatest(x - 48, 1), x + 48 - greatest(x - 48, 1) + 1) AS context FROM (SELECT doc_id, text, strpos(text, '. ') AS x FROM documents) WHERE x > 0")
def text_context_window(t: Tables):
    rows = t.documents.withColumn("at", F.instr("text", ". ")).where("at > 0")
    return rows.select("doc_id", X.context_window(F.col("text"), F.col("at")).alias("context"))


@query("""SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(regexp_extract(x, '(?i)(?:^|;)\\s*width\\s*:\\s*(-?[0-9.]+)pt', 1), '') AS DOUBLE) AS width, TRY_CAST(nullif(regexp_extract(x, '(?i)(?:^|;)\\s*height\\s*:\\s*(-?[0-9.]+)pt', 1), '') AS DOUBLE) AS height
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'width:' || CAST(l_quantity AS BIGINT) || '.5pt;height:8pt' WHEN 1 THEN 'HEIGHT: -3pt ; Width :' || CAST(l_quantity AS BIGINT) || 'pt' ELSE 'xwidth:9pt;width:7px' END AS x FROM lineitem)""")
def style_dimension_extract(t: Tables):
    n, whole = F.col("l_linenumber") % 3, F.col("l_quantity").cast("long").cast("string")
    style = F.when(n == 0, F.concat(F.lit("width:"), whole, F.lit(".5pt;height:8pt"))).when(n == 1, F.concat(F.lit("HEIGHT: -3pt ; Width :"), whole, F.lit("pt"))).otherwise("xwidth:9pt;width:7px")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.style_points(style, "width").alias("width"), X.style_points(style, "height").alias("height"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_type(props) = 'ARRAY' THEN 'array' ELSE 'object' END AS shape FROM events")
def json_props_extract(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.startswith(F.ltrim(F.col("props")), F.lit("[")), "array").otherwise("object").alias("shape"))


@query("""SELECT doc_id, replace(replace(text, '. ', '。'), '。', CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '。' END) AS body, CAST(CASE WHEN doc_id % 2 = 0 THEN len(text) - len(replace(text, '. ', '。')) ELSE 0 END AS BIGINT) AS replaced FROM documents""")
def body_period_replace(t: Tables):
    text = F.replace("text", F.lit(". "), F.lit("。"))
    eligible = F.col("doc_id") % 2 == 0
    return t.documents.select("doc_id", X.replace_period(text, eligible).alias("body"), F.when(eligible, X.occurrences(text, "。")).otherwise(0).cast("long").alias("replaced"))


@query(f"""SELECT conv_id, turn, regexp_replace(label, '(^|\\n)([ \\t　]*(?:[0-9０-９]+|[（(][0-9０-９]+[)）]))、', '\\1\\2.', 'g') AS line_start, label AS preserved FROM ({_LABELS_SQL})""")
def numbering_normalize(t: Tables):
    return _labels(t).select("conv_id", "turn", X.normalize_labels(F.col("label")).alias("line_start"), X.normalize_labels(F.col("label"), "preserve").alias("preserved"))


@query()
def numbering_anywhere(t: Tables):
    return _labels(t).select("conv_id", "turn", X.normalize_labels(F.col("label"), "anywhere").alias("anywhere"))


@query(f"""SELECT conv_id, turn, regexp_matches(tex, '[''′″‴⁗ʹʺ’‘]|\\\\prime([^A-Za-z0-9_]|$)') AS has_prime, trim(tex) = '' AS blank, regexp_matches(tex, '[\\r\\n\\t]') AS line_control FROM ({_TEX_SQL})""")
def prime_markers(t: Tables):
    value = F.col("tex")
    return _formulas(t).select("conv_id", "turn", X.has_prime(value).alias("has_prime"), X.blank(value).alias("blank"), value.rlike(r"[\r\n\t]").alias("line_control"))


@query("""SELECT p_partkey, CASE WHEN lower(trim(x)) = 'equation.axmath' THEN 'axmath' WHEN regexp_matches(lower(trim(x)), '^equation\\.(3|dsmt)') THEN 'legacy_equation' ELSE 'unclassified' END AS kind
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Equation.AxMath' WHEN 1 THEN ' equation.axmath ' WHEN 2 THEN ' Equation.3 ' WHEN 3 THEN 'Equation.DSMT' || p_size ELSE p_name END AS x FROM part)""")
def object_kinds(t: Tables):
    n = F.col("p_size") % 5
    progid = F.when(n == 0, "Equation.AxMath").when(n == 1, " equation.axmath ").when(n == 2, " Equation.3 ").when(n == 3, F.concat(F.lit("Equation.DSMT"), F.col("p_size"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.object_kind(progid).alias("kind"))


@query("""SELECT o_orderkey, regexp_full_match(x, '(?i)(heading|标题)\\s*[1-9](\\s*char)?') AS heading
FROM (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'Heading ' || o_orderkey % 12 WHEN 1 THEN '标题' || o_orderkey % 12 || ' Char' WHEN 2 THEN 'My Heading ' || o_orderkey % 12 ELSE o_orderpriority END AS x FROM orders)""")
def heading_identity(t: Tables):
    n, level = F.col("o_custkey") % 4, F.col("o_orderkey") % 12
    name = F.when(n == 0, F.concat(F.lit("Heading "), level)).when(n == 1, F.concat(F.lit("标题"), level, F.lit(" Char"))).when(n == 2, F.concat(F.lit("My Heading "), level)).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", X.is_heading(name).alias("heading"))


@query("""SELECT user_id, list_sort(list_distinct([CAST(x AS INTEGER) FOR x IN string_split(o, ',') IF trim(x) <> ''])) AS ordinals FROM (SELECT user_id, string_agg(CAST(event_id % 40 AS VARCHAR), ',') || ', ,' AS o FROM events GROUP BY user_id)""")
def ordinal_list_parsing(t: Tables):
    listed = t.events.groupBy("user_id").agg(F.concat(F.array_join(F.collect_list((F.col("event_id") % 40).cast("string")), ","), F.lit(", ,")).alias("o"))
    return listed.select("user_id", X.ordinals(F.col("o")).alias("ordinals"))


@query()
def tex_rules(t: Tables):
    """Issue codes, prime orders and reasons, by expressions alone."""
    v = F.col("tex")
    return _formulas(t).select(
        "conv_id", "turn", X.prime_issues(v).alias("prime_issues"), X.prime_orders(v).alias("prime_orders"), X.source_prime_orders(v).alias("source_orders"), X.small_integral_issues(v).alias("integral_issues"), X.latex_reasons(v).alias("reasons"),
        X.superscripts(X.prime_tokens(v)).alias("tokens"), X.align_at_equals(v).alias("aligned"),
    )


@query()
def tex_normalize(t: Tables):
    v = F.col("tex")
    return _formulas(t).select("conv_id", "turn", tex.normalize_udf(v).alias("normalized"), tex.limit_issues_udf(v).alias("limit_issues"), tex.limit_placements_udf(v).alias("placements"), tex.exported_udf(v).alias("exported"))


@query()
def semantic_tokens(t: Tables):
    return _formulas(t).select("conv_id", "turn", tex.tokens_udf("tex").alias("tokens"), tex.structure_udf("tex").alias("structure"))


@query()
def nfkc_anchor(t: Tables):
    return t.documents.select("doc_id", tex.anchor_udf("text").alias("anchor"))


@query()
def cjk_similarity(t: Tables):
    """Each turn, its letters as ideographs, against the next one of its conversation."""
    rows = t.conversations.select("conv_id", "turn", F.translate("text", "etaoin", "一二三四五六").alias("a"))
    other = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return rows.join(other, ["conv_id", "turn"]).select("conv_id", "turn", tex.cjk_ratio_udf("a", "b").alias("ratio"))


@query()
def plain_math_class(t: Tables):
    """Every word of every turn as a run of its paragraph, where it stands; every third paragraph begins with a label."""
    paragraph = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("3、"), "text")).otherwise(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", paragraph.alias("paragraph"))
    words = rows.select("conv_id", "turn", "paragraph", F.posexplode(F.split("paragraph", " ")).alias("k", "run"))
    placed = offsets(words.withColumn("spaced", F.concat("run", F.lit(" "))), ["conv_id", "turn"], ["k"], "spaced").where("run <> ''")
    vertical = F.when(F.col("k") % 5 == 4, "superscript")
    return placed.select("conv_id", "turn", "k", tex.plain_math_udf("run", "paragraph", F.col("run_start").cast("int"), vertical).alias("c")).select("conv_id", "turn", "k", "c.is_math", "c.kind")


@query()
def canonical_xml(t: Tables):
    """Every page, and one element made of its address, as XML; most pages are none."""
    element = F.concat(F.lit("<a z='1' b='"), F.regexp_replace("url", "[<&']", ""), F.lit("'><c/></a>"))
    return t.pages.select("page_id", tex.canonical_xml_udf("html").alias("page"), tex.canonical_xml_udf(element).alias("element"))


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 2 = 0 THEN [k, k] ELSE [k] END AS keys, CASE WHEN event_id % 3 = 0 THEN '{"event_id":' || event_id || '}' WHEN k IS NULL THEN '{"event_id":' || event_id || '}' ELSE '{"event_id":' || event_id || ',"k":' || k || '}' END AS known,
  format('SRC-{:04d}', event_id) AS source_name, format('omath-{:04d}', event_id) AS formula_name FROM e""")
def evidence_projection(t: Tables):
    """Properties as one object or a list of two, read as lists; what is known of each event; names by number."""
    props = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ["), "props", F.lit(","), "props", F.lit("]"))).otherwise(F.col("props"))
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select("event_id", F.transform(X.as_list(props, "k:bigint"), lambda x: x["k"]).alias("keys"), F.when(F.col("event_id") % 3 != 0, k).alias("k"))
    return rows.select("event_id", "keys", X.known_fields("event_id", "k").alias("known"), X.identifier("source", F.col("event_id")).alias("source_name"), X.identifier("formula", F.col("event_id")).alias("formula_name"))
