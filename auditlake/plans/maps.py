"""Repair maps of documents made from conversations: a turn is a formula, or one visual line of its conversation's formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators import diagnosis
from auditlake.operators import repair_maps as R
from auditlake.plans.registry import Tables, dealt, query

_X = "trim(regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g'))"


def _plain() -> Column:
    return F.trim(F.regexp_replace("text", "[^A-Za-z0-9 .,]", ""))


def _formulas(t: Tables) -> DataFrame:
    """Every turn as a formula of its conversation: one in five has a limit, one in ten a limit and a prime, a few break a rule."""
    turn, x = F.col("turn"), _plain()
    tex = (
        F.when(turn % 10 == 0, F.concat(F.lit("$\\lim_{n} f'' "), x, F.lit("$"))).when(turn % 5 == 0, F.concat(F.lit("\\lim_{n} "), x))
        .when(turn % 50 == 11, F.concat(x, F.lit("''''"))).when(turn % 50 == 12, F.lit(" ")).otherwise(x)
    )
    ordinal = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return t.conversations.select(F.col("conv_id").alias("doc"), ordinal.alias("ordinal"), "turn", tex.alias("tex"))


_FORMULAS = f"""t AS (SELECT conv_id AS doc, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, {_X} AS x FROM conversations),
f AS (SELECT *, CASE WHEN turn % 10 = 0 THEN '\\underset{{n}}{{\\lim}} f'''' ' || x WHEN turn % 5 = 0 THEN '\\underset{{n}}{{\\lim}} ' || x WHEN turn % 50 = 11 THEN x || '''''''''' WHEN turn % 50 = 12 THEN '' ELSE x END AS safe FROM t)"""


@query(f"""WITH {_FORMULAS}, h AS (SELECT doc, count(*) AS n FROM t GROUP BY doc),
a AS (SELECT doc, CASE WHEN doc % 13 = 5 THEN 'source_has_objects' WHEN doc % 11 = 4 THEN 'native_formulas_left' WHEN doc % 7 = 3 THEN 'counts_differ' END AS about FROM h),
r AS (SELECT f.*, CASE WHEN turn % 5 <> 0 THEN 'no_scripted_limit' WHEN turn % 15 = 10 THEN 'limit_count_differs' WHEN turn % 20 = 10 THEN 'prime_orders_differ' WHEN turn % 40 = 20 THEN 'location_missing' END AS own FROM f WHERE turn % 5 = 0 OR (doc % 6 = 1 AND turn % 5 = 2)),
j AS (SELECT r.*, coalesce(about, own) AS refusal FROM r JOIN a USING (doc))
SELECT doc, ordinal, '$' || safe || '$' AS tex, CASE WHEN turn % 5 = 0 THEN 1 ELSE 0 END AS limits, CASE WHEN turn % 5 = 0 THEN [['below']] ELSE [] END AS placements, CASE WHEN turn % 10 = 0 THEN [2] ELSE [] END AS prime_orders,
  CASE WHEN turn % 40 <> 20 THEN turn + 1 END AS p, CASE WHEN turn % 40 <> 20 THEN 1 END AS local, refusal, bool_and(refusal IS NULL) OVER (PARTITION BY doc) AS planned FROM j""")
def limit_layout_map(t: Tables):
    """Formulas with limits to be rebuilt from the source, and why a document's cannot."""
    f, doc, turn = _formulas(t), F.col("doc"), F.col("turn")
    headers = f.groupBy("doc").agg(F.count("*").alias("source_native"))
    headers = headers.select("doc", "source_native", F.when(doc % 13 == 5, 1).otherwise(0).alias("source_objects"), F.when(doc % 11 == 4, 1).otherwise(0).alias("working_native"), (F.col("source_native") - F.when(doc % 7 == 3, 1).otherwise(0)).alias("working_objects"))
    requested = f.where("turn % 5 = 0 or (doc % 6 = 1 and turn % 5 = 2)")
    scripts = f.where("turn % 5 = 0").select("doc", "ordinal", F.when(turn % 15 == 10, 2).otherwise(1).alias("n"))
    primes = f.where("turn % 10 = 0").select("doc", "ordinal", F.array(F.when(turn % 20 == 10, 1).otherwise(2)).alias("orders"))
    places = f.where("turn % 40 <> 20").select("doc", "ordinal", (turn + 1).alias("p"), F.lit(1).alias("local"))
    return R.limit_layout(headers, f, requested, scripts, primes, places, "doc")


@query(f"""WITH {_FORMULAS}, g AS (SELECT doc, turn // 3 AS p, list(ordinal ORDER BY ordinal) AS ordinals, list('$' || safe || '$' ORDER BY ordinal) AS lines, bool_or(turn % 50 IN (11, 12) AND turn % 5 <> 0) AS bad FROM f GROUP BY ALL HAVING count(*) > 1),
j AS (SELECT *, CASE WHEN doc % 7 = 3 THEN 'not_the_known_collapse' WHEN bad THEN 'rejected_tex' END AS refusal FROM g)
SELECT doc, p, ordinals, lines, 1 AS expected_now, CAST(len(ordinals) AS INTEGER) AS expected_after, refusal, bool_and(refusal IS NULL) OVER (PARTITION BY doc) AS planned FROM j""")
def multisibling_map(t: Tables):
    """Three turns are a display group that became one object."""
    f, doc = _formulas(t), F.col("doc")
    groups = f.groupBy("doc", F.floor(F.col("turn") / 3).alias("p")).agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals")).where(F.size("ordinals") > 1)
    extra = groups.groupBy("doc").agg(F.sum(F.size("ordinals") - 1).alias("extra"))
    headers = f.groupBy("doc").agg(F.count("*").alias("source_native")).join(extra, "doc", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    headers = headers.select("doc", "source_native", "extra", F.lit(0).alias("working_native"), (F.col("source_native") - F.col("extra") - F.when(doc % 7 == 3, 1).otherwise(0)).alias("working_objects"))
    return R.multisibling(headers, groups, f, "doc")


def _exports(t: Tables) -> DataFrame:
    """A conversation is a formula, its turns are the lines of it; some exports failed, carry artifacts or have unproved primes."""
    turn, conv = F.col("turn"), F.col("conv_id")
    x = F.regexp_replace(_plain(), ", ", " = ")
    exported = F.when(turn % 6 == 1, F.concat(x, F.lit("▒"))).when(turn % 30 == 17, F.concat(x, F.lit("''''"))).otherwise(x)
    rows = t.conversations.where("conv_id % 9 <> 7 or turn = 0")
    return rows.select(F.floor(conv / 4).alias("doc"), (conv % 4 + 1).alias("ordinal"), (conv % 17 != 6).alias("success"), (turn + 1).alias("line"), exported.alias("exported"), F.concat(F.lit("v "), x).alias("fragment"))


_EXPORTS = f"""e AS (SELECT conv_id, conv_id // 4 AS doc, conv_id % 4 + 1 AS ordinal, turn + 1 AS line, turn, replace({_X}, ', ', ' = ') AS x FROM conversations WHERE conv_id % 9 <> 7 OR turn = 0),
l AS (SELECT *, CASE WHEN turn % 6 = 1 THEN 'v ' || x WHEN turn % 30 = 17 THEN trim(regexp_replace(x, ' +', ' ', 'g')) || '''''''''' ELSE trim(regexp_replace(x, ' +', ' ', 'g')) END AS safe, CASE WHEN turn % 6 = 1 THEN 'fragment' ELSE 'export' END AS provenance FROM e),
a AS (SELECT *, CASE WHEN contains(safe, '=') THEN left(safe, strpos(safe, '=') - 1) || '&' || safe[strpos(safe, '='):] ELSE '&' || safe END AS shown FROM l),
g AS (SELECT conv_id, doc, ordinal, conv_id % 17 <> 6 AS success, list(safe ORDER BY line) AS lines, list(provenance ORDER BY line) AS provenance, '$\\begin{{aligned}}' || string_agg(shown, ' \\\\ ' ORDER BY line) || '\\end{{aligned}}$' AS tex,
  CAST(count(*) AS INTEGER) AS n, bool_or(turn % 30 = 17 AND turn % 6 <> 1 OR safe = '') AS bad FROM a GROUP BY ALL)"""


@query(f"""WITH {_EXPORTS}, r AS (SELECT *, CASE WHEN doc % 5 = 4 THEN 'source_changed' WHEN doc % 7 = 2 THEN 'counts_not_exact' WHEN NOT success THEN 'export_failed' WHEN bad THEN 'rejected_tex' WHEN conv_id % 19 = 8 THEN 'location_missing' END AS refusal FROM g WHERE NOT success OR n > 1)
SELECT doc, ordinal, CASE WHEN success THEN tex END AS tex, n AS visual_lines, provenance, CASE WHEN conv_id % 19 <> 8 THEN ordinal * 3 END AS p, CASE WHEN conv_id % 19 <> 8 THEN 1 END AS local, refusal, bool_and(refusal IS NULL) OVER (PARTITION BY doc) AS planned FROM r""")
def visual_wrap_map(t: Tables):
    """Formulas shown on several lines become one, aligned at the first equals sign of each line."""
    doc = F.col("doc")
    each = t.conversations.select(F.floor(F.col("conv_id") / 4).alias("doc"), "conv_id").distinct()
    headers = each.groupBy("doc").agg(F.count("*").alias("source_native"))
    headers = headers.select("doc", "source_native", (doc % 5 != 4).alias("unchanged"), F.lit(0).alias("extra"), F.lit(0).alias("working_native"), (F.col("source_native") - F.when(doc % 7 == 2, 1).otherwise(0)).alias("working_objects"))
    ordinal = F.col("conv_id") % 4 + 1
    places = each.where("conv_id % 19 <> 8").select("doc", ordinal.alias("ordinal"), (ordinal * 3).alias("p"), F.lit(1).alias("local"))
    return R.visual_wrap(headers, _exports(t), places, "doc")


_SPLITS = f"""{_EXPORTS}, b AS (SELECT doc, CASE doc % 23 WHEN 1 THEN 'source_changed' WHEN 3 THEN 'plan_schema' WHEN 5 THEN 'stale_working' WHEN 7 THEN 'source_mismatch' WHEN 9 THEN 'paragraph_count' WHEN 11 THEN 'object_count' WHEN 13 THEN 'native_formulas_left' END AS about FROM (SELECT DISTINCT doc FROM e)),
r AS (SELECT g.*, coalesce(about, CASE WHEN NOT success THEN 'export_missing' WHEN n < 2 THEN 'fewer_than_two_lines' WHEN bad THEN 'rejected_tex' WHEN conv_id % 10 = 9 THEN 'not_one_object' END) AS refusal FROM g JOIN b USING (doc)),
s AS (SELECT doc, ordinal, ordinal * 3 AS source_p, ordinal * 3 + 1 AS working_p, list_transform(lines, lambda y: '$' || y || '$') AS lines, 1 AS expected_now, n AS expected_after, n - 1 AS expected_breaks, refusal, bool_and(refusal IS NULL) OVER (PARTITION BY doc) AS planned FROM r)"""


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    doc = F.col("doc")
    each = t.conversations.select(F.floor(F.col("conv_id") / 4).alias("doc"), "conv_id", (F.col("conv_id") % 4 + 1).alias("ordinal")).distinct()
    plan = each.select("doc", "ordinal", (F.col("ordinal") * 3).alias("source_p"), (F.col("ordinal") * 3 + 1).alias("working_p"))
    objects = each.select("doc", (F.col("ordinal") * 3 + 1).alias("p"), F.when(F.col("conv_id") % 10 == 9, 2).otherwise(1).alias("n"))
    odd = lambda k, a, b: F.when(doc % 23 == k, a).otherwise(b)
    headers = each.groupBy("doc").agg(F.count("*").alias("working_objects"))
    headers = headers.select(
        "doc", "working_objects", odd(1, False, True).alias("unchanged"), odd(3, "other/v1", f"x-{R.PLAN_SCHEMA}").alias("plan_schema"), F.lit("AB").alias("plan_working"), odd(5, "ac", "ab").alias("now_working"),
        F.lit("cd").alias("plan_source"), odd(7, "ce", "CD").alias("report_source"), F.lit(50).alias("plan_paragraphs"), odd(9, 51, 50).alias("now_paragraphs"), (F.col("working_objects") + odd(11, 1, 0)).alias("plan_objects"), odd(13, 1, 0).alias("working_native"),
    )
    return R.visual_line_split(headers, plan, _exports(t), objects, "doc"), headers


@query(f"WITH {_SPLITS} SELECT * FROM s")
def visual_line_split_map(t: Tables):
    """Every visual line an object of its own, where plan, report and document are bound to each other."""
    return _split(t)[0]


@query(f"""WITH {_SPLITS}, c AS (SELECT conv_id // 4 AS doc, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1)
SELECT doc, count(*) AS targets, CAST(sum(expected_after - 1) AS BIGINT) AS increase, CAST(n + sum(expected_after - 1) AS BIGINT) AS expected_objects, min(working_p) AS first_repair FROM s JOIN c USING (doc) WHERE planned GROUP BY doc, n""")
def visual_line_split_totals(t: Tables):
    rows, headers = _split(t)
    return R.map_totals(rows, headers, "doc")


@query(f"""WITH {_FORMULAS} SELECT doc, ordinal, CASE WHEN turn % 5 = 0 THEN 1 ELSE 0 END AS limits, CASE WHEN turn % 5 = 0 THEN [['below']] ELSE [] END AS placements, CASE WHEN turn % 10 = 0 THEN [2] WHEN turn % 50 = 11 THEN [3] ELSE [] END AS prime_orders,
  CASE WHEN turn % 5 = 0 THEN [{{'name': 'subscripts', 'n': 1}}] ELSE [] END AS structure FROM f WHERE turn % 5 = 0 OR turn % 50 = 11""")
def contract_targets(t: Tables):
    """What each formula of a conversation asks of its converted form."""
    return diagnosis.contract_targets(dealt(_formulas(t)), "doc")


_WHY = ("audit_missing", "audit_schema", "audit_not_complete", "audit_of_another_file", "audit_stale", "audit_failed", "audit_incomplete")


@query(f"""WITH n AS (SELECT conv_id AS doc, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1), k AS (SELECT *, doc % 4 AS kind, doc // 4 % 10 AS why FROM n),
r AS (SELECT *, CASE WHEN kind = 3 AND u > 0 AND u < n THEN 'mixed_baseline' WHEN kind IN (1, 2) AND why < 7 THEN (['{"', '".join(_WHY)}'])[why + 1] END AS refused FROM k)
SELECT doc, CASE WHEN refused IS NOT NULL THEN NULL WHEN kind = 0 THEN 'native' WHEN kind = 3 AND u = n THEN 'native' ELSE 'converted' END AS baseline, refused, CASE WHEN refused IS NULL THEN n END AS formula_count FROM r WHERE NOT (kind = 3 AND u = 0) UNION ALL SELECT doc, NULL, 'audit_missing', NULL FROM r WHERE kind = 3 AND u = 0""")
def bound_contracts(t: Tables):
    """Sources of native, of converted and of both kinds of formulas; converted ones with exports that break one rule each."""
    doc, kind, why = F.col("conv_id"), F.col("conv_id") % 4, F.floor(F.col("conv_id") / 4) % 10
    mixed = kind == 3
    counts = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"))
    native = F.when(kind == 0, F.col("n")).when(mixed, F.col("u")).otherwise(0)
    headers = counts.select(doc.alias("doc"), native.alias("native"), (F.col("n") - native).alias("converted"), F.lit("p").alias("path"), F.sha2(doc.cast("string"), 256).alias("sha256"))
    odd = lambda n, a, b: F.when(why == n, a).otherwise(b)
    digest = F.upper(F.sha2(doc.cast("string"), 256))
    audits = counts.where(kind.isin(1, 2) & (why != 0)).select(
        doc.alias("doc"), odd(1, "x", "x-internal-tex-diagnostic/v1").alias("schema"), F.lit("full").alias("scope"), odd(2, None, True).alias("read_only"), odd(3, "q", "p").alias("path"), digest.alias("sha_before"), odd(4, "0", digest).alias("sha_after"),
        F.lit(True).alias("success"), odd(5, 1, 0).alias("failed"),
    )
    # where one is missing, the first turn has no export
    exports = t.conversations.where((why != 6) | (F.col("turn") > 0)).select(doc.alias("doc"), (F.col("turn") + 1).alias("ordinal"))
    return diagnosis.bound_contract(headers, audits, exports, "doc")


_TERMS = (*diagnosis.RUN_FLAGS, *diagnosis.RUN_ZEROS)


@query(f"""WITH r AS (SELECT o_orderkey AS run_id, o_custkey % 34 AS a, CAST(floor(o_totalprice) AS BIGINT) % 51 AS b FROM orders) SELECT run_id, a > 16 AND b > 16 AS accepted, (['{"', '".join(_TERMS)}'])[nullif(least(CASE WHEN a > 16 THEN 99 ELSE a END, CASE WHEN b > 16 THEN 99 ELSE b END), 99) + 1] AS first_missing FROM r""")
def accepted_runs(t: Tables):
    """Orders as runs: of each up to two of the seventeen terms fail, one is false or counted, one is unknown."""
    a, b = F.col("o_custkey") % 34, F.floor("o_totalprice") % 51

    def term(n: int, name: str):
        good, bad = (F.lit(True), F.lit(False)) if name in diagnosis.RUN_FLAGS else (F.lit(0), F.lit(1))
        return F.when(b == n, None).when(a == n, bad).otherwise(good).alias(name)

    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), *(term(n, name) for n, name in enumerate(_TERMS)))
    return diagnosis.run_accepted(runs, "run_id")
