"""Acceptance over conversations as documents: every gate is computed from the turns of two versions, not from flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators import acceptance as A
from auditlake.operators import checks, compare, diagnosis
from auditlake.operators import formulas as M
from auditlake.operators.rules import count_state
from auditlake.plans.registry import Tables, query

_X = "trim(regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g'))"


def _plain() -> Column:
    return F.trim(F.regexp_replace("text", "[^A-Za-z0-9 .,]", ""))


def _texts(t: Tables, version: str) -> DataFrame:
    """Paragraphs: one turn in four begins with a list label, which the final version normalises; some lose, join or change text."""
    doc, turn = F.col("conv_id"), F.col("turn")
    label = F.when(turn % 4 == 1, F.concat((turn + 1).cast("string"), F.lit("、" if version == "source" else "."))).otherwise("")
    plain = F.concat(label, _plain())
    if version == "final":
        first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
        changed = F.concat(plain, F.when((doc % 7 == 2) & first, " more").otherwise(""))
        # the first two characters of the second turn move to the first one's end
        head = F.left(F.lead(plain).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(2))
        plain = F.when((doc % 11 == 3) & first, F.concat(changed, F.coalesce(head, F.lit("")))).when((doc % 11 == 3) & (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 2), F.substring(plain, 3, 1 << 30)).otherwise(changed)
    rows = t.conversations.select(doc.alias("doc"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("p"), plain.alias("plain"))
    return rows.withColumn("contract", F.col("plain"))


_VERSIONS = f"""r AS (SELECT conv_id AS doc, turn, {_X} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
s AS (SELECT doc, p, turn, CASE WHEN turn % 4 = 1 THEN (turn + 1) || '、' ELSE '' END || x AS plain, CASE WHEN turn % 4 = 1 THEN (turn + 1) || '.' ELSE '' END || x AS label FROM r),
l AS (SELECT *, lead(label) OVER (PARTITION BY doc ORDER BY p) AS next FROM s),
c AS (SELECT doc, p, CASE WHEN doc % 11 = 3 AND p = 2 THEN label[3:] ELSE label || CASE WHEN doc % 7 = 2 AND p = 1 THEN ' more' ELSE '' END || CASE WHEN doc % 11 = 3 AND p = 1 THEN coalesce(left(next, 2), '') ELSE '' END END AS plain FROM l)"""


@query(f"""WITH {_VERSIONS}, g AS (SELECT s.doc, count(*) AS source_paragraphs, count(*) AS candidate_paragraphs, count(*) FILTER (s.plain <> c.plain) AS differences, count(*) FILTER (s.label <> c.plain) AS normal, string_agg(s.plain, '' ORDER BY s.p) AS sp, string_agg(c.plain, '' ORDER BY s.p) AS cp, string_agg(s.label, '' ORDER BY s.p) AS sl,
  count(*) FILTER (s.turn % 4 = 1) AS expected_changes FROM s JOIN c USING (doc, p) GROUP BY s.doc)
SELECT doc, source_paragraphs, candidate_paragraphs, differences, differences = 0 AS exact, sp = cp AS flat_exact, normal = 0 AS normalised_exact, sl = cp AS normalised_flat_exact, differences = 0 OR normal = 0 AS contract_exact, expected_changes FROM g""")
def content_flags(t: Tables):
    """Exact, as one text, and with the labels of the source normalised; some documents move text between paragraphs."""
    return A.content_flags(_texts(t, "source"), _texts(t, "final"), "doc", "line-start")


_TEX = "[x || ' = a + b', '\\frac{1}{2} ' || x, x || ' < c = d', x][turn % 4 + 1]"
_DONE = "CASE WHEN conv_id % 5 = 3 AND turn % 4 = 0 THEN x || ' = a' WHEN conv_id % 5 = 3 AND turn % 4 = 3 THEN x || ' = e' ELSE " + _TEX + " END"


def _formulas(t: Tables, done: bool) -> DataFrame:
    """A turn is a formula; in one document of five the converted one lacks a sum or has an equation of its own."""
    x, turn, doc = _plain(), F.col("turn"), F.col("conv_id")
    tex = F.when(turn % 4 == 0, F.concat(x, F.lit(" = a + b"))).when(turn % 4 == 1, F.concat(F.lit("\\frac{1}{2} "), x)).when(turn % 4 == 2, F.concat(x, F.lit(" < c = d"))).otherwise(x)
    if done:
        tex = F.when((doc % 5 == 3) & (turn % 4 == 0), F.concat(x, F.lit(" = a"))).when((doc % 5 == 3) & (turn % 4 == 3), F.concat(x, F.lit(" = e"))).otherwise(tex)
    return t.conversations.select(doc.alias("doc"), turn.alias("ordinal"), tex.alias("tex"))


@query("""WITH r AS (SELECT conv_id AS doc, turn AS ordinal FROM conversations WHERE conv_id % 5 = 3)
SELECT doc, ordinal, 'exact' AS mode, 'relations_plus_count_mismatch' AS reason, 1 AS expected, 0 AS actual FROM r WHERE ordinal % 4 = 0 UNION ALL SELECT doc, ordinal, 'exact', 'relations_eq_count_mismatch', 0, 1 FROM r WHERE ordinal % 4 = 3
UNION ALL SELECT doc, ordinal, 'at_least', 'relations_plus_missing', 1, 0 FROM r WHERE ordinal % 4 = 0""")
def formula_structure_differences(t: Tables):
    """Relations, operators and structure of every formula against its converted one; what is new counts in exact mode only."""
    key = ["doc", "ordinal"]
    want, got = (A.structure_counts(_formulas(t, done), key, "tex") for done in (False, True))
    modes = [A.structure_differences(want, got, key, exact).withColumn("mode", F.lit("exact" if exact else "at_least")) for exact in (True, False)]
    return modes[0].unionByName(modes[1]).select(*key, "mode", "reason", "expected", "actual")


@query("""WITH r AS (SELECT conv_id AS doc, turn AS ordinal FROM conversations), w(sign, side) AS (VALUES ('(', 'begin'), (')', 'end'), ('|', 'begin'), ('{', 'begin'))
SELECT doc, ordinal, sign, CASE side WHEN 'begin' THEN 'opening_delimiter_missing' ELSE 'closing_delimiter_missing' END AS reason FROM r CROSS JOIN w WHERE NOT CASE sign WHEN '(' THEN ordinal % 3 = 0 WHEN ')' THEN ordinal % 6 = 0 WHEN '|' THEN ordinal % 3 = 1 ELSE ordinal % 3 = 2 END""")
def formula_delimiters_missing(t: Tables):
    """Four delimiters expected of every formula, of which each shows one or two on their sides."""
    n, x = F.col("turn") % 3, _plain()
    tex = F.when(n == 0, F.concat(F.lit("("), x, F.when(F.col("turn") % 6 == 0, ")").otherwise(""))).when(n == 1, F.concat(F.lit("|"), x, F.lit("|"))).otherwise(F.concat(F.lit("\\{"), x))
    rows = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ordinal"), tex.alias("tex"))
    wanted = F.array(*(F.struct(F.lit(s).alias("sign"), F.lit(side).alias("side")) for s, side in (("(", "begin"), (")", "end"), ("|", "begin"), ("{", "begin"))))
    expected = rows.select("doc", "ordinal", F.explode(wanted).alias("w")).select("doc", "ordinal", "w.*")
    return A.delimiters_missing(expected, rows, ["doc", "ordinal"], "tex", ["(", ")", "|", "{"])


GATES = ("internal_audit", "math_layout", "formula_counts", "content", "page_style", "mapping", "page_set")


def _gates(t: Tables) -> tuple[DataFrame, list[A.Gate]]:
    """Seven checks of each document, made from its turns: their exports, formulas, texts, sections, targets and pages."""
    c, doc, turn = t.conversations, F.col("conv_id"), F.col("turn")
    ordinal = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    turns = c.select(doc.alias("doc"), "turn", ordinal.alias("ordinal"), "role", _plain().alias("x"))
    keys = turns.groupBy("doc").agg(F.count("*").alias("n"))
    d = F.col("doc")
    header = keys.select(
        d.alias("audit_id"), F.lit("x-internal-tex-diagnostic/v1").alias("schema"), F.lit("full").alias("scope"), F.lit(True).alias("success"), F.lit("a").alias("docx_sha256"), F.when(d % 13 == 1, "b").otherwise("A").alias("expected_sha256"), F.lit("a").alias("sha_before"), F.lit("a").alias("sha_after"), F.col("n").alias("axmath_count"),
    )
    exports = turns.select(d.alias("audit_id"), "ordinal", (F.col("x") != "").alias("success"), "x", F.when(F.col("x") == "", " ").otherwise(F.col("x")).alias("tex"))
    audit = checks.internal_audit(header, exports).select(F.col("audit_id").alias("doc"))
    want, got = _formulas(t, False), _formulas(t, True)
    targets = want.select("doc", F.col("ordinal").alias("target_id"), F.col("tex").alias("expected_tex"), F.array("ordinal").alias("ordinals"))
    layout = diagnosis.layout_defects(targets, got.select("doc", "ordinal", F.col("tex").alias("text")), ["doc"])
    counts = turns.groupBy("doc").agg(F.count("*").alias("raw"), F.count_if(F.col("role") != "system").alias("converted"))
    state = counts.select("doc", count_state(F.col("raw"), F.lit(0), F.col("converted"), F.lit(0)).alias("state")).where("state <> 'exact'")
    content = A.content_flags(_texts(t, "source"), _texts(t, "final"), "doc", "line-start").where("not contract_exact")
    sections = turns.select("doc", F.floor(turn / 8).alias("section"), F.length("x").alias("v")).groupBy("doc", "section").agg(F.max("v").alias("v"))
    moved = sections.withColumn("v", F.col("v") + F.when((d % 6 == 5) & (F.col("section") == 0), 1).otherwise(0))
    style = compare.section_equality(sections, moved, "doc", "section", "v").where("not equal")
    owners = turns.select("doc", F.when((d % 9 == 7) & (F.col("ordinal") == 1), F.array("ordinal", F.col("ordinal") + 1)).otherwise(F.array("ordinal")).alias("final_ordinals"))
    mapping = M.mapping_mode(owners, keys.select("doc", F.lit(True).alias("mapping_pass"), F.lit(0).alias("added")), "doc").where("mode <> 'source_final_map'")
    pages = turns.select("doc", F.floor(turn / 4).alias("page")).distinct()
    seen = pages.where("not (doc % 8 = 6 and page = 0)")
    lost = compare.two_way_coverage(pages, seen, ["doc", "page"])
    failing = (audit, layout, state, content, style, mapping, lost)
    return keys, [A.Gate(name, found, stops=name in ("internal_audit", "math_layout")) for name, found in zip(GATES, failing, strict=True)]


_GATES = f"""WITH {_VERSIONS}, k AS (SELECT conv_id AS doc, bool_or(role = 'system') AS sys, bool_or({_X} = '') AS empty, bool_or(turn % 4 IN (0, 3)) AS odd FROM conversations GROUP BY 1),
q AS (SELECT s.doc, bool_or(s.plain <> c.plain) AND bool_or(s.label <> c.plain) AS drift FROM s JOIN c USING (doc, p) GROUP BY s.doc),
f AS (SELECT doc, doc % 13 = 1 OR empty AS g1, doc % 5 = 3 AND odd AS g2, sys AS g3, drift AS g4, doc % 6 = 5 AS g5, doc % 9 = 7 AS g6, doc % 8 = 6 AS g7 FROM k JOIN q USING (doc))"""


@query(f"""{_GATES}, g AS (SELECT doc, unnest([1, 2, 3, 4, 5, 6, 7]) AS nth, unnest(['{"', '".join(GATES)}']) AS gate, unnest([g1, g2, g3, g4, g5, g6, g7]) AS bad, CASE WHEN g1 THEN 1 WHEN g2 THEN 2 END AS stop FROM f)
SELECT doc, nth, gate, CASE WHEN nth > stop THEN 'not_run' WHEN bad THEN 'failed' ELSE 'passed' END AS state FROM g""")
def acceptance_gates_run(t: Tables):
    """Every gate of every document; after a failed audit or layout contract the rest is not read."""
    keys, gates = _gates(t)
    return A.run_gates(keys, gates, "doc")


@query(f"""{_GATES} SELECT doc, CASE WHEN g1 OR g2 THEN 'refused' WHEN g3 OR g4 OR g5 OR g6 OR g7 THEN 'hard_content_failed' ELSE 'awaiting_visual_review' END AS status,
  CASE WHEN g1 THEN 'internal_audit' WHEN g2 THEN 'math_layout' WHEN g3 THEN 'formula_counts' WHEN g4 THEN 'content' WHEN g5 THEN 'page_style' WHEN g6 THEN 'mapping' WHEN g7 THEN 'page_set' END AS first_block,
  CAST(CASE WHEN g1 OR g2 THEN 1 ELSE CAST(g3 AS INT) + CAST(g4 AS INT) + CAST(g5 AS INT) + CAST(g6 AS INT) + CAST(g7 AS INT) END AS BIGINT) AS failed FROM f""")
def acceptance_verdicts(t: Tables):
    """One verdict a document, and the first gate that blocks it."""
    keys, gates = _gates(t)
    return A.verdict(A.run_gates(keys, gates, "doc"), "doc")
