"""Package scans: every conversation is written as a package, which is then opened and scanned.

A turn is a paragraph; its number says what else the paragraph holds (formulas, limits, objects, breaks, fonts).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from auditlake.functions.text import is_heading
from auditlake.operators import rules
from auditlake.operators import formulas as M
from auditlake.plans.registry import Tables, query
from auditlake.sources import packages as P

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:v="urn:schemas-microsoft-com:vml"'
_STYLES = f"""<w:styles {_NS}><w:style w:styleId="S0"><w:name w:val="Normal"/></w:style><w:style w:styleId="S1"><w:name w:val="Heading 2"/></w:style>
<w:style w:styleId="S2"><w:name w:val="List"/><w:basedOn w:val="S3"/></w:style><w:style w:styleId="S3"><w:name w:val="Base"/><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style></w:styles>"""
_RELS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="x/image" Target="media/a.emf"/><Relationship Id="rId2" Type="x/image" Target="media/b.emf"/><Relationship Id="rId3" Type="x/image" Target="media/a.emf"/></Relationships>"""


def _paragraph(turn: int, text: str) -> str:
    fonts = '<w:rFonts w:ascii="Cambria Math"/>' if turn % 3 == 0 else ""
    body = f'<w:pPr><w:pStyle w:val="S{turn % 4}"/></w:pPr><w:r><w:rPr>{fonts}</w:rPr><w:t>{text}</w:t></w:r>'
    formula = "<m:oMath><m:r><m:t>x</m:t></m:r></m:oMath>"
    if turn % 2:
        limit = "<m:oMath><m:limLow><m:e><m:r><m:t>lim</m:t></m:r></m:e><m:lim><m:r><m:t>n</m:t></m:r></m:lim></m:limLow></m:oMath>" if turn % 4 == 3 else formula
        body += f"<m:oMathPara>{limit}{formula if turn % 4 == 1 else ''}</m:oMathPara>"
    if turn % 5 == 0:
        kind = "Equation.AxMath" if turn % 10 == 0 else "Equation.3"
        body += f'<w:r><w:br/></w:r><w:r><w:object><v:shape style="width:{turn * 60}pt;height:10.5pt"/><o:OLEObject ProgID="{kind}"/></w:object></w:r>'
    return f"<w:p>{body}</w:p>"


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, turns in zip(batch["conv_id"], batch["turns"], strict=True):
            file = io.BytesIO()
            with zipfile.ZipFile(file, "w") as z:
                section = '<w:sectPr><w:pgSz w:w="12240"/><w:pgMar w:left="1440" w:right="1440"/></w:sectPr>'
                z.writestr(P.MAIN, f"<w:document {_NS}><w:body>{''.join(_paragraph(t['turn'], t['text']) for t in turns)}{section}</w:body></w:document>")
                z.writestr("word/styles.xml", _STYLES)
                z.writestr("word/_rels/document.xml.rels", _RELS)
                z.writestr("word/media/a.emf", f"image {name}")
                z.writestr("word/media/b.emf", "image" if len(turns) % 2 else f"image {name}")
                z.writestr("../outside.xml", "x")
            rows.append((str(name), file.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


_TURNS = "SELECT CAST(conv_id AS VARCHAR) AS path, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g') AS plain FROM conversations"


def _parts(t: Tables):
    plain = t.conversations.select("conv_id", F.struct("turn", F.regexp_replace("text", "[^A-Za-z0-9 .,]", "").alias("text")).alias("t"))
    grouped = plain.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return P.parts(P.by_pieces(grouped, _written, "path string, content binary"))


@query(f"""WITH c AS ({_TURNS}) SELECT path, p, plain, CASE turn % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS formulas, CASE WHEN turn % 5 = 0 THEN 1 ELSE 0 END AS objects, CASE WHEN turn % 5 = 0 THEN 1 ELSE 0 END AS soft_breaks FROM c""")
def package_paragraphs(t: Tables):
    found = P.paragraph_texts(P.tokens(_parts(t)))
    return found.select("path", F.col("p").cast("long").alias("p"), "plain", "formulas", "objects", "soft_breaks")


@query(f"""WITH c AS ({_TURNS}) SELECT path, count(*) AS paragraphs, CAST(sum(CASE turn % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS BIGINT) AS native, count(*) FILTER (WHERE turn % 10 = 0) AS converted, count(*) FILTER (WHERE turn % 10 = 5) AS "foreign", CAST(0 AS BIGINT) AS outside_main,
  CASE WHEN count(*) FILTER (WHERE turn % 10 = 5) > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE turn % 2 = 1) > 0 AND count(*) FILTER (WHERE turn % 10 = 0) = 0 THEN 'ready_officemath' WHEN count(*) FILTER (WHERE turn % 2 = 1) > 0 THEN 'mixed' WHEN count(*) FILTER (WHERE turn % 10 = 0) > 0 THEN 'already_axmath' ELSE 'no_native_math' END AS state FROM c GROUP BY path""")
def package_inventory(t: Tables):
    counts = P.inventory(P.tokens(_parts(t)))
    return counts.select("*", rules.source_state(F.col("foreign") + F.col("outside_main"), F.col("native"), F.col("converted")).alias("state"))


@query(f"""WITH c AS ({_TURNS}) SELECT path, p, plain AS text FROM c WHERE turn % 3 = 0""")
def package_math_font_runs(t: Tables):
    found = P.tokens(_parts(t)).where("kind = 'text' and font = 'Cambria Math'")
    return found.select("path", F.col("p").cast("long").alias("p"), "text")


@query(f"""WITH c AS ({_TURNS}) SELECT path, p, ['below'] AS placements FROM c WHERE turn % 4 = 3""")
def package_limits(t: Tables):
    nodes = P.tokens(_parts(t)).select("path", F.col("p").cast("long").alias("p"), F.col("kind").alias("tag"), F.col("text").alias("base"))
    return M.limit_scripts(nodes).select("path", "p", "placements")


@query(f"""WITH c AS ({_TURNS}), f AS (SELECT path, p, unnest(range(CASE turn % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END)) AS k FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p, k) AS ordinal FROM f)
SELECT path, p, list_sort(list(CAST(ordinal AS INTEGER))) AS ordinals, count(*) - 1 AS extra FROM o GROUP BY path, p HAVING count(*) > 1""")
def package_sibling_groups(t: Tables):
    places = P.formula_places(P.tokens(_parts(t)))
    return M.sibling_groups(places.withColumn("p", F.col("p").cast("long")), ["path", "p", "math_group"]).drop("math_group")


@query(f"""WITH c AS ({_TURNS}), f AS (SELECT path, p, unnest(range(CASE turn % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END)) AS k FROM c) SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY p, k) AS BIGINT) AS ordinal, p FROM f""")
def package_formula_places(t: Tables):
    places = P.formula_places(P.tokens(_parts(t)))
    return places.select("path", F.col("ordinal").cast("long").alias("ordinal"), F.col("p").cast("long").alias("p"))


@query(f"""WITH c AS ({_TURNS}) SELECT path, p, CAST(turn * 60 AS DOUBLE) AS width, 10.5::DOUBLE AS height, turn * 60 > 468 AS overwide FROM c WHERE turn % 5 = 0""")
def package_object_layout(t: Tables):
    parts = _parts(t)
    shapes = P.tokens(parts).where("kind = 'shape'").select("path", F.col("p").cast("long").alias("p"), "width", "height")
    return shapes.join(P.sections(parts).where("section = 1"), "path").select("path", "p", "width", "height", rules.holds(F.col("width") > F.col("text_width")).alias("overwide"))


@query("""WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS n FROM conversations GROUP BY 1), r(rel_id, target) AS (VALUES ('rId1', 'word/media/a.emf'), ('rId2', 'word/media/b.emf'), ('rId3', 'word/media/a.emf'))
SELECT path, 'word/document.xml' AS part_name, rel_id, 'image' AS kind, target, sha256(CASE WHEN target = 'word/media/a.emf' OR n % 2 = 0 THEN 'image ' || path ELSE 'image' END) AS target_sha256 FROM n CROSS JOIN r""")
def package_relationships(t: Tables):
    return P.relationships(_parts(t)).select("path", "part_name", "rel_id", "kind", "target", "target_sha256")


@query("""WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS n FROM conversations GROUP BY 1) SELECT path, 'word/media/a.emf' AS target, CAST(2 AS BIGINT) AS n FROM n""")
def package_shared_previews(t: Tables):
    """Images that several objects of one package lead to."""
    rels = P.relationships(_parts(t)).where("kind = 'image'")
    return rels.groupBy("path", "target").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH c AS ({_TURNS}) SELECT path, p, turn % 4 IN (2, 3) AS automatic, false AS field, turn % 4 = 1 AS outline, turn % 4 = 1 AS heading FROM c WHERE turn % 4 <> 0""")
def package_numbering(t: Tables):
    """Paragraphs numbered by their styles, which inherit within their own package."""
    parts = _parts(t)
    styles = P.styles(parts)
    number = rules.inherited_first(styles, "num_id", ["path"]).join(rules.inherited_first(styles, "outline", ["path"]), ["path", "style_id"])
    known = number.join(styles.select("path", "style_id", is_heading(F.col("name")).alias("heading")), ["path", "style_id"])
    paragraphs = P.tokens(parts).groupBy("path", "p").agg(F.first("style_id").alias("style_id")).select("path", F.col("p").cast("long").alias("p"), "style_id", *(F.lit(None).cast("string").alias(c) for c in ("num_id", "outline", "instr")))
    return M.numbering_candidates(paragraphs, known, ("path",))


@query("""WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS n FROM conversations GROUP BY 1)
SELECT path, 'word/media/b.emf' AS part_name, sha256(CASE WHEN n % 2 = 0 THEN 'image ' || path ELSE 'image' END) AS before, sha256('image ' || path) AS after FROM n WHERE n % 2 = 1""")
def package_changed_parts(t: Tables):
    """Every package against one whose second image is the first."""
    parts = _parts(t)
    other = parts.where("part_name <> 'word/media/b.emf'").unionByName(parts.where("part_name = 'word/media/a.emf'").withColumn("part_name", F.lit("word/media/b.emf")))
    return P.changed_parts(parts, other, ["path"])
