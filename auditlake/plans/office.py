"""Packages whose numbering, runs, objects, formulas and images come from the words and numbers of the tables.

Every conversation is a package; a turn is a paragraph, its words are runs and formulas, its length sets sizes and pixels.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.tex import plain_math_udf
from auditlake.functions.text import is_heading
from auditlake.operators import formulas as M
from auditlake.operators import rules
from auditlake.operators.lists import list_numbers
from auditlake.operators.numbering import occurrence
from auditlake.plans.packages import _NS
from auditlake.plans.registry import Tables, query
from auditlake.sources import images, nodes, writer
from auditlake.sources import packages as P
from auditlake.sources.stored import stored

_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_STAMP = (2020, 1, 1, 0, 0, 0)
_STYLES = f"""<w:styles {_NS}><w:style w:styleId="S0"><w:name w:val="Normal"/></w:style><w:style w:styleId="S1"><w:name w:val="Heading 2"/></w:style>
<w:style w:styleId="S2"><w:name w:val="List"/><w:basedOn w:val="S3"/></w:style><w:style w:styleId="S3"><w:name w:val="Base"/><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style></w:styles>"""
_KINDS = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="png" ContentType="image/png"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/embeddings/oleObject1.bin" ContentType="application/ole"/></Types>'
SIDE = 8


def png(values: bytes, side: int = SIDE) -> bytes:
    """A square grey image; every other row is stored as differences."""
    rows = [values[y * side : (y + 1) * side] for y in range(side)]
    raw = b"".join(b"\0" + r if y % 2 else b"\1" + bytes([r[0], *((r[x] - r[x - 1]) % 256 for x in range(1, side))]) for y, r in enumerate(rows))
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = side.to_bytes(4, "big") * 2 + bytes([8, 0, 0, 0, 0])
    return images.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _pixels(size: int) -> bytes:
    """Three kinds of image: white, grey, and a ramp that depends on the size of the text."""
    kind = size % 3
    return bytes([255, 128][kind] if kind < 2 else size * (i + 1) % 256 for i in range(SIDE * SIDE))


def _paragraph(turn: int, first: str, rest: str, number: int) -> str:
    style = f'<w:pStyle w:val="S{turn % 4}"/>' if turn % 3 == 0 else ""
    listed = f'<w:numPr><w:ilvl w:val="{turn % 3}"/><w:numId w:val="{turn % 5}"/></w:numPr>' if turn % 5 in (1, 2) else '<w:numPr><w:numId w:val="0"/></w:numPr>' if turn % 5 == 3 else ""
    outline = f'<w:outlineLvl w:val="{turn % 10}"/>' if turn % 7 == 4 else ""
    field = "<w:r><w:instrText> SEQ Figure </w:instrText></w:r>" if turn % 6 == 2 else '<w:fldSimple w:instr="PAGE"/>' if turn % 6 == 5 else ""
    raised = '<w:rPr><w:vertAlign w:val="superscript"/></w:rPr>' if turn % 8 == 3 else ""
    formula = ""
    if turn % 4 == 3:
        formula = f"<m:oMath><m:f><m:num><m:r><m:t>{first}</m:t></m:r></m:num><m:den><m:r><m:t>{turn}</m:t></m:r></m:den></m:f></m:oMath>"
    elif turn % 2:
        formula = f"<m:oMath><m:r><w:t>x</w:t><m:t>{first}</m:t></m:r></m:oMath>"
    body = f"<w:pPr>{style}{listed}{outline}</w:pPr>{field}<w:r>{raised}<w:t>{first}</w:t></w:r>{formula}<w:r><w:t xml:space='preserve'>{rest}</w:t></w:r>"
    if number:
        size = len(first) + len(rest)
        shell = f'<v:shape style="width:{size}pt;height:10.5pt"><v:imagedata r:id="rId{2 * number}"/></v:shape>'
        body += f'<w:r><w:rPr><w:position w:val="-{turn}"/></w:rPr><w:object w:dxaOrig="{size * 20}" w:dyaOrig="210">{shell}<o:OLEObject ProgID="Equation.AxMath" r:id="rId{2 * number + 1}"/></w:object></w:r>'
    return f"<w:p>{body}</w:p>"


def _numbering(start: int) -> str:
    levels = lambda first: "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{first if k == 0 else 1}"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%{k + 1}."/></w:lvl>' for k in range(3))
    override = f'<w:lvlOverride w:ilvl="0"><w:startOverride w:val="{start}"/></w:lvlOverride><w:lvlOverride w:ilvl="2"><w:lvl w:ilvl="2"><w:start w:val="3"/><w:numFmt w:val="lowerLetter"/></w:lvl></w:lvlOverride>'
    return f'<w:numbering {_NS}><w:abstractNum w:abstractNumId="0">{levels(1)}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels(5)}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/>{override}</w:num></w:numbering>'


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for conv, turns in zip(batch["conv_id"], batch["turns"], strict=True):
            file, number, paragraphs, relations, media = io.BytesIO(), 0, [], [], {}
            for t in turns:
                turn, first, rest = t["turn"], t["first"], t["rest"]
                has = turn % 5 == 0
                number += has
                paragraphs.append(_paragraph(turn, first, rest, number if has else 0))
                if has:
                    outside = turn % 20 == 5
                    mode = ' TargetMode="External"' if outside else ""
                    relations.append(f'<Relationship Id="rId{2 * number}" Type="x/image" Target="media/image{number}.png"{mode}/><Relationship Id="rId{2 * number + 1}" Type="x/oleObject" Target="embeddings/oleObject{number}.bin"/>')
                    media[f"word/media/image{number}.png"] = png(_pixels(len(first) + len(rest)))
                    media[f"word/embeddings/oleObject{number}.bin"] = f"object {conv} {turn}".encode()
            parts = {
                "[Content_Types].xml": _KINDS, P.MAIN: f"<w:document {_NS} {_REL}><w:body>{''.join(paragraphs)}</w:body></w:document>", "word/styles.xml": _STYLES, "word/numbering.xml": _numbering(int(conv) % 4 + 1),
                "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(relations)}</Relationships>', **media,
            }
            with zipfile.ZipFile(file, "w") as z:
                for name, body in parts.items():
                    z.writestr(zipfile.ZipInfo(name, _STAMP), body)
            rows.append((str(conv), file.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


def _packages(t: Tables) -> DataFrame:
    plain = F.trim(F.regexp_replace("text", "[^A-Za-z0-9 .,]", ""))
    words = t.conversations.select("conv_id", "turn", F.split_part(plain, F.lit(" "), F.lit(1)).alias("first"), plain.alias("plain"))
    turns = words.select("conv_id", F.struct("turn", "first", F.expr("substring(plain, length(first) + 1)").alias("rest")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return stored(P.by_pieces(grouped, _written, "path string, content binary"), "packages")


def _parts(t: Tables) -> DataFrame:
    return stored(P.parts(_packages(t)), "parts")


_T = """t AS (SELECT CAST(conv_id AS VARCHAR) AS path, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, split_part(x, ' ', 1) AS first, x[len(split_part(x, ' ', 1)) + 1:] AS rest, len(x) AS size
  FROM (SELECT *, trim(regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g')) AS x FROM conversations))"""
_O = f"""{_T}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY turn) AS k FROM t WHERE turn % 5 = 0)"""


@query(f"""WITH {_T}, n AS (SELECT *, CASE WHEN turn % 5 IN (1, 2) THEN CAST(turn % 5 AS VARCHAR) WHEN turn % 5 = 3 THEN '0' WHEN turn % 3 = 0 AND turn % 4 IN (2, 3) THEN '4' END AS num, CASE WHEN turn % 7 = 4 THEN turn % 10 END AS outl, turn % 3 = 0 AND turn % 4 = 1 AS heading FROM t)
SELECT * FROM (SELECT path, p, coalesce(num <> '0', false) AS automatic, turn % 6 = 2 AS field, coalesce(outl <> 9, heading) AS outline, heading FROM n) WHERE automatic OR field OR outline OR heading""")
def office_numbering(t: Tables):
    """Paragraphs numbered by themselves, a field or their style; a number of 0 switches the style's off."""
    parts = _parts(t)
    styles = P.styles(parts)
    inherited = rules.inherited_first(styles, "num_id", ["path"]).join(rules.inherited_first(styles, "outline", ["path"]), ["path", "style_id"])
    known = inherited.join(styles.select("path", "style_id", is_heading(F.col("name")).alias("heading")), ["path", "style_id"])
    paragraphs = nodes.paragraph_numbering(parts).select("path", "p", "style_id", "num_id", "outline", F.coalesce("instr", F.lit("")).alias("instr"))
    return M.numbering_candidates(paragraphs, known, ("path",))


@query(f"""WITH c AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS path, conv_id FROM conversations), l(num_id, level) AS (SELECT * FROM (VALUES ('1', 0), ('1', 1), ('1', 2), ('2', 0), ('2', 1), ('2', 2)))
SELECT path, num_id, CASE num_id WHEN '1' THEN '0' ELSE '1' END AS abstract_id, level, CAST(CASE WHEN num_id = '1' OR level = 1 THEN 1 WHEN level = 0 THEN conv_id % 4 + 1 ELSE 3 END AS BIGINT) AS start,
  CASE WHEN num_id = '2' AND level = 2 THEN 'lowerLetter' ELSE 'decimal' END AS format, CASE WHEN num_id = '2' AND level = 2 THEN NULL ELSE '%' || (level + 1) || '.' END AS text FROM c CROSS JOIN l""")
def office_list_levels(t: Tables):
    """Lists through instance, abstract list and the overrides of their levels."""
    return nodes.list_levels(_parts(t))


@query(f"""WITH {_T}, l AS (SELECT *, CAST(turn % 5 AS VARCHAR) AS num_id, CAST(turn % 3 AS INTEGER) AS level FROM t WHERE turn % 5 IN (1, 2)),
h AS (SELECT a.*, (SELECT count(*) FROM l b WHERE b.path = a.path AND b.num_id = a.num_id AND b.p <= a.p AND b.level < a.level) AS higher FROM l a)
SELECT path, p, num_id, level, CASE WHEN num_id = '2' AND level = 2 THEN 'lowerLetter' ELSE 'decimal' END AS format,
  CAST(CASE WHEN num_id = '1' OR level = 1 THEN 1 WHEN level = 0 THEN conv_id % 4 + 1 ELSE 3 END + row_number() OVER (PARTITION BY path, num_id, level, higher ORDER BY p) - 1 AS BIGINT) AS number FROM h""")
def office_list_numbers(t: Tables):
    """The number every list paragraph shows; nested levels start again."""
    parts = _parts(t)
    return list_numbers(nodes.paragraph_numbering(parts), nodes.list_levels(parts), ["path"])


_RUNS = f"""{_T}, r AS (SELECT path, p, turn, 1 AS nth, first AS text FROM t UNION ALL SELECT path, p, turn, 2, rest FROM t),
q AS (SELECT path, p, turn, nth, text, CAST(CASE WHEN nth = 1 THEN 0 ELSE (SELECT len(first) FROM t WHERE t.path = r.path AND t.p = r.p) END AS INTEGER) AS start, CASE WHEN nth = 1 AND turn % 8 = 3 THEN 'superscript' END AS vertical FROM r WHERE text <> '')"""


def _plain_runs(t: Tables) -> DataFrame:
    """Text runs that no formula holds, with the number of times the same text came before in its paragraph."""
    found = nodes.runs(_parts(t)).where("text <> '' and not in_math").select("path", "p", F.col("run").alias("pos"), "text", "start", "vertical")
    return occurrence(found, ["path", "p"], "text", ["pos"])


@query(f"""WITH {_RUNS} SELECT path, p, start, text, vertical, row_number() OVER (PARTITION BY path, p, text ORDER BY nth) AS occurrence FROM q""")
def office_plain_runs(t: Tables):
    return _plain_runs(t).select("path", "p", "start", "text", "vertical", F.col("occurrence").cast("long").alias("occurrence"))


@query()
def office_plain_math(t: Tables):
    """Runs typed as text that read as mathematics, by the rule on runs, where they stand in their paragraph."""
    runs = _plain_runs(t)
    whole = runs.groupBy("path", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("paragraph"))
    judged = runs.join(whole, ["path", "p"]).withColumn("m", plain_math_udf("text", "paragraph", "start", "vertical"))
    return judged.where("m.is_math").select("path", "p", "pos", "text", "start", F.col("m.kind").alias("kind"))


@query(f"""WITH {_O} SELECT path, k AS ordinal, p, CAST(-turn / 2.0 AS DOUBLE) AS position, CAST(size AS DOUBLE) AS width, 10.5::DOUBLE AS height, CAST(size * 20 AS BIGINT) AS dxa, CAST(210 AS BIGINT) AS dya, 'rId' || (2 * k + 1) AS rel_id, 'rId' || (2 * k) AS image_id, turn / 2.0 / 10.5 > 0.7 AS suspicious FROM o""")
def office_object_layout(t: Tables):
    """Shells of objects: original and shown sizes, and how far the run is moved against their height."""
    found = nodes.object_layout(_parts(t))
    return found.select("path", "ordinal", "p", "position", "width", "height", "dxa", "dya", "rel_id", "image_id", rules.holds(F.col("ratio") > 0.7).alias("suspicious"))


_MATH = 'xmlns:n0="http://schemas.openxmlformats.org/officeDocument/2006/math"'
_WORD = 'xmlns:n1="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@query(f"""WITH {_T} SELECT path, row_number() OVER (PARTITION BY path ORDER BY p) AS ordinal, p, first || CASE WHEN turn % 4 = 3 THEN CAST(turn AS VARCHAR) ELSE '' END AS text,
  sha256(CASE WHEN turn % 4 = 3 THEN '<n0:oMath {_MATH}><n0:f><n0:num><n0:r><n0:t>' || first || '</n0:t></n0:r></n0:num><n0:den><n0:r><n0:t>' || turn || '</n0:t></n0:r></n0:den></n0:f></n0:oMath>'
    ELSE '<n0:oMath {_MATH}><n0:r><n1:t {_WORD}>x</n1:t><n0:t>' || first || '</n0:t></n0:r></n0:oMath>' END) AS sha256, turn % 4 = 3 AS fraction FROM t WHERE turn % 2 = 1""")
def office_formula_nodes(t: Tables):
    """Every native formula with the hash of its own subtree."""
    found = nodes.formula_nodes(_parts(t))
    return found.select("path", "ordinal", "p", "text", "sha256", F.exists("tags", lambda x: x["name"] == "f").alias("fraction"))


@query(f"""WITH {_O}, v AS (SELECT path, k, turn, unnest(CASE size % 3 WHEN 0 THEN [255 FOR i IN range(64)] WHEN 1 THEN [128 FOR i IN range(64)] ELSE [size * (i + 1) % 256 FOR i IN range(64)] END) AS g, turn % 20 = 5 AS outside FROM o),
s AS (SELECT path, k, outside, CAST(avg(g) AS DOUBLE) AS mean, CAST(stddev_pop(g) AS DOUBLE) AS std, CAST(avg(CASE WHEN g < 160 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS dark, CAST(avg(CASE WHEN g < 230 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS ink FROM v GROUP BY ALL)
SELECT path, k AS ordinal, round(mean, 6) AS mean, round(std, 6) AS std, dark, ink, (std < 2 AND mean > 245) OR (std < 3 AND mean > 90 AND mean < 235) OR ink < 0.0005 AS suspicious FROM s WHERE NOT outside""")
def office_previews(t: Tables):
    """Preview images of objects: figures from their pixels, and which are suspicious; links that lead outside have no image here."""
    parts = _parts(t)
    objects = nodes.object_layout(parts).select("path", "ordinal", F.col("image_id").alias("rel_id"))
    links = P.relationships(parts).where("kind = 'image' and not external").select("path", "rel_id", F.col("target").alias("part_name"))
    figures = images.image_statistics(parts).where("error is null")
    found = objects.join(links, ["path", "rel_id"]).join(figures, ["path", "part_name"])
    return found.select("path", "ordinal", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "dark", "ink", M.suspicious_preview(F.col("mean"), F.col("std"), F.col("ink")).alias("suspicious"))


_EDITS = "turn % 3 = 1 AND conv_id % 4 <> 1"


def _edits(t: Tables) -> DataFrame:
    """The first text of one turn in three; conversations of one in seven name a text that is not there any more."""
    words = F.split_part(F.trim(F.regexp_replace("text", "[^A-Za-z0-9 .,]", "")), F.lit(" "), F.lit(1))
    p = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", p.alias("p"), words.alias("first")).where(_EDITS)
    return rows.select(F.col("conv_id").cast("string").alias("path"), "p", F.lit(1).alias("t"), F.concat("first", F.when(F.col("conv_id") % 7 == 5, "!").otherwise("")).alias("old"), F.concat(F.lit("<"), "first", F.lit("&>")).alias("new"))


@query(f"""WITH {_T}, c AS (SELECT path, conv_id, count(*) FILTER ({_EDITS}) AS n FROM t GROUP BY ALL)
SELECT path, CASE WHEN n = 0 THEN 'copied' WHEN conv_id % 7 = 5 THEN 'refused:stale_text' ELSE 'written' END AS status, n = 0 OR conv_id % 7 = 5 AS same_bytes, CASE WHEN n > 0 AND conv_id % 7 <> 5 THEN 'word/document.xml' END AS part_name FROM c""")
def office_rewrite(t: Tables):
    """Packages with edits applied: which are copied, written or refused, and the parts that differ afterwards (one, or none)."""
    packages = _packages(t)
    made = stored(writer.rewritten(packages, _edits(t)), "rewritten")
    changed = P.changed_parts(P.parts(packages), P.parts(made), ["path"]).select("path", "part_name")
    return made.select("path", "status", (F.col("sha256_before") == F.col("sha256_after")).alias("same_bytes")).join(changed, "path", "left")


@query(f"""WITH {_T}, f AS (SELECT *, {_EDITS} AND conv_id % 7 <> 5 AS edited FROM t) SELECT path, p, CASE WHEN edited THEN '<' || first || '&>' ELSE first END || rest AS plain FROM f""")
def office_rewritten_texts(t: Tables):
    """The texts of the packages as written, read again."""
    made = writer.rewritten(_packages(t), _edits(t))
    tokens = P.tokens(P.parts(made)).where("kind = 'text'")
    lists = tokens.groupBy("path", F.col("p").cast("long").alias("p")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return lists.select("path", "p", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("plain"))


@query(f"""WITH {_O}, c AS (SELECT path, conv_id, max(k) AS n FROM o GROUP BY ALL), z AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS path, conv_id FROM conversations)
SELECT path, CASE WHEN n = 1 AND conv_id % 3 > 0 THEN 'written' WHEN n > 1 AND conv_id % 2 = 0 THEN 'refused:relationship_missing_or_external' WHEN n > 1 THEN 'refused:no_content_type' ELSE 'copied' END AS status,
  CASE WHEN n = 1 AND conv_id % 3 > 0 THEN [{{'rel_id': 'rId2', 'new_id': 'rId4', 'new_part': 'word/media/image2.png'}}, {{'rel_id': 'rId3', 'new_id': 'rId5', 'new_part': 'word/embeddings/oleObject2.bin'}}] ELSE [] END AS clones FROM z LEFT JOIN c USING (path, conv_id)""")
def office_clones(t: Tables):
    """Objects cloned under free names and numbers; of several, the second one's image lies outside and its object has no content type."""
    objects = t.conversations.where("turn % 5 = 0").groupBy("conv_id").agg(F.count("*").alias("n"))
    links = F.when((F.col("n") == 1) & (F.col("conv_id") % 3 > 0), F.array(F.lit("rId2"), F.lit("rId3"))).when(F.col("n") > 1, F.array(F.when(F.col("conv_id") % 2 == 0, "rId4").otherwise("rId5")))
    made = writer.cloned(_packages(t), objects.select(F.col("conv_id").cast("string").alias("path"), F.explode(links).alias("rel_id")))
    return made.select("path", "status", F.coalesce("clones", F.array().cast("array<struct<rel_id:string,new_id:string,new_part:string>>")).alias("clones"))


@query(f"""WITH {_T}, c AS (SELECT path, conv_id, count(*) AS n, count(*) FILTER (turn % 2 = 1) AS native, count(*) FILTER (turn % 5 = 0) AS converted FROM t GROUP BY ALL)
SELECT path, CASE WHEN conv_id % 7 IN (3, 5) THEN 0 ELSE n END AS paragraphs, CASE WHEN conv_id % 7 IN (3, 5) THEN 0 ELSE native END AS native, CASE WHEN conv_id % 7 IN (3, 5) THEN 0 ELSE converted END AS converted, CAST(0 AS BIGINT) AS "foreign", CAST(0 AS BIGINT) AS outside_main,
  CASE WHEN conv_id % 7 = 3 THEN 'invalid' WHEN conv_id % 7 = 5 THEN 'no_document' WHEN native > 0 AND converted > 0 THEN 'mixed' WHEN native > 0 THEN 'ready_officemath' WHEN converted > 0 THEN 'already_axmath' ELSE 'no_native_math' END AS state FROM c""")
def office_states(t: Tables):
    """Every package has a state, also one that was cut short and one whose main part is gone."""
    conv = F.col("path").cast("long") % 7
    packages = _packages(t).withColumn("content", F.when(conv == 3, F.substring("content", 1, 40)).otherwise(F.col("content")))
    parts = stored(P.parts(packages).where(~((conv == 5) & (F.coalesce("part_name", F.lit("")) == P.MAIN))), "parts")
    return P.document_states(parts, P.tokens(parts)).select("path", "paragraphs", "native", "converted", "foreign", "outside_main", "state")
