"""Pairs of packages: four conversations make an original, its converted document and a repaired candidate, which are then opened and compared.

A turn is a paragraph.  Turn numbers say how many formulas it had; the length of its text is the width, in points, of the
object that replaced them.  Some converted documents begin with a paragraph of their own, so that paragraphs are offset.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.tex import anchor_udf
from auditlake.operators import local_layout as L
from auditlake.operators.rules import count_state
from auditlake.plans.packages import _NS
from auditlake.plans.registry import Tables, query
from auditlake.sources import packages as P
from auditlake.sources.stored import stored

_SECTION = '<w:sectPr><w:pgSz w:w="12240"/><w:pgMar w:left="1440" w:right="1440"/></w:sectPr>'
_STAMP = (2020, 1, 1, 0, 0, 0)


def _formulas(turn: int) -> int:
    return (1, 0, 1, 1, 0, 2)[turn % 6]


def _objects(turn: int) -> int:
    return 2 if turn % 12 == 8 else min(1, _formulas(turn))


def _object(width: float) -> str:
    return f'<w:r><w:object><v:shape style="width:{width}pt;height:10.5pt"/><o:OLEObject ProgID="Equation.AxMath"/></w:object></w:r>'


def _paragraph(version: str, doc: int, p: int, turn: int, text: str) -> str:
    math = "".join(f"<m:oMath><m:r><m:t>x{turn}</m:t></m:r></m:oMath>" for _ in range(_formulas(turn)))
    if version == "source":
        return f"<w:p><w:r><w:t>{text}</w:t></w:r>{math}</w:p>"
    if doc % 5 == 3 and p % 8 == 7:
        text += " more"
    body = f"<w:r><w:t>{text}</w:t></w:r>"
    objects = _objects(turn)
    if version == "candidate" and objects == 1 and len(text) > 470:
        body += _object(400) + ("" if doc % 7 == 4 else "<w:r><w:br/></w:r>") + _object(400)
    else:
        body += _object(len(text)) * objects
    if doc % 11 == 5 and p == 1:
        body += math or "<m:oMath/>"
    if version == "candidate" and doc % 6 == 2 and p == 1:
        body += "<w:r><w:br/></w:r>"
    return f"<w:p>{body}</w:p>"


def _packages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, turns in zip(batch["doc"], batch["turns"], strict=True):
            for version in ("source", "working", "candidate"):
                front = [f"<w:p><w:r><w:t>Front matter of {doc}.</w:t></w:r></w:p>"] if version != "source" and doc % 2 else []
                body = "".join([*front, *(_paragraph(version, doc, t["p"], t["turn"], t["plain"]) for t in turns), _SECTION])
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w") as z:
                    z.writestr(zipfile.ZipInfo(P.MAIN, _STAMP), f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
                rows.append((f"{version}/{doc}", file.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


def _turns(t: Tables) -> DataFrame:
    plain = t.conversations.select(F.floor(F.col("conv_id") / 4).alias("doc"), "conv_id", "turn", F.regexp_replace("text", "[^A-Za-z0-9 .,]", "").alias("plain"))
    return plain.withColumn("p", F.row_number().over(Window.partitionBy("doc").orderBy("conv_id", "turn")))


def _facts(t: Tables) -> DataFrame:
    """One row a paragraph of every version: text, formulas, objects, breaks, the widest shell, the width of the text."""
    grouped = _turns(t).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("p", "turn", "plain"))).alias("turns"))
    # packages are opened once; tokens and sections come from the parts kept
    parts = stored(P.parts(P.by_pieces(grouped, _packages, "path string, content binary")), "parts")
    found = P.tokens(parts).where(F.col("story") == P.MAIN)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text")))), lambda x: x["text"]), "")
    rows = found.groupBy("path", F.col("p").cast("long").alias("p")).agg(
        text.alias("plain"), count("math").alias("formulas"), count("object").alias("objects"), count("br").alias("soft_breaks"), F.max("width").alias("width")
    )
    ordered = Window.partitionBy("path").orderBy("p")
    first = F.when(F.col("formulas") > 0, F.coalesce(F.sum("formulas").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    rows = rows.withColumn("first_ordinal", first).join(P.sections(parts).where("section = 1").select("path", "text_width"), "path")
    rows = rows.withColumn("version", F.split_part("path", F.lit("/"), F.lit(1))).withColumn("doc", F.split_part("path", F.lit("/"), F.lit(2)).cast("long")).drop("path")
    return stored(rows, "paragraphs")


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = stored(_facts(t).withColumn("plain", anchor_udf("plain")), "normal")
    return tuple(rows.where(F.col("version") == v).drop("version") for v in ("source", "working"))


def _anchors(t: Tables) -> DataFrame:
    """The first forty characters of one of the first five paragraphs."""
    rows = _turns(t).where(F.col("p") == F.col("doc") % 5 + 1)
    return stored(rows.select("doc", anchor_udf(F.left("plain", F.lit(40))).alias("anchor")), "anchors")


_DOCS = """t AS (SELECT conv_id // 4 AS doc, turn, regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g') AS x, row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id, turn) AS p FROM conversations),
s AS (SELECT doc, p, turn, x, regexp_replace(x, '[ .,]', '', 'g') AS plain, [1, 0, 1, 1, 0, 2][turn % 6 + 1] AS formulas FROM t),
so AS (SELECT *, CASE WHEN formulas > 0 THEN sum(formulas) OVER (PARTITION BY doc ORDER BY p) - formulas + 1 END AS first_ordinal FROM s),
w AS (SELECT doc, p + doc % 2 AS p, plain || CASE WHEN doc % 5 = 3 AND p % 8 = 7 THEN 'more' ELSE '' END AS plain, CASE WHEN doc % 11 = 5 AND p = 1 THEN greatest(formulas, 1) ELSE 0 END AS formulas,
  CASE WHEN turn % 12 = 8 THEN 2 ELSE least(formulas, 1) END AS objects, len(x) + CASE WHEN doc % 5 = 3 AND p % 8 = 7 THEN 5 ELSE 0 END AS width FROM s
  UNION ALL SELECT DISTINCT doc, 1, 'Frontmatterof' || doc, 0, 0, 0 FROM s WHERE doc % 2 = 1),
an AS (SELECT doc, regexp_replace(left(x, 40), '[ .,]', '', 'g') AS anchor FROM s WHERE p = doc % 5 + 1),
fd AS (SELECT an.doc, anchor, (SELECT count(*) FROM s WHERE s.doc = an.doc AND contains(s.plain, anchor)) AS sh, (SELECT min(p) FROM s WHERE s.doc = an.doc AND contains(s.plain, anchor)) AS sa,
  (SELECT count(*) FROM w WHERE w.doc = an.doc AND contains(w.plain, anchor)) AS wh, (SELECT min(p) FROM w WHERE w.doc = an.doc AND contains(w.plain, anchor)) AS wa FROM an),
f AS (SELECT *, CASE WHEN anchor = '' THEN 'empty_anchor' WHEN sh <> 1 THEN 'source_anchor_not_unique' WHEN wh <> 1 THEN 'working_anchor_not_unique' END AS areason, wa - sa AS off FROM fd),
tg AS (SELECT w.doc, w.p AS working_p, w.p - off AS source_p, w.width - 468.0 AS overflow, CASE WHEN so.p IS NULL THEN 'outside_source' WHEN w.objects <> 1 THEN 'not_one_object' WHEN so.formulas <> 1 THEN 'not_one_formula' END AS error, so.first_ordinal
  FROM w JOIN f USING (doc) LEFT JOIN so ON so.doc = w.doc AND so.p = w.p - off WHERE areason IS NULL AND w.objects > 0 AND w.width > 470 AND w.p > wa),
sp AS (SELECT f.doc, off, sa, coalesce(max(source_p) FILTER (error IS NULL), sa) AS last FROM f LEFT JOIN tg USING (doc) WHERE areason IS NULL GROUP BY f.doc, off, sa),
pr AS (SELECT s.doc, s.p, w.plain IS NOT NULL AS there, coalesce(s.plain = w.plain, false) AS same FROM s JOIN sp ON sp.doc = s.doc AND s.p BETWEEN sa AND last AND len(s.plain) >= 4 LEFT JOIN w ON w.doc = s.doc AND w.p = s.p + off),
pb AS (SELECT *, coalesce(sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missed FROM pr),
pf AS (SELECT doc, count(*) FILTER (there) AS checked, count(*) FILTER (same) AS matches, count(*) FILTER (NOT same) AS mismatches FROM pb WHERE missed < 8 GROUP BY doc),
st AS (SELECT f.doc, off, coalesce(checked, 0) AS checked, coalesce(matches, 0) AS matches, coalesce(mismatches, 0) AS mismatches, CASE WHEN f.doc % 11 = 5 THEN 'native_formulas_left' WHEN areason IS NOT NULL THEN areason
  WHEN coalesce(checked, 0) < 5 OR coalesce(mismatches, 0) > 0 THEN 'offset_not_stable' END AS reason, areason FROM f LEFT JOIN pf USING (doc)),
jd AS (SELECT tg.doc, working_p, source_p, CASE WHEN error IS NULL THEN first_ordinal END AS ordinal, overflow, error, coalesce(error IS NULL AND first_ordinal % 3 <> 0 AND first_ordinal % 7 <> 0 AND st.reason IS NULL, false) AS kept FROM tg JOIN st USING (doc))"""


def _probes(source: DataFrame) -> DataFrame:
    ordinals = source.where("formulas > 0").select("doc", F.explode(F.sequence(F.col("first_ordinal"), F.col("first_ordinal") + F.col("formulas") - 1)).alias("ordinal"))
    return ordinals.select("doc", "ordinal", (F.col("ordinal") % 7 != 0).alias("success"), (F.col("ordinal") % 3 != 0).alias("multiline"))


@query(f"""WITH {_DOCS}, c AS (SELECT doc, count(*) FILTER (kept) AS n_kept, count(*) FILTER (error IS NOT NULL) AS errors, min(working_p) FILTER (kept) AS first_repair FROM jd GROUP BY doc)
SELECT doc, reason, CASE WHEN areason IS NULL THEN off END AS "offset", checked, matches, mismatches, coalesce(n_kept, 0) AS kept, coalesce(errors, 0) AS errors, first_repair,
  CASE WHEN reason IS NOT NULL THEN 'refused' WHEN n_kept > 0 THEN 'repair_required' ELSE 'ready_no_local_overflow' END AS status FROM st LEFT JOIN c USING (doc)""")
def package_local_layout(t: Tables):
    """Which converted documents have lines to split: anchors, offsets and targets from the packages of both versions."""
    source, working = _sides(t)
    return L.local_layout(source, working, _anchors(t), _probes(source), "doc")[0]


@query(f"""WITH {_DOCS} SELECT * FROM jd""")
def package_local_targets(t: Tables):
    source, working = _sides(t)
    return L.local_layout(source, working, _anchors(t), _probes(source), "doc")[1]


def _places(rows: DataFrame, counted: str) -> DataFrame:
    each = rows.where(F.col(counted) > 0).select("doc", "p", F.explode(F.sequence(F.lit(1), F.col(counted).cast("int"))).alias("k"))
    return each.select("doc", "p", F.row_number().over(Window.partitionBy("doc").orderBy("p", "k")).cast("long").alias("ordinal"))


_PLACES = """fo AS (SELECT doc, p, row_number() OVER (PARTITION BY doc ORDER BY p, k) AS ordinal FROM (SELECT doc, p, unnest(range(formulas)) AS k FROM s)),
ob AS (SELECT doc, p, row_number() OVER (PARTITION BY doc ORDER BY p, k) AS ordinal FROM (SELECT doc, p, unnest(range(objects)) AS k FROM w)),
rq AS (SELECT DISTINCT doc, turn + 1 AS ordinal FROM s WHERE p % 3 = 1 AND turn < 9 + doc % 3),
cs AS (SELECT doc, CASE WHEN (SELECT sum(w.formulas) FROM w WHERE w.doc = s.doc) > 0 THEN 'left' WHEN sum(formulas) = (SELECT sum(objects) FROM w WHERE w.doc = s.doc) THEN 'exact' ELSE 'other' END AS state FROM s GROUP BY doc),
pl AS (SELECT rq.doc, rq.ordinal, f.doc IS NOT NULL AS moved, f.areason, fo.p AS source_p, CASE WHEN f.doc IS NOT NULL THEN fo.p + off ELSE ob.p END AS wp, ob.p AS op, wa, state FROM rq LEFT JOIN (SELECT * FROM f WHERE doc % 3 > 0) f USING (doc)
  LEFT JOIN fo ON fo.doc = rq.doc AND fo.ordinal = rq.ordinal LEFT JOIN ob ON ob.doc = rq.doc AND ob.ordinal = rq.ordinal JOIN cs ON cs.doc = rq.doc),
pe AS (SELECT *, CASE WHEN moved AND areason IS NOT NULL THEN areason WHEN source_p IS NULL THEN 'source_ordinal_not_found' WHEN moved AND wp <= wa THEN 'before_anchor'
  WHEN moved AND (SELECT count(*) FROM ob WHERE ob.doc = pl.doc AND ob.p = pl.wp) <> 1 THEN 'not_one_object' WHEN NOT moved AND state <> 'exact' THEN 'counts_not_exact' WHEN NOT moved AND op IS NULL THEN 'working_ordinal_not_found' END AS refusal FROM pl)"""


@query(f"""WITH {_DOCS}, {_PLACES} SELECT doc, ordinal, CASE WHEN moved THEN 'offset' ELSE 'exact_count' END AS mode, source_p, CASE WHEN refusal IS NULL THEN wp END AS working_p, refusal, bool_and(refusal IS NULL) OVER (PARTITION BY doc) AS planned FROM pe""")
def package_local_plan(t: Tables):
    """Plans for requested formulas: by offset where a document has an anchor, else by ordinal where counts are exact."""
    source, working = _sides(t)
    found = L.anchored(source, working, _anchors(t).where("doc % 3 > 0"), "doc")
    requested = _turns(t).where("p % 3 = 1 and turn < 9 + doc % 3").select("doc", (F.col("turn") + 1).alias("ordinal"))
    counts = source.groupBy("doc").agg(F.sum("formulas").alias("raw")).join(working.groupBy("doc").agg(F.sum("objects").alias("converted"), F.sum("formulas").alias("left")), "doc")
    states = counts.select("doc", count_state(F.col("raw"), F.lit(0), F.col("converted"), F.col("left")).alias("state"))
    return L.local_plan(_places(source, "formulas"), _places(working, "objects"), requested, found, states, "doc")


@query(f"""WITH {_DOCS}, v AS (SELECT doc, p + doc % 2 AS p, p AS q, turn, len(x) + CASE WHEN doc % 5 = 3 AND p % 8 = 7 THEN 5 ELSE 0 END AS n, CASE WHEN turn % 12 = 8 THEN 2 ELSE least(formulas, 1) END AS o FROM s),
c AS (SELECT *, o = 1 AND n > 470 AS split FROM v), m AS (SELECT doc, coalesce(min(p) FILTER (split), 1) AS first, sum(o + CASE WHEN split THEN 1 ELSE 0 END) + CASE WHEN doc % 13 = 6 THEN 1 ELSE 0 END AS want, sum(o + CASE WHEN split THEN 1 ELSE 0 END) AS have, bool_or(split) AS splits FROM c GROUP BY doc),
e AS (SELECT doc, CASE WHEN doc % 17 = 9 THEN 'repair_class' END AS r1, CASE WHEN doc % 10 = 1 THEN 'source_missing' END AS r2, CASE WHEN doc % 10 IN (1, 6) THEN 'source_changed' END AS r3, CASE WHEN doc % 9 = 4 THEN 'working_changed' END AS r4,
  CASE WHEN doc % 11 = 5 THEN 'native_left' END AS r6, CASE WHEN want <> have THEN 'object_count' END AS r7, CASE WHEN doc % 6 = 2 AND first > 1 + doc % 2 THEN 'frozen_prefix' END AS r8, CASE WHEN doc % 12 = 7 THEN 'target_outside' END AS r10, CASE WHEN doc % 7 = 4 AND splits THEN 'target_failed' END AS r11 FROM m)
SELECT doc, rule, CAST(list_position(['repair_class', 'source_missing', 'source_changed', 'working_changed', 'paragraph_count', 'native_left', 'object_count', 'frozen_prefix', 'text_changed', 'target_outside', 'target_failed'], rule) AS BIGINT) AS priority
FROM (SELECT doc, unnest([r1, r2, r3, r4, r6, r7, r8, r10, r11]) AS rule FROM e) WHERE rule IS NOT NULL""")
def package_map_validation(t: Tables):
    """The repaired candidate of every document against its map, which names the source it was made from."""
    rows = _facts(t)
    working, candidate = (rows.where(F.col("version") == v).drop("version") for v in ("working", "candidate"))
    split = (F.col("objects") == 1) & (F.col("width") > 470)
    doc = F.col("doc")
    sums = working.groupBy("doc").agg(F.coalesce(F.min(F.when(split, F.col("p"))), F.lit(1)).alias("first_repair"), (F.sum("objects") + F.count_if(split)).alias("objects"))
    maps = sums.select(
        "doc", "first_repair", F.when(doc % 17 == 9, "M1_MULTISIBLING_OMATHPARA").otherwise(L.SPLIT).alias("repair_class"), F.concat(F.lit("source/"), doc.cast("string")).alias("source"), F.lit("AB").alias("source_sha256"),
        F.lit("cd").alias("working_sha256"), F.when(doc % 9 == 4, "ce").otherwise("CD").alias("now_working"), (F.col("objects") + F.when(doc % 13 == 6, 1).otherwise(0)).alias("expected_objects"),
    )
    files = maps.where("doc % 10 <> 1").select(F.col("source").alias("path"), F.when(doc % 10 == 6, "ac").otherwise("ab").alias("sha256"))
    targets = working.where(split).select("doc", "p", F.lit(2).alias("expected_objects"), F.lit(1).alias("expected_breaks"))
    targets = targets.unionByName(maps.where("doc % 12 = 7").select("doc", F.lit(1000000).cast("long").alias("p"), F.lit(2).alias("expected_objects"), F.lit(1).alias("expected_breaks")))
    return L.validated_by_map(maps, files, working, candidate, targets, "doc")
