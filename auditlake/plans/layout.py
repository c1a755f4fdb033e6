"""Geometry, grouping and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import compare
from auditlake.operators import geometry as G
from auditlake.operators import rules as R
from auditlake.plans.registry import Tables, query

_PAIRS_SQL = """w AS (SELECT l_orderkey, l_linenumber, p_brand, p_retailprice AS source_width, l_extendedprice / l_quantity AS final_width, l_returnflag <> 'N' AS reliable FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT *, CASE WHEN reliable AND source_width > 4 THEN final_width / source_width END AS ratio FROM w),
o AS (SELECT * FROM r WHERE ratio > 0.1 AND ratio < 10),
c AS (SELECT p_brand, median(ratio) AS center, count(*) AS n FROM o GROUP BY p_brand HAVING count(*) >= 3),
m AS (SELECT p_brand, any_value(center) AS center, any_value(n) AS n, median(abs(ratio - center)) AS mad FROM o JOIN c USING (p_brand) GROUP BY p_brand),
t AS (SELECT r.*, center, mad, greatest(0.04, 5 * mad) AS band, coalesce(abs(ratio - center) > greatest(0.04, 5 * mad), false) AS outlier FROM r LEFT JOIN m USING (p_brand))"""


def _outliers(t: Tables):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", "p_brand", F.col("p_retailprice").alias("source_width"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("final_width"), (F.col("l_returnflag") != "N").alias("reliable")
    )
    return G.width_outliers(rows, ["p_brand"])


@query(f"WITH {_PAIRS_SQL} SELECT l_orderkey, l_linenumber, round(ratio, 6) AS ratio, round(center, 6) AS center, round(mad, 6) AS mad, round(band, 6) AS band, outlier FROM t")
def median_mad_outlier(t: Tables):
    return _outliers(t).select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("ratio", "center", "mad", "band")), "outlier")


@query(f"""WITH {_PAIRS_SQL} SELECT l_orderkey, l_linenumber, round(source_width * center / final_width, 6) AS scale, CAST(round_even(source_width * center * 20, 0) AS BIGINT) AS twips
FROM t WHERE outlier AND source_width * center / final_width BETWEEN 0.25 AND 4""")
def calibration_plan(t: Tables):
    return G.calibration(_outliers(t)).select("l_orderkey", "l_linenumber", F.round("scale", 6).alias("scale"), "twips")


_LINES_SQL = """RECURSIVE e AS (SELECT user_id, event_id, ts, value AS y, event_type = 'error' AS multi, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, event_id, n, y, multi, CASE WHEN multi THEN NULL ELSE y END AS anchor, CAST(1 AS BIGINT) AS grp FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.y, e.multi, CASE WHEN e.multi THEN NULL WHEN abs(e.y - g.anchor) <= 20 THEN g.anchor ELSE e.y END,
    CASE WHEN NOT e.multi AND coalesce(abs(e.y - g.anchor) <= 20, false) THEN g.grp ELSE g.grp + 1 END FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)"""


def _lines(t: Tables):
    rows = t.events.withColumn("multi", F.col("event_type") == "error")
    return G.same_line_groups(rows, ["user_id"], ["ts", "event_id"], "value", tolerance=20.0, multi="multi")


@query(f"WITH {_LINES_SQL} SELECT user_id, event_id, grp AS line_group FROM g WHERE NOT multi")
def same_line_groups(t: Tables):
    return _lines(t).select("user_id", "event_id", "line_group")


@query(f"""WITH {_LINES_SQL}, f AS (SELECT event_id, value * (1 + event_id % 3) AS final_y, event_id // 100 AS final_page FROM events WHERE event_id % 11 <> 0),
b AS (SELECT user_id, grp AS line_group, count(*) AS members, count(*) FILTER (WHERE final_y IS NULL) AS missing, count(DISTINCT final_page) AS pages, max(y) - min(y) AS ss, max(final_y) - min(final_y) AS fs
  FROM g LEFT JOIN f USING (event_id) WHERE NOT multi GROUP BY ALL)
SELECT user_id, line_group, members, missing, pages, missing > 0 OR pages > 1 OR coalesce(fs > greatest(2, ss + 1.5), false) AS broken FROM b WHERE members >= 2""")
def same_line_breaks(t: Tables):
    final = t.events.where("event_id % 11 <> 0").select("user_id", "event_id", (F.col("value") * (1 + F.col("event_id") % 3)).alias("final_y"), F.floor(F.col("event_id") / 100).alias("final_page"))
    return G.line_breaks(_lines(t).withColumnRenamed("value", "y"), final, ["user_id"], "event_id").select("user_id", "line_group", "members", "missing", "pages", "broken")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag <> 'A' THEN l_quantity * 8 + l_tax * 1000 - 440 END, 6) AS overflow,
  coalesce(CASE WHEN l_returnflag <> 'A' THEN l_quantity * 8 + l_tax * 1000 - 440 END > 2.0, false) AS flagged FROM lineitem""")
def right_overflow(t: Tables):
    over = G.right_overflow(F.col("l_quantity") * 8, F.col("l_tax") * 1000, F.lit(440), F.col("l_returnflag") != "A")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(over, 6).alias("overflow"), R.holds(over > G.OVERFLOW).alias("flagged"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, count(*) AS n, max(CASE WHEN l_tax > 0.05 THEN 2 ELSE 1 END) AS c, max(l_quantity) * 20 AS w FROM lineitem GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey AS doc_id, round(o_totalprice / 500, 6) AS width FROM orders JOIN s ON doc_id = o_orderkey WHERE c = 1 AND o_orderstatus <> 'P' AND o_totalprice / 500 > w + 2""")
def overwide_static(t: Tables):
    sections = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_tax") > 0.05, 2).otherwise(1).alias("columns"), (F.col("l_quantity") * 20).alias("text_width"))
    objects = t.orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 500).alias("width"), (F.col("o_orderstatus") != "P").alias("direct_body"))
    return G.overwide(objects, sections).select("doc_id", F.round("width", 6).alias("width"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars % 40 <= 10 AND length(regexp_replace(text, '\\s', '', 'g')) > 1")
def tiny_shell(t: Tables):
    """Objects of almost no width whose source has more than one character."""
    compact = F.regexp_replace("text", r"[\t\n\f\r ]", "")
    return t.documents.where((F.col("n_chars") % 40 <= G.TINY_WIDTH) & (F.length(compact) > 1)).select("doc_id", "n_chars")


@query("""WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority = '1-URGENT' AND abs(x - o_totalprice) > 3000 AS drifts FROM orders JOIN s ON k = o_orderkey""")
def center_drift(t: Tables):
    final = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("x"))
    alignment = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    return t.orders.join(final, "o_orderkey").select("o_orderkey", G.centre_drift(F.col("o_totalprice"), F.col("x"), alignment, 3000.0).alias("drifts"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS before, l_linestatus AS after FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_returnflag <> l_linestatus")
def alignment_breaks(t: Tables):
    return t.lineitem.where("l_returnflag <> l_linestatus").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("before"), F.col("l_linestatus").alias("after"))


@query("""WITH r AS (SELECT l_orderkey, l_discount / (l_tax + 0.01) AS ratio, CASE WHEN l_linestatus = 'O' THEN l_quantity END AS pos FROM lineitem)
SELECT l_orderkey, round(max(ratio), 6) AS max_ratio, count(*) AS members, CASE WHEN count(pos) >= 2 THEN max(pos) - min(pos) ELSE 0.0 END AS spread FROM r GROUP BY 1 HAVING max(ratio) > 0.70""")
def baseline_group_spread(t: Tables):
    rows = t.lineitem.withColumn("pos", F.when(F.col("l_linestatus") == "O", F.col("l_quantity")))
    out = G.baseline_groups(rows, ["l_orderkey"], F.col("l_discount") / (F.col("l_tax") + 0.01), "pos", ["l_linenumber"])
    return out.withColumn("max_ratio", F.round("max_ratio", 6))


@query("""WITH e AS (SELECT user_id AS run_id, event_id AS batch, CAST(json_extract(props, '$.k') AS BIGINT) AS converted, value AS seconds, value / 10 AS save_seconds FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seconds DESC, batch) AS rank FROM e)
SELECT run_id, CAST(sum(converted) AS BIGINT) AS converted, round(sum(seconds), 6) AS macro_seconds, round(sum(save_seconds), 6) AS save_seconds, round(coalesce(sum(seconds) / nullif(sum(seconds) + sum(save_seconds), 0), 0), 6) AS macro_share,
  round(sum(seconds) / nullif(sum(converted), 0), 6) AS seconds_per_item, string_agg(batch, ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS slowest FROM r GROUP BY run_id""")
def perf_summary_topk(t: Tables):
    batches = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("batch"), F.get_json_object("props", "$.k").cast("long").alias("converted"), F.col("value").alias("seconds"), (F.col("value") / 10).alias("save_seconds"))
    return R.performance_summary(batches).select("run_id", "converted", *(F.round(c, 6).alias(c) for c in ("macro_seconds", "save_seconds", "macro_share", "seconds_per_item")), "slowest")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_tax <= 0.05 AS same, l_quantity AS x, l_quantity + l_discount * 100 - 2 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN same AND e >= x THEN e - x END, 6) AS width, coalesce(CASE WHEN same AND e >= x THEN e - x END > 0.5, false) AS reliable FROM v""")
def visual_width(t: Tables):
    """Both ends on one line, and the end not before the begin."""
    end_y = F.when(F.col("l_tax") <= 0.05, 0.0).otherwise(2.0)
    w = G.visual_width(F.lit(1), F.lit(1), F.lit(0.0), end_y, F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount") * 100 - 2)
    return t.lineitem.select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", F.round("w.width", 6).alias("width"), "w.reliable")


@query("""SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity / nullif(l_linenumber, 0) > 2.8 THEN 'too_tall' END, CASE WHEN l_extendedprice / 100 > 520 THEN 'too_wide' END, CASE WHEN l_returnflag = 'R' THEN 'suspicious_preview' END], lambda x: x IS NOT NULL) AS flags FROM lineitem""")
def anomaly_flags(t: Tables):
    flags = G.anomaly_flags(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_extendedprice") / 100, F.col("l_returnflag") == "R")
    return t.lineitem.select("l_orderkey", "l_linenumber", flags.alias("flags"))


@query("""SELECT l_orderkey, l_linenumber, CAST(trunc(greatest(l_quantity - 6, 0.0) * 1.5) AS BIGINT) AS box_left, CAST(trunc(least(l_quantity + 50 + 6, 90.0) * 1.5) AS BIGINT) AS box_right FROM lineitem""")
def crop_boxes(t: Tables):
    box = G.crop_box(F.col("l_quantity"), F.lit(0.0), F.lit(50.0), F.lit(10.0), F.lit(1.5), F.lit(90.0), F.lit(800.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", F.col("b.left").cast("long").alias("box_left"), F.col("b.right").cast("long").alias("box_right"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_id // 2000 AS page, CAST(floor(value / 50) AS BIGINT) AS y FROM events),
l AS (SELECT *, lag(page) OVER w AS bp, lag(y) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, CASE WHEN bp IS NULL OR page <> bp OR y <> b THEN 1 ELSE 0 END AS new, CASE WHEN page < bp OR page = bp AND y < b THEN 1 ELSE 0 END AS back FROM l)
SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS line, sum(back) OVER (PARTITION BY user_id) = 0 AS monotone FROM f""")
def line_segments(t: Tables):
    points = t.events.select("user_id", "event_id", F.floor(F.col("event_id") / 2000).alias("page"), F.floor(F.col("value") / 50).alias("y"))
    return G.line_segments(points, ["user_id"], "event_id").select("user_id", "event_id", F.col("line").cast("long").alias("line"), "monotone")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'table_cell' WHEN l_tax > 0.06 THEN 'multi_column' WHEN l_quantity <= 10 THEN 'empty_width' END AS reason,
  CASE WHEN NOT (l_returnflag = 'A' OR l_tax > 0.06 OR l_quantity <= 10) THEN l_quantity END AS text_right FROM lineitem""")
def text_bounds(t: Tables):
    b = G.text_bounds(F.lit(10.0), F.col("l_quantity"), F.col("l_returnflag") == "A", F.when(F.col("l_tax") > 0.06, 2).otherwise(1))
    return t.lineitem.select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", "b.reason", F.col("b.right").alias("text_right"))


@query("""WITH c AS (SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS a, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS b)
SELECT o_orderkey, round(x / o_totalprice, 6) AS ratio FROM (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS x FROM lineitem GROUP BY 1) JOIN (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) o USING (o_orderkey) WHERE (SELECT a = b FROM c)""")
def ordinal_pair_join(t: Tables):
    """Orders with lines and their sums as the two sides, paired by ordinal where both have as many."""
    final = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("x"))
    with_lines = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    return compare.ordinal_pairs(with_lines, final, "o_orderkey").select("o_orderkey", F.round(F.col("x") / F.col("o_totalprice"), 6).alias("ratio"))
