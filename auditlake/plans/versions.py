"""Numbering, duplicates and comparisons of two versions.

The candidate version of a document is derived: where its number is divisible by 50, words
"the" become "THE" in every third paragraph and, where divisible by 100, a paragraph is added.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import compare, duplicates, numbering
from auditlake.plans.registry import Tables, dealt_by, query, tasks_for

P_SQL = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS plain, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)"
C_SQL = """c AS (SELECT doc_id, p, CASE WHEN doc_id % 50 = 0 AND p % 3 = 0 THEN replace(plain, 'the', 'THE') ELSE plain END AS plain FROM p
  UNION ALL SELECT doc_id, max(p) + 1, 'added' FROM p WHERE doc_id % 100 = 0 GROUP BY doc_id)"""


def candidate(t: Tables):
    source = compare.paragraphs(t.documents)
    changed = source.withColumn("plain", F.when((F.col("doc_id") % 50 == 0) & (F.col("p") % 3 == 0), F.replace("plain", F.lit("the"), F.lit("THE"))).otherwise(F.col("plain")))
    added = source.where("doc_id % 100 = 0").groupBy("doc_id").agg((F.max("p") + 1).alias("p")).withColumn("plain", F.lit("added"))
    return source, changed.unionByName(added)


@query(f"WITH {P_SQL}, {C_SQL}, " + """b AS (SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, p.plain AS a, c.plain AS b FROM p FULL JOIN c ON p.doc_id = c.doc_id AND p.p = c.p),
g AS (SELECT doc_id, count(a) AS source_paragraphs, count(b) AS candidate_paragraphs, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS differences FROM b GROUP BY doc_id)
SELECT *, source_paragraphs = candidate_paragraphs AS paragraph_count_equal, CASE WHEN differences = 0 THEN 'exact' WHEN candidate_paragraphs < source_paragraphs THEN 'unexpected_loss'
  WHEN candidate_paragraphs > source_paragraphs THEN 'unexpected_excess' ELSE 'content_drift' END AS state FROM g""")
def content_gate(t: Tables):
    return compare.content_gate(*candidate(t))


@query(f"WITH {P_SQL}, {C_SQL}, " + """b AS (SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, coalesce(p.p, c.p) AS p, p.plain AS a, c.plain AS b FROM p FULL JOIN c ON p.doc_id = c.doc_id AND p.p = c.p)
SELECT doc_id, p, left(coalesce(a, '<MISSING>'), 180) AS a, left(coalesce(b, '<MISSING>'), 180) AS b FROM b WHERE a IS DISTINCT FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) <= 60""")
def positional_diff_topk(t: Tables):
    return compare.positional_diff(*candidate(t))


@query("SELECT l_orderkey AS doc, count(*) AS objects, count(*) FILTER (WHERE l_returnflag = 'R') AS converted, count(*) FILTER (WHERE l_linestatus = 'O') AS native FROM lineitem GROUP BY 1")
def scan_inventory_counts(t: Tables):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.count("*").alias("objects"), F.count_if(F.col("l_returnflag") == "R").alias("converted"), F.count_if(F.col("l_linestatus") == "O").alias("native"))


@query("""SELECT l_suppkey AS doc, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS global_ordinal,
  row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey) AS local_ordinal FROM lineitem""")
def ordinal_global_local(t: Tables):
    rows = t.lineitem.select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_linenumber", "l_partkey")
    rows = numbering.ordinal(rows, ["doc"], ["l_orderkey", "l_linenumber", "l_partkey"], "global_ordinal")
    return numbering.ordinal(rows, ["doc", "l_orderkey"], ["l_linenumber", "l_partkey"], "local_ordinal")


@query(f"WITH {P_SQL} SELECT doc_id, p, plain FROM p")
def paragraph_split(t: Tables):
    return compare.paragraphs(t.documents)


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run_start FROM conversations")
def run_offset_prefix_sum(t: Tables):
    return numbering.offsets(t.conversations, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "run_start")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS occurrence FROM documents")
def same_text_occurrence(t: Tables):
    return numbering.occurrence(t.documents, ["lang"], "text", ["doc_id"]).select("doc_id", "occurrence")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS template, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def exact_duplicate_groups(t: Tables):
    return duplicates.templates(t.documents, "text", "doc_id")


@query("""SELECT doc_id, template, format('AXD{:05d}', row_number() OVER (PARTITION BY template ORDER BY doc_id) - 1) AS marker
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS template FROM documents) QUALIFY doc_id <> template""")
def dedup_template_index(t: Tables):
    groups = duplicates.templates(t.documents, "text", "doc_id").where("copies > 1")
    numbered = numbering.ordinal(groups, ["template"], ["doc_id"], "n").where("doc_id <> template")
    return numbered.select("doc_id", "template", F.format_string("AXD%05d", F.col("n") - 1).alias("marker"))


@query("SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_contents, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE n > 1) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def dedup_summary(t: Tables):
    return duplicates.duplicate_summary(t.documents, "text")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, sum(n - 1) >= 64 AS allowed FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def dedup_gate(t: Tables):
    return duplicates.worth_caching(duplicates.duplicate_summary(t.documents, "text"))


@query("SELECT doc_id, length(text) AS restored_length, sha256(text) AS digest, true AS identical FROM documents")
def dedup_restore_roundtrip(t: Tables):
    """Process each distinct text once, restore to all copies, prove that nothing moved."""
    done = duplicates.once_each(t.documents.select("doc_id", "text"), "text", lambda d: d.withColumn("restored", F.col("text")))
    return done.select("doc_id", F.length("restored").cast("long").alias("restored_length"), F.sha2("restored", 256).alias("digest"), (F.col("restored") == F.col("text")).alias("identical"))


@query("SELECT target, list(doc_id ORDER BY doc_id) AS keys, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS target, doc_id FROM documents) GROUP BY target HAVING count(*) > 1")
def inverse_index_shared(t: Tables):
    return duplicates.shared_targets(t.documents.select(F.sha2("text", 256).alias("target"), "doc_id"), "target", "doc_id")


@query("""WITH o AS (SELECT o_orderkey AS doc, 4 AS total FROM orders), f AS (SELECT l_orderkey AS doc, l_linenumber AS ordinal FROM lineitem),
e AS (SELECT doc, unnest(range(1, total + 1)) AS ordinal FROM o)
SELECT DISTINCT doc, CAST(ordinal AS BIGINT) AS ordinal, 'missing' AS kind FROM e ANTI JOIN f USING (doc, ordinal) UNION ALL SELECT DISTINCT doc, CAST(ordinal AS BIGINT), 'extra' FROM f ANTI JOIN e USING (doc, ordinal)""")
def coverage_two_way(t: Tables):
    """Every order should have exactly the line numbers 1 to 4."""
    expected = t.orders.select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("ordinal"))
    found = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("ordinal"))
    return compare.two_way_coverage(expected, found, ["doc", "ordinal"], tasks_for(4 * t.orders.count() + t.lineitem.count()))


@query("""WITH e AS (SELECT l_returnflag AS map_id, l_suppkey AS target, unnest([l_orderkey, l_orderkey + l_linenumber]) AS ordinal FROM lineitem)
SELECT map_id, ordinal, count(*) AS owners, count(DISTINCT target) AS targets FROM e GROUP BY map_id, ordinal HAVING count(*) > 1""")
def single_owner_violations(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("map_id"), F.col("l_suppkey").alias("target"), F.array(F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_linenumber")).alias("ordinals"))
    return compare.several_owners(rows, ["map_id"], tasks=tasks_for(2 * t.lineitem.count()))


@query("SELECT l_orderkey, count(*) = max(l_linenumber) AND count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) >= 1 AS complete FROM lineitem GROUP BY 1")
def ordinal_completeness(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    return numbering.complete(dealt_by(rows, ["l_orderkey"], tasks_for(t.lineitem.count())), ["l_orderkey"], "l_linenumber")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def mapped_text_in_order(t: Tables):
    rows = t.conversations.withColumnRenamed("turn", "ordinal")
    targets = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))
    return compare.assembled(targets, rows.select("conv_id", "ordinal", "text"), "conv_id", ["conv_id"])


@query("""WITH a AS (SELECT conv_id, turn AS p, text AS plain FROM conversations), b AS (SELECT conv_id, turn + 2 AS p, text AS plain FROM conversations),
j AS (SELECT b.conv_id, a.plain AS a, b.plain AS b FROM b LEFT JOIN a ON a.conv_id = b.conv_id AND a.p = b.p - 2),
g AS (SELECT conv_id, count(*) FILTER (WHERE a IS NOT NULL AND length(b) >= 4) AS checked, count(*) FILTER (WHERE a IS NOT NULL AND length(b) >= 4 AND a <> b) AS mismatches, count(*) FILTER (WHERE a IS NULL) AS out_of_range FROM j GROUP BY conv_id)
SELECT *, checked >= 5 AND mismatches = 0 AS stable FROM g""")
def offset_join_stability(t: Tables):
    source = t.conversations.select("conv_id", F.col("turn").alias("p"), F.col("text").alias("plain"))
    return compare.offset_stability(source, source.withColumn("p", F.col("p") + 2), F.lit(2), "conv_id")


@query(f"WITH {P_SQL}, " + """n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), a AS (SELECT doc_id, plain AS anchor FROM p JOIN n USING (doc_id) WHERE p = doc_id % n + 1 AND plain <> '')
SELECT a.doc_id, anchor, count(p.plain) FILTER (WHERE contains(p.plain, anchor)) AS hits, CASE WHEN count(*) FILTER (WHERE contains(p.plain, anchor)) = 1 THEN min(p.p) FILTER (WHERE contains(p.plain, anchor)) END AS p
FROM a LEFT JOIN p ON p.doc_id = a.doc_id GROUP BY a.doc_id, anchor""")
def unique_anchor(t: Tables):
    rows = compare.paragraphs(t.documents)
    # a whole paragraph of each document, any of its paragraphs
    numbers = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    anchors = rows.join(numbers, "doc_id").where("p = doc_id % n + 1 and plain <> ''").select("doc_id", F.col("plain").alias("anchor"))
    return compare.unique_anchor(anchors, rows, "doc_id")


@query("SELECT coalesce(a, b) AS page, a IS NOT NULL AS in_one, b IS NOT NULL AS in_two FROM (SELECT DISTINCT n_nationkey AS a FROM nation) FULL JOIN (SELECT DISTINCT s_nationkey + 5 AS b FROM supplier) ON a = b")
def page_union_flags(t: Tables):
    return compare.union_flags(t.nation.select(F.col("n_nationkey").alias("page")), t.supplier.select((F.col("s_nationkey") + 5).alias("page")), "page")


@query("""SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0
  AND (SELECT count(*) FROM region) > 0 AS same_pages""")
def page_set_equality(t: Tables):
    flags = compare.union_flags(t.nation.select(F.col("n_regionkey").alias("k")), t.region.select(F.col("r_regionkey").alias("k")), "k")
    return flags.agg((F.coalesce(F.bool_and(F.col("in_one") & F.col("in_two")), F.lit(True)) & (F.count("*") > 0)).alias("same_pages"))


@query(f"WITH {P_SQL}, {C_SQL}, " + """f AS (SELECT doc_id, count(*) // 2 + 2 AS first FROM p GROUP BY doc_id),
b AS (SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, coalesce(p.p, c.p) AS p, p.plain AS a, c.plain AS b FROM p FULL JOIN c ON p.doc_id = c.doc_id AND p.p = c.p)
SELECT doc_id, p FROM b JOIN f USING (doc_id) WHERE p < first AND a IS DISTINCT FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) <= 20""")
def frozen_prefix_signature(t: Tables):
    source, changed = candidate(t)
    first = source.groupBy("doc_id").agg((F.floor(F.count("*") / 2) + 2).alias("first"))
    fields = ["plain"]
    return compare.frozen_prefix(source, changed, first, fields)


@query("""WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS section, l_returnflag AS v FROM lineitem), b AS (SELECT l_orderkey AS doc, l_linenumber AS section, CASE WHEN l_quantity > 49 THEN 'X' ELSE l_returnflag END AS v FROM lineitem WHERE l_discount < 0.1)
SELECT coalesce(a.doc, b.doc) AS doc, bool_and(a.doc IS NOT NULL AND b.doc IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v) AS equal, count(a.doc) AS sections_one, count(b.doc) AS sections_two
FROM a FULL JOIN b ON a.doc = b.doc AND a.section = b.section GROUP BY 1""")
def section_equality(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section"), F.col("l_returnflag").alias("v"), "l_quantity", "l_discount")
    changed = rows.where("l_discount < 0.1").withColumn("v", F.when(F.col("l_quantity") > 49, "X").otherwise(F.col("v")))
    return compare.section_equality(rows, changed, "doc", "section", "v")


@query("""SELECT event_id, user_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS depth FROM (
  SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)""")
def clamped_depth_exclusion(t: Tables):
    """Fields open and close; text at depth above zero is left alone."""
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return numbering.clamped_depth(t.events, ["user_id"], ["ts", "event_id"], step).select("event_id", "user_id", "depth")


@query("""SELECT o_custkey, o_orderkey, coalesce(top, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS new_id FROM orders
LEFT JOIN (SELECT l_suppkey AS o_custkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) USING (o_custkey)""")
def id_allocation(t: Tables):
    existing = t.lineitem.select(F.col("l_suppkey").alias("o_custkey"), F.col("l_linenumber").cast("long").alias("id"))
    return numbering.allocated(t.orders.select("o_custkey", "o_orderkey"), existing, "o_custkey", ["o_orderkey"])


@query("SELECT user_id, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS increase, CAST(count(*) + sum(greatest(n - 1, 0)) AS BIGINT) AS expected_final, min(event_id) FILTER (WHERE n > 1) AS first_repair FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS n FROM events) GROUP BY user_id")
def expected_increase(t: Tables):
    n = F.get_json_object("props", "$.k").cast("long") % 3
    more = F.greatest(F.col("n") - 1, F.lit(0))
    return t.events.withColumn("n", n).groupBy("user_id").agg(F.sum(more).alias("increase"), (F.count("*") + F.sum(more)).alias("expected_final"), F.min(F.when(F.col("n") > 1, F.col("event_id"))).alias("first_repair"))


@query("""SELECT package, part_name, a.h AS before, b.h AS after FROM (SELECT source AS package, CAST(doc_id AS VARCHAR) AS part_name, sha256(text) AS h FROM documents) a
FULL JOIN (SELECT source AS package, CAST(doc_id AS VARCHAR) AS part_name, sha256(CASE WHEN doc_id % 50 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 97 <> 1) b USING (package, part_name) WHERE a.h IS DISTINCT FROM b.h""")
def changed_parts(t: Tables):
    """Documents as the parts of their source."""
    from auditlake.sources.packages import changed_parts as differ

    name = [F.col("source").alias("package"), F.col("doc_id").cast("string").alias("part_name")]
    one = t.documents.select(*name, F.sha2("text", 256).alias("part_sha256"))
    two = t.documents.where("doc_id % 97 <> 1").select(*name, F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("part_sha256"))
    return differ(one, two, ["package"])
