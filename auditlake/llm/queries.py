"""One query per operator, over the driver's whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import language_id, language_model, sentencepiece_codec, toxicity
from auditlake.llm.conversation_repair import repair
from auditlake.llm.decontamination import decontaminate
from auditlake.llm.license_scan import scan_licences
from auditlake.llm.near_duplicates import near_duplicates
from auditlake.llm.periodic_runs import periodic_runs
from auditlake.llm.quality_rules import COMMON_WORDS, quality_rules
from auditlake.llm.substring_dedup import remove_repeats
from auditlake.llm.url_filter import filter_urls
from auditlake.llm.vector_search import top_k


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; grades are the toxic label, its upper grade split by density."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    graded = _read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.score(docs, toxicity.train(docs, graded, 2, split=True))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i+m-1], ' ') AS k
      FROM (SELECT item_id, ws, least(len(ws), 10) AS m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') AS k FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, l WHERE len(ws) >= m)),
o AS (SELECT doc_id, m, i, item_id FROM g JOIN p USING (m, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (k) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.p) AS kept
      FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT g.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept
FROM g LEFT JOIN n USING (doc_id)
"""

def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_read(spark, sf_dir, "documents").select("doc_id", "text"))


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = TOKENIZER) -> DataFrame:
    return sentencepiece_codec.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), model_path)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_OP6_CLASSES = ["[A-Z]", "[0-9]", r"""[!"''()+,\-./:;=?@\[\\\]^_`{}~]""", r"[^\x00-\x7F]"]
_OP6_WORDS = [w for words in COMMON_WORDS.values() for w in words]


def _op6_divergence(counts: str, total: str) -> str:
    p = f"(h.{counts}[i] / greatest(h.{total}, 1))"
    q = f"(coalesce(r.{counts}, g.{counts})[i] / greatest(coalesce(r.{total}, g.{total}), 1))"
    m = f"(({p} + {q}) / 2)"
    return (
        f"sqrt(greatest(list_sum([CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END"
        f" FOR i IN range(1, len(h.{counts}) + 1)]) / 2, 0))"
    )


OP6_SQL = (
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE '' END AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
x AS (SELECT *, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls,
      ["""
    + ", ".join(f"len(regexp_extract_all(text, '{c}'))" for c in _OP6_CLASSES)
    + r"""] AS rare, ["""
    + ", ".join(f"len([x FOR x IN ws IF x = '{w}'])" for w in _OP6_WORDS)
    + r"""] AS seen FROM w),
h AS (SELECT doc_id, lang, ws, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      list_concat(rare, [word_chars - n_symbols - list_sum(rare), length(text) - word_chars, n_symbols]) AS classes, length(text) AS nc,
      list_concat(seen, [len(ws) - list_sum(seen)]) AS common, len(ws) AS nw FROM x),
e AS (SELECT lang, doc_id, generate_subscripts(common, 1) AS i, unnest(common) AS c FROM h),
f AS (SELECT lang, doc_id, generate_subscripts(classes, 1) AS i, unnest(classes) AS c FROM h),
rw AS (SELECT lang, list(c ORDER BY i) AS common, sum(c) AS nw FROM (SELECT lang, i, sum(c) AS c FROM e GROUP BY ALL) GROUP BY lang),
rc AS (SELECT lang, list(c ORDER BY i) AS classes, sum(c) AS nc FROM (SELECT lang, i, sum(c) AS c FROM f GROUP BY ALL) GROUP BY lang),
r AS (SELECT * FROM rw JOIN rc USING (lang) WHERE lang <> ''),
g AS (SELECT (SELECT list(c ORDER BY i) FROM (SELECT i, sum(c) AS c FROM e GROUP BY i)) AS common, (SELECT sum(c) FROM e) AS nw,
             (SELECT list(c ORDER BY i) FROM (SELECT i, sum(c) AS c FROM f GROUP BY i)) AS classes, (SELECT sum(c) FROM f) AS nc),
v AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM h WHERE len(ws) > 8)),
d AS (SELECT doc_id, k FROM v GROUP BY ALL HAVING count(*) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM v JOIN d USING (doc_id, k)) GROUP BY doc_id),
o AS (SELECT h.doc_id, CAST(h.nw AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
      """
    + _op6_divergence("classes", "nc")
    + " AS cd, "
    + _op6_divergence("common", "nw")
    + r""" AS wd
      FROM h LEFT JOIN r ON r.lang = h.lang CROSS JOIN g LEFT JOIN n ON n.doc_id = h.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (word_chars >= 200 AND cd > 0.22 + 12 / word_chars)
       AND NOT (n_words >= 50 AND wd > sqrt(0.0225 + 3.6 / n_words)) AS kept FROM o
"""
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages are the labels of the documents of the same number: bad where toxic or of low quality."""
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict")


def _op8_level(name: str, parent: str, key: str) -> str:
    return rf"""
{name}_m AS (SELECT 1 / least(0.5, greatest(0.01, CASE WHEN room > 0 THEN (spread - q * (k - 1)) / (q * room) ELSE 0 END)) - 1 AS m FROM
  (SELECT count(*) AS k, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, sum(n * pow(x / n - mu, 2)) AS spread,
          (sum(x) + 1) / (sum(n) + 2) * (1 - (sum(x) + 1) / (sum(n) + 2)) AS q FROM (SELECT {name}.*, p.mean AS mu FROM {name} JOIN {parent} p USING ({key})))),
{name}_r AS (SELECT {name}.*, ({name}.x + m * p.mean) / ({name}.n + m) AS mean, {name}.n + m AS weight FROM {name} JOIN {parent} p USING ({key}) CROSS JOIN {name}_m)"""


_OP8_DOMAIN, _OP8_TLD = "'.' || array_to_string(string_split(host, '.')[-2:], '.')", "string_split(host, '.')[-1]"

OP8_SQL = (
    rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
host AS (SELECT host, {_OP8_DOMAIN} AS domain, {_OP8_TLD} AS tld, CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS x
         FROM u JOIN labels ON labels.doc_id = u.page_id WHERE host <> '' GROUP BY host),
domain AS (SELECT domain, tld, sum(n) AS n, sum(x) AS x FROM host GROUP BY ALL),
tld AS (SELECT tld, 1 AS top, sum(n) AS n, sum(x) AS x FROM domain GROUP BY tld),
world AS (SELECT 1 AS top, (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM tld),"""
    + ",".join((_op8_level("tld", "world", "top"), _op8_level("domain", "tld_r", "tld"), _op8_level("host", "domain_r", "domain")))
    + rf""",
known AS (SELECT h.host, coalesce(r.mean, d.mean, t.mean, w.mean) AS mean, coalesce(r.weight, m.m) AS weight
          FROM (SELECT DISTINCT host, {_OP8_DOMAIN} AS domain, {_OP8_TLD} AS tld FROM u WHERE host <> '') h
          LEFT JOIN host_r r ON r.host = h.host LEFT JOIN domain_r d ON d.domain = h.domain LEFT JOIN tld_r t ON t.tld = h.tld CROSS JOIN world w CROSS JOIN host_m m)
SELECT page_id, u.host, path, CASE
         WHEN ('.' || u.host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN ('.' || u.host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN ('.' || u.host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN ('.' || u.host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN ('.' || u.host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN mean - 1.6448536269514722 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.2 THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN known USING (host)
"""
)

def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return language_model.score(docs, ~held & F.col("doc_id").isNotNull()).withColumn("held_out", held)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.learned_from("doc_id", 5, 0)))
    found = language_id.identify(docs, model)
    return found.withColumn("held_out", F.coalesce(~language_id.learned_from("doc_id", 5, 0), F.lit(False)))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest inner products of every fiftieth vector with all others."""
    return top_k(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e, row_number() OVER () AS n FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with one in four damaged, by crc32 of conversation and turn; a null is one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))[0].withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.select("conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts), *(F.coalesce(c, v).alias(c) for c, v in nothing.items()))


OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
      [CAST(ascii(c) AS BIGINT) FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')] AS b FROM conversations, bits),
f AS (SELECT *, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS f FROM k),
d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p FROM d),
r AS (SELECT conv_id, turn, p, role, text, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair,
      CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM o),
ins(a, b, c, t) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
ed(a, b, c, t, i) AS (VALUES (0, 0, 4, 'D', NULL), (1, 1, 4, 'D', NULL), (2, 2, 4, 'D', NULL), (3, 3, 4, 'D', NULL), (0, 2, 3, 'R', NULL), (1, 2, 3, 'R', NULL), (2, 3, 3, 'R', NULL), (3, 2, 3, 'R', NULL),
      (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a')),
go AS (SELECT ins.a, ed.b, ins.c + ed.c AS c, ins.t || ed.t AS t, ed.t AS e, ed.i FROM ins JOIN ed ON ins.b = ed.a),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, 0 AS s, {'c': CAST(0 AS BIGINT), 't': ''} AS x FROM (SELECT DISTINCT conv_id FROM r)
      UNION ALL
      SELECT w.conv_id, w.p + 1, go.b, min({'c': CAST(w.x.c + go.c + CASE WHEN r.fault = 'truncated' AND go.e <> 'D' THEN 3 ELSE 0 END AS BIGINT), 't': w.x.t || go.t})
      FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.p = w.p + 1 JOIN go ON go.a = w.s AND (go.i IS NULL OR go.i = r.i) AND (go.e = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
      GROUP BY w.conv_id, w.p + 1, go.b),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
b AS (SELECT n.*, x.c AS cost, x.t AS audit FROM n JOIN (SELECT w.conv_id, w.p, min({'c': w.x.c + ins.c, 't': w.x.t || ins.t}) AS x FROM w JOIN ins ON ins.a = w.s AND ins.b IN (0, 3) GROUP BY ALL) z
      ON z.conv_id IS NOT DISTINCT FROM n.conv_id AND z.p = n.n),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS q FROM b WHERE audit <> ''),
m AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY q) AS p FROM l),
g AS (SELECT m.conv_id, m.q, m.e, r.role, CASE WHEN m.e = 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.q) AS nth,
      first_value(m.e = 'K' AND r.i = 's') OVER (PARTITION BY m.conv_id ORDER BY m.q) AS s FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.p = m.p AND m.e <> 'I' WHERE m.e <> 'D'),
h AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - CASE WHEN s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY q) AS text FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(h.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_SPACE_WORD = r"[^\x20\x09-\x0D]+"


def with_period(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, by crc32 of the id, repeat a stretch from some word on to their end; others stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(_SPACE_WORD), F.lit(0))))
    n = F.size("_words").cast("bigint")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    start, period, rest = a.cast("int"), p.cast("int"), (n - a).cast("int")
    unit = F.slice("_words", start + 1, period)
    repeated = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / period).cast("int"))), F.lit(1), rest)
    text = F.when(n > 0, F.array_join(F.concat(F.slice("_words", F.lit(1), start), repeated), " ")).otherwise(F.col("text"))
    return cut.withColumn("text", F.when(F.col("_words").isNotNull(), text).otherwise(F.col("text"))).select(*docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_period(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs come by start, then period, so the first of equal quotients is the one that ties ask for
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x),
    )
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        found.withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("bigint").alias("n_runs"),
            "best.start",
            "best.length",
            "best.period",
            F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
            F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
        )
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scans": op4_license_scans,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_vector_search": op11_vector_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op6_quality_rules": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_vector_search": OP11_SQL, "op12_conversation_repair": OP12_SQL}
