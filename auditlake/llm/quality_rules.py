"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared
with those of its language (pooled over all documents of that language) by the
Jensen-Shannon distance: the square root of the divergence to base 2, from 0 to 1.  Short
texts are not judged by a histogram that they cannot fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm._frames import checked_name

# Languages with a reference of their own, and common words of each.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in"),
    "fr": ("de", "la", "le", "et", "les", "des"),
    "de": ("der", "die", "und", "den", "von", "zu"),
    "es": ("el", "que", "en", "y", "los", "se"),
}
_WORDS = tuple(w for words in COMMON_WORDS.values() for w in words)
_SPACES = r"[\x20\x09-\x0D]+"
_P = "__quality_"

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _histograms(docs: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    """Adds the words and both histograms (arrays of counts), and the language whose reference holds."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lang = F.col(f"`{lang_col}`") if lang_col else F.lit(None).cast("string")
    out = docs.withColumn(f"{_P}lang", F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("")))
    out = out.withColumn(f"{_P}words", F.filter(F.split(text, _SPACES), lambda w: w != ""))
    out = out.withColumn(f"{_P}chars", F.length(F.array_join(f"{_P}words", "")).cast("long"))
    listed = F.filter(f"{_P}words", lambda w: w.isin(*_WORDS))
    out = out.withColumn(f"{_P}joined", F.concat(F.lit(" "), F.array_join(listed, "  "), F.lit(" ")))
    out = out.withColumn(f"{_P}symbols", _count(text, "[#*$%&|<>]"))
    upper, digits, other = _count(text, "[A-Z]"), _count(text, "[0-9]"), _count(text, r"[^\x00-\x7F]")
    marks = _count(text, r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]""")
    out = out.withColumn(f"{_P}rare", F.array(upper, digits, marks, other))
    rest = F.col(f"{_P}chars") - F.col(f"{_P}symbols") - F.aggregate(f"{_P}rare", F.lit(0).cast("long"), lambda a, x: a + x)
    spaces = F.length(text).cast("long") - F.col(f"{_P}chars")
    out = out.withColumn(f"{_P}classes", F.concat(f"{_P}rare", F.array(rest, spaces, F.col(f"{_P}symbols"))))
    joined = F.col(f"{_P}joined")
    size = F.octet_length(joined)
    common = [((size - F.octet_length(F.replace(joined, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in _WORDS]
    out = out.withColumn(f"{_P}common", F.array(*common))
    some = F.aggregate(f"{_P}common", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn(f"{_P}common", F.concat(f"{_P}common", F.array(F.size(f"{_P}words").cast("long") - some)))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Pooled shares of character classes and common words, by language and (under "") over all documents.

    At most one row per language of ``COMMON_WORDS`` and one for all others reach the driver.
    """
    classes, common = 7, len(_WORDS) + 1
    slim = docs.select(*{c for c in (text_col, lang_col) if c})
    sums = [F.sum(F.col(f"{_P}classes")[i]).alias(f"c{i}") for i in range(classes)] + [F.sum(F.col(f"{_P}common")[i]).alias(f"w{i}") for i in range(common)]
    rows = _histograms(slim, text_col, lang_col).groupBy(f"{_P}lang").agg(*sums).collect()
    counts = {r[0]: [list(r[1 : 1 + classes]), list(r[1 + classes :])] for r in rows}
    counts[""] = [[sum(x) for x in zip(*(c[k] for c in counts.values()), strict=True)] or [0] * n for k, n in enumerate((classes, common))]
    return {lang: tuple([x / max(1, sum(h)) for x in h] for h in both) for lang, both in counts.items()}


def _distance(counts: Column, shares: Column) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))

    def term(x: Column, q: Column) -> Column:
        p = x / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _doubled(held: Column, half: int) -> Column:
    return F.transform(held, lambda h, i: F.xxhash64(h, F.get(held, i + half)))


def _with_repeats(docs: DataFrame, window: int) -> DataFrame:
    """Adds the number of words in windows of ``window`` words that are found twice or more in the text, the first included; ``window`` is a power of two.

    Each array that a lambda reads is a column of its own, read there more than once, so that
    the optimizer keeps it and does not compute it anew for every element.
    """
    runs, order = (F.col(f"{_P}{x}") for x in ("runs", "order"))
    none = F.array().cast("array<bigint>")
    docs = docs.withColumn(f"{_P}run1", F.transform(f"{_P}words", lambda w: F.xxhash64(w)))
    width = 1
    while width < window:  # the hash of a run is that of the hashes of its halves
        docs = docs.withColumn(f"{_P}run{2 * width}", _doubled(F.col(f"{_P}run{width}"), width))
        width *= 2
    found = F.slice(F.col(f"{_P}run{window}"), F.lit(1), F.greatest(F.size(f"{_P}words") - (window - 1), F.lit(0)))
    docs = docs.withColumn(f"{_P}runs", F.when(F.size(f"{_P}words") > window, found).otherwise(none))
    again = F.size(F.array_distinct(runs)) < F.size(runs)
    docs = docs.withColumn(f"{_P}order", F.when(again, F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.transform(order, lambda e, i: F.when((F.get(order, i - 1)["h"] == e["h"]) | (F.get(order, i + 1)["h"] == e["h"]), e["i"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    held = F.array_sort(F.filter(same, lambda x: x.isNotNull()))
    n = F.aggregate(held, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")), lambda a: a["n"])
    return docs.withColumn(f"{_P}repeats", F.coalesce(n, F.lit(0)).cast("long"))


def quality_rules(
    docs: DataFrame, references: dict | None = None, text_col: str = "text", lang_col: str | None = "lang",
    max_char_distance: float = 0.22, max_word_distance: float = 0.15, min_chars: int = 200, min_words: int = 50,
) -> DataFrame:
    """Judge every document; all columns of ``docs`` and those of ``RESULTS`` are returned.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in 8-word windows that
    repeat.  ``kept``: not base_failed, and neither distance above its limit, where the text has
    ``min_chars`` word characters and ``min_words`` words at least.  A histogram of n entries strays
    from its source by chance, so the limits are ``max_char_distance + 12 / word_chars`` and
    ``sqrt(max_word_distance ** 2 + 3.6 / n_words)``.  ``references`` defaults to
    those of ``docs`` itself.

    Defined cases: a null text counts as an empty one (base_failed); a null or unlisted language
    is compared with the histogram of all documents; same-named input columns are replaced;
    repeated rows get the same result; an empty table gives an empty one.
    """
    checked_name(docs, text_col, *([lang_col] if lang_col else []))
    references = language_references(docs, text_col, lang_col) if references is None else references
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = [c for c in docs.columns if c not in RESULTS or c in (text_col, lang_col)]
    out = _histograms(docs.select(*(f"`{c}`" for c in names)), text_col, lang_col)

    def reference(k: int) -> Column:
        found = F.array(*(F.lit(float(x)) for x in references[""][k]))
        for lang in COMMON_WORDS:
            if lang in references:
                found = F.when(F.col(f"{_P}lang") == lang, F.array(*(F.lit(float(x)) for x in references[lang][k]))).otherwise(found)
        return found

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = _with_repeats(out.withColumn(f"{_P}lines", lines), 8)
    out = out.select(
        *(f"`{c}`" for c in names),
        F.size(f"{_P}words").cast("long").alias("n_words"),
        F.col(f"{_P}chars").alias("word_chars"),
        F.col(f"{_P}symbols").alias("n_symbols"),
        (F.size(f"{_P}lines") - F.size(F.array_distinct(f"{_P}lines"))).cast("long").alias("n_dup_lines"),
        F.col(f"{_P}repeats").alias("n_repeat_words"),
        _distance(F.col(f"{_P}classes"), reference(0)).alias("char_distance"),
        _distance(F.col(f"{_P}common"), reference(1)).alias("word_distance"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    odd_chars = (F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance + 12 / F.col("word_chars"))
    odd_words = (F.col("n_words") >= min_words) & (F.col("word_distance") > F.sqrt(max_word_distance**2 + 3.6 / F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & ~odd_chars & ~odd_words)
    # a filter on the results must not be pushed below them, where every array would be computed once for each use
    return out.withColumn(f"{_P}at", F.spark_partition_id()).where(F.col(f"{_P}at") >= 0).drop(f"{_P}at")
