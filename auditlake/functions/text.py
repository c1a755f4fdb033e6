"""Text rules as column expressions.

Patterns say ``(?U)`` where a space, digit or word character means any Unicode one, and
``(?md)`` where only a newline ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prime glyphs and their meaning, superscript glyphs, control characters.
PRIME_MARKERS = "'′″‴⁗ʹʺ’‘"
FOREIGN_PRIMES = "′″‴⁗ʹʺ’‘"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻"
SUPERSCRIPT_DIGITS = "0123456789+-"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
# Orders of the prime glyphs that sources use.
SOURCE_PRIMES = {"′": 1, "ʹ": 1, "’": 1, "‘": 1, "″": 2, "ʺ": 2, "‴": 3}
LABEL_LINE_START = r"(?md)^([ \t\u3000]*(?:[0-9０-９]+|[（(][0-9０-９]+[)）]))、"
LABEL_ANYWHERE = r"(?<![0-9０-９])((?:[0-9０-９]+|[（(][0-9０-９]+[)）]))、"


def strip(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """Null or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def issues(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in the order given."""
    return F.filter(F.array(*(F.when(hit, F.lit(code)) for hit, code in rules)), lambda c: c.isNotNull())


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def prime_tokens(tex: Column) -> Column:
    """Glyphs for primes become the three tokens that are read back safely; a lone apostrophe is a first prime."""
    out = F.replace(tex, F.lit("‴"), F.lit("'''"))
    for glyph in "″ʺ":
        out = F.replace(out, F.lit(glyph), F.lit("''"))
    for n, token in ((3, "'''"), (2, "''"), (1, r"\\prime")):
        out = F.regexp_replace(out, f"[′ʹ’‘]{{{n}}}", token)
    return F.regexp_replace(out, "(?<!')'(?!')", r"\\prime")


def superscripts(tex: Column) -> Column:
    """A run of superscript glyphs becomes one braced exponent."""
    return F.translate(F.regexp_replace(tex, f"([{SUPERSCRIPTS}]+)", r"^{$1}"), SUPERSCRIPTS, SUPERSCRIPT_DIGITS)


def small_integral_issues(tex: Column) -> Column:
    return issues((tex.rlike(r"\\smallint(?![A-Za-z])"), "smallint_forbidden"))


def prime_orders(tex: Column) -> Column:
    """Order of every prime token, the longest token first."""
    found = F.regexp_extract_all(tex, F.lit(r"('''|''|\\prime(?![A-Za-z0-9_]))"), F.lit(1))
    return F.transform(found, lambda t: F.when(F.startswith(t, F.lit("\\")), 1).otherwise(F.length(t)))


def source_prime_orders(text: Column) -> Column:
    """The same for glyphs of a source: apostrophes count in runs of at most three, other glyphs by themselves."""
    found = F.regexp_extract_all(text, F.lit(f"('{{1,3}}|[{''.join(SOURCE_PRIMES)}])"), F.lit(1))
    return F.transform(found, lambda t: F.coalesce(*(F.when(t == g, n) for g, n in SOURCE_PRIMES.items()), F.length(t)))


def prime_issues(tex: Column) -> Column:
    return issues(
        (tex.rlike(f"[{FOREIGN_PRIMES}]"), "noncanonical_prime_literal"),
        (tex.rlike(f"[{SUPERSCRIPTS}]"), "unicode_superscript_literal"),
        (tex.rlike("'{4,}"), "unverified_prime_order"),
        (tex.rlike("(?<!')'(?!')"), "noncanonical_single_prime_apostrophe"),
        (tex.rlike(r"\\prime(?=[A-Za-z0-9])"), "fused_prime_exponent"),
        (tex.rlike(r"(?:\\prime(?![A-Za-z0-9_])|'{2,3})\s*\^(?:\{|[A-Za-z0-9])"), "ungrouped_primed_atom_exponent"),
    )


def has_prime(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{PRIME_MARKERS}]|\\\\prime(?![A-Za-z0-9_])"), F.lit(False))


def brace_balanced(text: Column) -> Column:
    """Depth never falls below zero and ends at zero."""
    braces = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    return F.aggregate(braces, zero, step, lambda s: (s["depth"] == 0) & (s["least"] == 0))


def latex_reasons(text: Column) -> Column:
    """Why an exported formula is not safe input; empty if it is."""
    value = F.coalesce(text, F.lit(""))
    artifacts = [(F.contains(value, F.lit(a)), f"word_linear_artifact:{a}") for a in ("▒", "〖", "〗", "\\begin(")]
    return issues(
        (blank(value), "empty"),
        (has_control(value), "control_character"),
        (value.rlike(r"[\r\n\t]"), "embedded_line_control"),
        (value.rlike(r"[\x{1D400}-\x{1D7FF}]"), "unicode_math_alphanumeric"),
        *artifacts,
        (~brace_balanced(value), "unbalanced_brace"),
    )


def normalize_labels(text: Column, scope: str = "line-start") -> Column:
    """The mark after a list label becomes a full stop; ``preserve`` changes nothing."""
    patterns = {"line-start": LABEL_LINE_START, "anywhere": LABEL_ANYWHERE}
    if scope == "preserve":
        return text
    if scope not in patterns:
        raise ValueError(f"unknown scope: {scope}")
    return F.regexp_replace(text, patterns[scope], "$1.")


def replace_period(text: Column, eligible: Column) -> Column:
    return F.when(eligible, F.translate(text, "。", ".")).otherwise(text)


def align_at_equals(line: Column) -> Column:
    """Puts the alignment mark before the first equals sign outside braces, else in front."""
    chars = F.split(line, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        n = s["n"] + 1
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = F.when((s["at"] == 0) & (depth == 0) & (c == "="), n).otherwise(s["at"])
        return F.struct(depth.alias("depth"), n.alias("n"), at.alias("at"))

    at = F.aggregate(chars, start, step, lambda s: s["at"])
    return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), F.lit("&"), F.substring(line, at, F.length(line)))).otherwise(F.concat(F.lit("&"), line))


def aligned(lines: Column) -> Column:
    return F.concat(F.lit(r"\begin{aligned}"), F.array_join(F.transform(lines, align_at_equals), " \\\\ "), F.lit(r"\end{aligned}"))


def style_points(style: Column, name: str) -> Column:
    """A dimension in points from a list of style declarations; null where there is none."""
    return F.regexp_extract(style, rf"(?i)(?:^|;)\s*{name}\s*:\s*(-?[0-9.]+)pt", 1).try_cast("double")


def context_window(text: Column, at: Column, size: int = 48) -> Column:
    """``size`` characters on each side of 1-based position ``at``."""
    begin = F.greatest(at - size, F.lit(1))
    return F.substring(text, begin, at + size - begin + 1)


def object_kind(progid: Column) -> Column:
    low = F.lower(strip(F.coalesce(progid, F.lit(""))))
    return F.when(low == "equation.axmath", "axmath").when(low.rlike(r"^equation\.(3|dsmt)"), "legacy_equation").otherwise("unclassified")


def is_heading(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?iU)^(?:heading|标题)\s*[1-9](?:\s*char)?$"), F.lit(False))


def number_state(num_id: Column) -> Column:
    """Nothing, explicitly disabled, or a candidate."""
    return F.when(num_id.isNull(), None).when(num_id == "0", "disabled").otherwise("candidate")


def ordinals(listed: Column) -> Column:
    """A comma-separated list as sorted distinct numbers; blanks are dropped."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(listed, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))))


def single_dollar(tex: Column) -> Column:
    """A formula between single dollar signs, whatever it stood between."""
    v = strip(tex)
    size = F.length(v)
    double = F.startswith(v, F.lit("$$")) & F.endswith(v, F.lit("$$")) & (size >= 4)
    single = F.startswith(v, F.lit("$")) & F.endswith(v, F.lit("$"))
    bare = F.regexp_replace(v, r"^\$+|\$+$", "")
    return F.when(double, F.concat(F.lit("$"), F.substring(v, F.lit(3), size - 4), F.lit("$"))).when(single, v).otherwise(F.concat(F.lit("$"), bare, F.lit("$")))


def inline_tex(tex: Column) -> Column:
    """A round trip's formula for a line of text: single dollars, no hard space set upright."""
    return F.replace(single_dollar(tex), F.lit("\\mathrm{\u00a0}"), F.lit(""))


def clean_text(text: Column) -> Column:
    """Text of an application: line ends as line feeds, no bell, what is no UTF-8 replaced."""
    return F.replace(F.translate(F.make_valid_utf8(F.coalesce(text, F.lit(""))), "\r\u0007", "\n"), F.lit("\u0007"), F.lit(""))


def numbering_fields(instructions: Column) -> Column:
    """Kinds of numbering fields in field instructions, sorted."""
    found = F.regexp_extract_all(F.upper(instructions), F.lit(r"\b(SEQ|LISTNUM|AUTONUMLGL|AUTONUMOUT|AUTONUM)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


# Identifiers of things by their number.
IDENTIFIERS = {"template": "AXD%05d", "source": "SRC-%04d", "formula": "omath-%04d"}


def identifier(kind: str, number: Column) -> Column:
    """The identifier of the ``number``-th thing of a kind; null without a number."""
    return F.when(number.isNotNull(), F.format_string(IDENTIFIERS[kind], number))


def as_list(value: Column, item: str) -> Column:
    """Evidence that is one object or a list of objects as a list of the fields ``item`` (DDL); null and what is neither is an empty list, a damaged object one without fields."""
    empty = F.array().cast(f"array<struct<{item}>>")
    bare = F.ltrim(value)
    one = F.from_json(value, f"struct<{item}>")
    found = F.when(F.startswith(bare, F.lit("[")), F.from_json(value, f"array<struct<{item}>>")).when(F.startswith(bare, F.lit("{")) & one.isNotNull(), F.array(one))
    return F.coalesce(found, empty)


def known_fields(*columns: str) -> Column:
    """The columns that are not null, as one object."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
