"""Repair maps: every refusal by itself, the choice of a line's text, and what a split adds."""

import pytest
from auditlake.operators import repair_maps as R
from auditlake.plans import catalogue
from helpers import DATA
from pyspark.sql import functions as F


def safe(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, tex string")
    return {r.i: (r.safe_tex, r.prime_orders, r.rejected) for r in R.with_safe_tex(df, F.col("tex")).collect()}


def test_safe_text_is_normal_or_rejected(spark):
    got = safe(spark, "$a=b$", None, "  ", "\\lim_{n} x", "x''''", "f''", "x'", "\\underset{}{\\lim} x")
    assert got[0] == ("a=b", [], [])
    assert got[1][2] == got[2][2] == ["empty"]
    assert got[3] == ("\\underset{n}{\\lim} x", [], [])
    assert got[4][2] == ["unverified_prime_order"]
    assert got[5] == ("f''", [2], [])
    assert got[6] == ("x\\prime", [1], [])
    assert got[7][2] == ["empty_underset_lim"]


HEADER = {"source_native": 2, "source_objects": 0, "working_native": 0, "working_objects": 2}


def limit(spark, header=(), formula="\\lim_{n} f'' x", scripts=1, orders=(2,), place=True, ordinal=1):
    h = spark.createDataFrame([(1, *(HEADER | dict(header)).values())], "doc long, source_native long, source_objects long, working_native long, working_objects long")
    rows = lambda data, kind: spark.createDataFrame(data, kind)
    return R.limit_layout(
        h, rows([(1, 1, formula), (1, 2, "y")], "doc long, ordinal long, tex string"), rows([(1, ordinal)], "doc long, ordinal long"), rows([(1, 1, scripts)] if scripts else [], "doc long, ordinal long, n int"),
        rows([(1, 1, list(orders))] if orders else [], "doc long, ordinal long, orders array<int>"), rows([(1, 1, 7, 1)] if place else [], "doc long, ordinal long, p long, local int"), "doc",
    ).first()


def test_a_limit_map(spark):
    row = limit(spark)
    assert (row.tex, row.limits, row.placements, row.prime_orders, row.p, row.refusal, row.planned) == ("$\\underset{n}{\\lim} f'' x$", 1, [["below"]], [2], 7, None, True)


@pytest.mark.parametrize(
    ("reason", "change"),
    [
        ("source_has_objects", {"header": {"source_objects": 1}}),
        ("no_native_formulas", {"header": {"source_native": 0}}),
        ("native_formulas_left", {"header": {"working_native": 1}}),
        ("counts_differ", {"header": {"working_objects": 3}}),
        ("counts_differ", {"header": {"working_objects": None}}),
        ("no_scripted_limit", {"scripts": 0}),
        ("no_scripted_limit", {"ordinal": 9}),
        ("rejected_tex", {"formula": "\\lim_{n} x''''"}),
        ("limit_count_differs", {"scripts": 2}),
        ("prime_orders_differ", {"orders": (1,)}),
        ("location_missing", {"place": False}),
    ],
)
def test_limit_refusals(spark, reason, change):
    row = limit(spark, **change)
    assert (row.refusal, row.planned) == (reason, False)


def exported(spark, rows):
    data = [(1, *r) for r in rows]
    return spark.createDataFrame(data, "doc long, ordinal long, success boolean, line int, exported string, fragment string")


def test_the_text_of_a_line(spark):
    lines = exported(spark, [(1, True, 1, "a=b", "no"), (1, True, 2, "a▒b", "c=d"), (1, True, 3, "", "e"), (1, True, 4, None, None), (1, True, 5, "{a", "g")])
    got = {r.line: (r.safe_tex, r.provenance, r.export_reasons) for r in R.chosen_lines(lines, "doc").collect()}
    assert got[1] == ("a=b", "export", [])
    assert got[2][:2] == ("c=d", "fragment") and got[2][2] == ["word_linear_artifact:▒"]
    assert got[3][:2] == ("e", "fragment") and got[3][2] == ["empty"]
    assert got[4][:2] == ("", "fragment")
    assert got[5][:2] == ("g", "fragment") and got[5][2] == ["unbalanced_brace"]


def test_a_wrap_map_leaves_formulas_of_one_line_alone(spark):
    lines = exported(spark, [(1, True, 2, "c", None), (1, True, 1, "a=b=b", None), (2, True, 1, "z", None), (3, False, None, None, None)])
    header = spark.createDataFrame([(1, 3, 0, 3, True, 0)], "doc long, source_native long, working_native long, working_objects long, unchanged boolean, extra long")
    places = spark.createDataFrame([(1, o, o, 1) for o in (1, 2, 3)], "doc long, ordinal long, p long, local int")
    got = {r.ordinal: r for r in R.visual_wrap(header, lines, places, "doc").collect()}
    assert set(got) == {1, 3}
    assert got[1].tex == r"$\begin{aligned}a&=b=b \\ &c\end{aligned}$" and got[1].visual_lines == 2
    assert (got[1].refusal, got[1].planned, got[3].refusal) == (None, False, "export_failed")
    (alone,) = R.visual_wrap(header, lines.where("ordinal < 3"), places, "doc").collect()
    assert alone.planned
    for bad in ("false AS unchanged, 3L AS working_objects", "CAST(NULL AS boolean) AS unchanged, 3L AS working_objects", "true AS unchanged, 2L AS working_objects"):
        (row,) = R.visual_wrap(header.selectExpr("doc", "source_native", "working_native", "extra", *bad.split(", ")), lines.where("ordinal < 3"), places, "doc").collect()
        assert not row.planned and row.refusal in ("source_changed", "counts_not_exact")


def test_a_split_adds_an_object_a_line(spark):
    lines = exported(spark, [(1, True, 1, "a", None), (1, True, 2, "b", None), (1, True, 3, "c", None), (2, True, 1, "d", None), (2, True, 2, "e", None), (4, True, 1, "f", None)])
    names = "doc long, working_objects long, unchanged boolean, plan_schema string, plan_working string, now_working string, plan_source string, report_source string, plan_paragraphs long, now_paragraphs long, plan_objects long, working_native long"
    header = spark.createDataFrame([(1, 4, True, R.PLAN_SCHEMA, "A", "a", "b", "B", 9, 9, 4, 0)], names)
    objects = spark.createDataFrame([(1, 11, 1), (1, 12, 1), (1, 13, 2), (1, 14, 1)], "doc long, p long, n long")

    def made(*ordinals):
        plan = spark.createDataFrame([(1, o, o, o + 10) for o in ordinals], "doc long, ordinal long, source_p long, working_p long")
        return R.visual_line_split(header, plan, lines, objects, "doc")

    rows = made(1, 2)
    assert [(r.lines, r.expected_after, r.expected_breaks, r.planned) for r in rows.orderBy("ordinal").collect()] == [(["$a$", "$b$", "$c$"], 3, 2, True), (["$d$", "$e$"], 2, 1, True)]
    assert [tuple(r) for r in R.map_totals(rows, header, "doc").collect()] == [(1, 2, 3, 7, 11)]
    got = {r.ordinal: (r.refusal, r.planned) for r in made(1, 3, 4).collect()}
    assert got == {1: (None, False), 3: ("export_missing", False), 4: ("fewer_than_two_lines", False)}
    assert R.map_totals(made(1, 3), header, "doc").count() == 0


@pytest.mark.parametrize(("name", "steps"), [("multisibling_map", 2), ("limit_layout_map", 3), ("visual_wrap_map", 3), ("visual_line_split_map", 3)])
def test_texts_are_dealt_and_read_once(spark, name, steps):
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= steps and "REPARTITION_BY_NUM" in plan


def test_a_failed_export_without_lines_has_none(spark):
    rows = spark.createDataFrame([(1, 1, False, None, None, None), (1, 2, True, 1, "a", "b"), (1, 2, True, None, "c", "d")], "doc int, ordinal int, success boolean, line int, exported string, fragment string")
    got = {r.ordinal: r for r in R._lines(rows, "doc").collect()}
    assert (got[1].lines, got[1].bad, got[1].n, got[1].success) == (None, None, 0, False)
    assert ([x.safe_tex for x in got[2].lines], got[2].bad, got[2].n) == (["a"], 0, 1)
