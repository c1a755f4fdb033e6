import re

import pytest
from auditlake.functions import dealt, text
from auditlake.operators import compare, duplicates, geometry, numbering, rules
from auditlake.plans import catalogue
from helpers import DATA
from pyspark.sql import functions as F


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_line_groups_compare_with_the_first_of_the_run(spark):
    data = [(1, i, y, False) for i, y in enumerate([0.0, 1.4, 2.8, 2.9])] + [(2, 0, 0.0, False), (2, 1, 0.5, True), (2, 2, 0.6, False), (3, 0, None, False)]
    df = spark.createDataFrame(data, "p int, ordinal int, y double, multi boolean")
    got = geometry.same_line_groups(df, ["p"], ["ordinal"], "y", multi="multi")
    assert rows(got, "p", "ordinal", "line_group") == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 0, 1), (2, 2, 3)]


def test_outliers_need_three_references_and_test_ratios_outside_the_pool(spark):
    data = [("a", 10.0, 10.0), ("a", 10.0, 10.1), ("a", 10.0, 9.9), ("a", 10.0, 14.0), ("a", 10.0, 200.0), ("b", 10.0, 10.0), ("b", 10.0, 90.0), ("c", 3.0, 9.0)]
    df = spark.createDataFrame(data, "g string, source_width double, final_width double").withColumn("reliable", F.lit(True))
    got = geometry.width_outliers(df, ["g"])
    assert rows(got.where("outlier"), "g", "final_width") == [("a", 14.0), ("a", 200.0)]
    plan = geometry.calibration(got)
    assert plan.count() == 1


def test_twips_round_half_to_even(spark):
    df = spark.createDataFrame([(0.125, 1.0, 0.2, True)], "source_width double, center double, final_width double, outlier boolean")
    assert geometry.calibration(df).first().twips == 2


def test_overflow_limit_is_strict(spark):
    over = geometry.right_overflow(F.lit(10.0), F.lit(5.0), F.lit(13.0), F.lit(True))
    assert spark.range(1).select((over > geometry.OVERFLOW)).first()[0] is False


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "k string, ok boolean")
    assert rows(df.groupBy("k").agg(rules.every(F.col("ok")).alias("ok")), "k", "ok") == [("a", False), ("b", True)]
    assert df.where("false").agg(rules.every(F.col("ok")).alias("ok")).first().ok is True


def test_count_states(spark):
    cases = [(1574, 54, 1520, 0), (1574, 54, 1519, 0), (1574, 54, 1574, 0), (1574, 54, 1574, 1), (1574, 0, 1600, 0)]
    df = spark.createDataFrame(cases, "raw int, extra int, done int, rest int")
    got = [r[0] for r in df.select(rules.count_state(F.col("raw"), F.col("extra"), F.col("done"), F.col("rest"))).collect()]
    assert got == ["known_multisibling_collapse", "unexpected_formula_loss", "exact", "residual_officemath", "unexpected_formula_excess"]


def test_review_errors(spark):
    inventory = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "page int, digest string")
    reviews = spark.createDataFrame([(1, "a", True), (2, "x", True), (3, "c", None), (9, "z", True), (1, "a", True)], "page int, digest string, passed boolean")
    got = rules.review_errors(inventory, reviews, "page", "digest")
    assert rows(got, "page", "rule") == [(1, "duplicate"), (2, "hash_mismatch"), (3, "not_passed"), (4, "missing"), (9, "extra")]
    assert rows(rules.accepted(inventory, got, "page"), "page", "acceptance_pass") == [(1, False), (2, False), (3, False), (4, False)]


def test_depth_and_completeness(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([-1, 1, 1, -1, -1, -1, 1])], "d int, i int, s int")
    assert [r[0] for r in numbering.clamped_depth(df, ["d"], ["i"], F.col("s")).orderBy("i").select("depth").collect()] == [0, 1, 2, 1, 0, 0, 1]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 2), ("c", 3)], "k string, n int")
    assert rows(numbering.complete(df, ["k"], "n", F.lit(2)), "k", "complete") == [("a", True), ("b", False), ("c", False)]


def test_restore_is_identity(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "")], "id int, body string")
    back = duplicates.once_each(df, "body", lambda d: d.withColumn("n", F.length("body")))
    assert rows(back, "id", "body", "n") == [(1, "x", 1), (2, "y", 1), (3, "x", 1), (4, "", 0)]


def test_offsets(spark):
    one = spark.createDataFrame([(1, p, f"text {p}") for p in range(1, 9)], "k int, p int, plain string")
    two = one.withColumn("p", F.col("p") + 2)
    assert compare.offset_stability(one, two, F.lit(2), "k").first().stable
    broken = two.withColumn("plain", F.when(F.col("p") == 5, "other").otherwise(F.col("plain")))
    assert not compare.offset_stability(one, broken, F.lit(2), "k").first().stable
    assert not compare.offset_stability(one, two.where("p < 6"), F.lit(2), "k").first().stable


def test_unknown_scope():
    import pytest

    with pytest.raises(ValueError, match="unknown scope"):
        text.normalize_labels(None, "everywhere")


def test_coverage_of_keys_with_nulls_and_copies(spark):
    kind = "doc int, n int"
    one, two = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, None)], kind), spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, None)], kind)
    want = [(1, 1, "missing"), (1, 3, "extra"), (2, None, "extra"), (2, None, "missing")]
    for tasks in (None, 3):
        found = compare.two_way_coverage(one, two, ["doc", "n"], tasks)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["coverage_two_way", "single_owner_violations", "ordinal_completeness", "restore_errors"])
def test_rows_are_dealt_by_key_in_a_number_that_follows_them(spark, monkeypatch, name):
    """Partitions of a stated number are not merged; with few rows a task, there are more tasks."""
    monkeypatch.setattr(dealt, "ROWS_A_TASK", 100)
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    stated = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert stated and min(stated) >= spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 100
