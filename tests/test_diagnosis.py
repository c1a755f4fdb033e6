"""Contracts and publishing against what must come out."""

import pytest
from auditlake.operators import diagnosis
from auditlake.plans import catalogue
from auditlake.sources.publish import publish
from helpers import DATA


def test_layout_defects(spark):
    targets = [(1, "a", r"\frac{u}{v}", [1, 2]), (1, "b", r"\lim_{n}w", [3]), (1, "c", "h′", [4]), (1, "d", "x", [9]), (2, "a", "y", [1])]
    exports = [(1, 1, r"\frac{u}"), (1, 2, "{v}"), (1, 3, "w"), (1, 4, "h''"), (2, 1, "y")]
    got = diagnosis.layout_defects(spark.createDataFrame(targets, "doc int, target_id string, expected_tex string, ordinals array<int>"), spark.createDataFrame(exports, "doc int, ordinal int, text string"), ["doc"])
    found = {}
    for r in got.collect():
        found.setdefault((r.doc, r.target_id), set()).add(r.reason)
    assert (2, "a") not in found and (1, "a") not in found
    assert {"limit_operator_count_mismatch", "source_formula_semantic_token_mismatch"} <= found[1, "b"]
    assert "prime_order_mismatch" in found[1, "c"] and "mapped_final_export_missing" in found[1, "d"]


def test_layout_query_finds_what_was_changed(spark):
    got = {(r.conv_id, r.target_id) for r in catalogue.queries()["layout_contract_defects"](spark, DATA).where("reason = 'mapped_final_export_missing'").collect()}
    turns = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{DATA}/conversations.parquet").where("turn % 6 = 4").collect()}
    assert got == turns
    every = catalogue.queries()["layout_contract_defects"](spark, DATA)
    # what was not changed may only be refused for its syntax
    assert {r.reason for r in every.where("target_id % 6 = 0 or target_id % 6 = 5").collect()} <= {"noncanonical_prime_syntax"}
    assert every.where("target_id % 6 = 1 and reason = 'structure_mismatch'").select("conv_id", "target_id").distinct().count() == spark.read.parquet(f"{DATA}/conversations.parquet").where("turn % 6 = 1").count()


def test_publish(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "out")
    with pytest.raises(ValueError):
        publish(df, path, lambda back: back.count() == 4)
    assert list(tmp_path.iterdir()) == []
    publish(df, path, lambda back: back.count() == 5)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(FileExistsError):
        publish(df, path, lambda back: True)


def test_equal_formulas_are_dealt_and_not_read(spark):
    """A text that says the same letter by letter is left out of what Python reads, whatever it holds; primes are still judged."""
    targets = spark.createDataFrame([(1, "a", "x = y", [1]), (1, "b", "x''^2", [2]), (1, "c", None, [3]), (1, "d", "x < y", [4])], "doc int, target_id string, expected_tex string, ordinals array<int>")
    exports = spark.createDataFrame([(1, 1, "x = y"), (1, 2, "x''^2"), (1, 3, None), (1, 4, "x = y")], "doc int, ordinal int, text string")
    found = diagnosis.layout_defects(targets, exports, ["doc"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    got = {(r.target_id, r.reason) for r in found.collect()}
    assert ("b", "noncanonical_prime_syntax") in got and {("d", "source_formula_semantic_token_mismatch"), ("d", "structure_mismatch")} <= got
    assert not {"a", "c"} & {t for t, _ in got}
