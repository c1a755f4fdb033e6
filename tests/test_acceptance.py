"""Acceptance: order of gates, agreement of texts, structure in both modes, every rule of a formula map, glyphs of primes."""

import pytest
from auditlake.functions import text
from auditlake.operators import acceptance as A
from auditlake.operators import checks, diagnosis
from pyspark.sql import functions as F


def failing(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "doc long")


def test_gates_run_in_order_and_stop(spark):
    keys = failing(spark, 1, 2, 3, 4, 4)
    gates = [A.Gate("a", failing(spark, 2, 2), stops=True), A.Gate("b", failing(spark, 1, 2, 9)), A.Gate("c", failing(spark, 3), stops=True), A.Gate("d", failing(spark, 1))]
    states = A.run_gates(keys, gates, "doc")
    got = {}
    for r in states.orderBy("doc", "nth").collect():
        got.setdefault(r.doc, []).append(r.state[0])
    assert got == {1: list("pfpf"), 2: list("fnnn"), 3: list("ppfn"), 4: list("pppp")}
    assert {tuple(r) for r in A.verdict(states, "doc").collect()} == {(1, "hard_content_failed", "b", 2), (2, "refused", "a", 1), (3, "refused", "c", 1), (4, "awaiting_visual_review", None, 0)}


def flags(spark, a, b, scope="line-start"):
    rows = lambda texts: spark.createDataFrame([(1, p, x, x) for p, x in enumerate(texts, 1)], "doc long, p long, plain string, contract string")
    return A.content_flags(rows(a), rows(b), "doc", scope).first()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (["a", "b"], ["a", "b"], (True, True, True, True, True, 0)),
        (["a", "b"], ["ab", ""], (False, True, False, True, False, 0)),
        (["a", "b"], ["ab"], (False, True, False, True, False, 0)),
        (["1、a"], ["1.a"], (False, False, True, True, True, 1)),
        (["1、a"], ["1、a"], (True, True, False, False, True, 1)),
        (["1、a", "2、b"], ["1.a2.", "b"], (False, False, False, True, False, 2)),
        (["a"], ["b"], (False, False, False, False, False, 0)),
    ],
)
def test_how_texts_agree(spark, a, b, want):
    r = flags(spark, a, b)
    assert (r.exact, r.flat_exact, r.normalised_exact, r.normalised_flat_exact, r.contract_exact, r.expected_changes) == want


def test_nothing_is_changed_where_labels_are_preserved(spark):
    assert flags(spark, ["1、a"], ["1.a"], "preserve").contract_exact is False


def test_structure_in_both_modes(spark):
    rows = lambda *tex: spark.createDataFrame([(i, t) for i, t in enumerate(tex)], "i int, tex string")
    want, got = (A.structure_counts(rows(*x), ["i"], "tex") for x in (("a=b+c", "\\frac{1}{2}", "x"), ("a=b=c", "x", "\\int y")))
    told = lambda exact: sorted((r.i, r.reason, r.expected, r.actual) for r in A.structure_differences(want, got, ["i"], exact).collect())
    assert told(False) == [(0, "relations_plus_missing", 1, 0), (1, "fractions_structure_missing", 1, 0)]
    assert told(True) == [(0, "relations_eq_count_mismatch", 1, 2), (0, "relations_plus_count_mismatch", 1, 0), (1, "fractions_structure_count_mismatch", 1, 0), (2, "operators_integral_count_mismatch", 0, 1)]


HEADER = {
    "schema": f"x-{checks.MAP_SCHEMA}", "source_path": "s", "now_source_path": "s", "source_sha256": "A", "now_source_sha256": "a", "source_count": 2, "now_source_count": 2,
    "final_path": "f", "now_final_path": "f", "final_sha256": "B", "now_final_sha256": "b", "final_count": 3, "now_final_count": 3,
}
TARGETS = [("a", "source_formula", 1, "near", "x", [1]), ("b", "source_formula", 2, "near", "y", [2]), ("c", "added_body_math", None, "near", "z", [3])]


def broken(spark, header=(), **targets):
    rows = [list(t) for t in TARGETS]
    for at, value in targets.items():
        rows[int(at[1])]["t kind source anchor tex finals".split().index(at[3:])] = value
    kinds = {"source_count": "long", "now_source_count": "long", "final_count": "long", "now_final_count": "long"}
    head = spark.createDataFrame([(1, *(HEADER | dict(header)).values())], "map_id long, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in HEADER))
    df = spark.createDataFrame([(1, *r) for r in rows], "map_id long, target_id string, kind string, source_ordinal long, source_anchor string, expected_tex string, final_ordinals array<long>")
    return sorted(r.rule for r in checks.formula_map(head, df).collect())


@pytest.mark.parametrize(
    ("rules", "change"),
    [
        ([], {}),
        (["schema"], {"header": {"schema": "formula-map/v2"}}),
        (["other_source"], {"header": {"source_path": None}}),
        (["stale_source"], {"header": {"source_sha256": "c"}}),
        (["source_count"], {"header": {"source_count": None}}),
        (["final_count"], {"header": {"final_count": 2}}),
        (["target_id"], {"t1_t": "a"}),
        (["target_id"], {"t1_t": None}),
        (["final_coverage", "no_output"], {"t2_finals": None}),
        (["final_coverage", "no_output", "source_coverage"], {"t1_finals": []}),
        (["repeated_output"], {"t0_finals": [1, 1]}),
        (["final_coverage", "final_out_of_range"], {"t2_finals": [3, 4]}),
        (["several_owners"], {"t2_finals": [3, 1]}),
        (["source_coverage", "source_ordinal"], {"t1_source": None}),
        (["source_coverage", "source_out_of_range"], {"t1_source": 3}),
        (["source_coverage", "source_mapped_twice"], {"t1_source": 1}),
        (["source_anchor"], {"t2_anchor": " "}),
        (["expected_tex"], {"t2_tex": None}),
        (["kind", "source_coverage"], {"t1_kind": "source"}),
    ],
)
def test_rules_of_a_formula_map(spark, rules, change):
    assert broken(spark, **change) == rules


@pytest.mark.parametrize(
    ("rules", "change"),
    [
        (["final_count", "final_coverage", "final_out_of_range"], {"header": {"now_final_count": None}}),
        (["source_count", "source_coverage"], {"header": {"now_source_count": None}}),
        (["final_coverage", "final_out_of_range"], {"t2_finals": [3, None]}),
        (["final_coverage", "final_out_of_range", "several_owners"], {"t1_finals": [2, None], "t2_finals": [3, None]}),
        (["final_coverage", "final_out_of_range", "source_coverage", "source_out_of_range"], {"t0_finals": [0], "t0_source": 0}),
        (["source_coverage", "source_mapped_twice", "source_ordinal"], {"t0_source": None, "t1_source": None}),
    ],
)
def test_rules_of_a_formula_map_with_unknown_numbers(spark, rules, change):
    assert broken(spark, **change) == rules


def test_orders_of_source_primes(spark):
    cases = {"f'": [1], "f''''": [3, 1], "f′ g″ h‴": [1, 2, 3], "aʹ b’ c‘ dʺ": [1, 1, 1, 2], "x": [], "'''''''": [3, 3, 1], "′′": [1, 1]}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", text.source_prime_orders(F.col("v"))).collect()} == cases


def contract(spark, header=(), audit=(), ordinals=(1, 2), audited=True):
    h = {"native": 0, "converted": 2, "path": "p", "sha256": "ab"} | dict(header)
    a = {"schema": "internal-tex-diagnostic/v1", "scope": "full", "read_only": True, "path": "p", "sha_before": "AB", "sha_after": "ab", "success": True, "failed": 0} | dict(audit)
    headers = spark.createDataFrame([(1, *h.values())], "doc long, native long, converted long, path string, sha256 string")
    audits = spark.createDataFrame([(1, *a.values())] if audited else [], "doc long, schema string, scope string, read_only boolean, path string, sha_before string, sha_after string, success boolean, failed long")
    r = diagnosis.bound_contract(headers, audits, spark.createDataFrame([(1, o) for o in ordinals], "doc long, ordinal long"), "doc").first()
    return r.baseline, r.refused, r.formula_count


def test_a_converted_source_needs_its_own_complete_export(spark):
    assert contract(spark) == ("converted", None, 2)
    assert contract(spark, {"native": 3, "converted": 0}, audited=False) == ("native", None, 3)
    assert contract(spark, {"converted": 0}, audited=False) == ("no_formulas", None, 0)
    assert contract(spark, {"native": 1})[1] == "mixed_baseline"
    assert contract(spark, audited=False)[1] == "audit_missing"
    for reason, change in (
        ("audit_schema", {"schema": None}), ("audit_not_complete", {"scope": "selected"}), ("audit_not_complete", {"read_only": None}), ("audit_of_another_file", {"path": "q"}), ("audit_stale", {"sha_before": None}), ("audit_stale", {"sha_after": "x"}),
        ("audit_failed", {"success": False}), ("audit_failed", {"failed": 1}),
    ):
        assert contract(spark, audit=change) == (None, reason, None)
    for ordinals in ((1,), (1, 1), (1, 2, 3), ()):
        assert contract(spark, ordinals=ordinals)[1] == "audit_incomplete"


def test_a_run_is_accepted_on_all_terms(spark):
    names = [*diagnosis.RUN_FLAGS, *diagnosis.RUN_ZEROS]
    assert len(names) == 17
    good = [True] * len(diagnosis.RUN_FLAGS) + [0] * len(diagnosis.RUN_ZEROS)
    rows = [("good", *good)]
    for n, name in enumerate(names):
        for bad in (None, False if n < len(diagnosis.RUN_FLAGS) else 2):
            rows.append((name, *(bad if i == n else v for i, v in enumerate(good))))
    df = spark.createDataFrame(rows, "run string, " + ", ".join(f"{n} {'boolean' if i < len(diagnosis.RUN_FLAGS) else 'long'}" for i, n in enumerate(names)))
    for r in diagnosis.run_accepted(df, "run").collect():
        assert (r.accepted, r.first_missing) == ((True, None) if r.run == "good" else (False, r.run))


def test_lists_of_evidence(spark):
    cases = ['{"k": 1}', ' [{"k": 1}, {"k": null}, {}]', "[]", None, "", "3", "{bad"]
    df = spark.createDataFrame([(c,) for c in cases], "v string").select(text.as_list(F.col("v"), "k:bigint").alias("x"))
    assert [[i.k for i in r.x] for r in df.collect()] == [[1], [1, None, None], [], [], [], [], [None]]
    row = spark.createDataFrame([(1, None, "a")], "a int, b string, c string").select(text.known_fields("a", "b", "c").alias("j"), text.identifier("template", F.col("a")).alias("i"), text.identifier("source", F.lit(None).cast("int")).alias("n")).first()
    assert tuple(row) == ('{"a":1,"c":"a"}', "AXD00001", None)
