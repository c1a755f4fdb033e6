"""Local layout: where the proof stops, why documents and targets are refused, what a repaired candidate may not change."""

from auditlake.operators import local_layout as L
from auditlake.operators.compare import frozen_prefix


def paragraphs(spark, rows):
    """(p, plain, formulas, objects, width, soft_breaks) of one document."""
    data = [(1, p, t, f, o, w, b) for p, t, f, o, w, b in rows]
    df = spark.createDataFrame(data, "doc long, p long, plain string, formulas long, objects long, width double, soft_breaks long")
    return df.selectExpr("*", "468.0D AS text_width", "IF(formulas > 0, sum(formulas) OVER (ORDER BY p) - formulas + 1, NULL) AS first_ordinal")


def pair(spark, n=20, changed=(), offset=1, wide=(10,), formulas=1):
    texts = [f"text number {i:02}" for i in range(1, n + 1)]
    source = paragraphs(spark, [(i, texts[i - 1], formulas if i in wide else 0, 0, None, 0) for i in range(1, n + 1)])
    rows = [(i, f"front {i}", 0, 0, None, 0) for i in range(1, offset + 1)]
    rows += [(i + offset, texts[i - 1] + ("!" if i in changed else ""), 0, int(i in wide), 600.0 if i in wide else None, 0) for i in range(1, n + 1)]
    return source, paragraphs(spark, rows)


def told(spark, source, working, anchor="text number 03", probes=((1, True, True),)):
    anchors = spark.createDataFrame([(1, anchor)], "doc long, anchor string")
    said = spark.createDataFrame([(1, *p) for p in probes], "doc long, ordinal long, success boolean, multiline boolean")
    documents, targets = L.local_layout(source, working, anchors, said, "doc")
    return documents.first(), targets.collect()


def test_a_stable_offset_and_a_proved_target(spark):
    document, targets = told(spark, *pair(spark))
    assert (document.status, document.offset, document.checked, document.mismatches, document.kept, document.first_repair) == ("repair_required", 1, 8, 0, 1, 11)
    assert [(t.working_p, t.source_p, t.ordinal, t.overflow, t.kept) for t in targets] == [(11, 10, 1, 132.0, True)]


def test_a_probe_that_failed_or_saw_one_line_leaves_nothing_to_do(spark):
    for probe in ((1, False, True), (1, True, False), (1, None, None), (2, True, True)):
        document, (target,) = told(spark, *pair(spark), probes=[probe])
        assert (document.status, document.kept, target.kept) == ("ready_no_local_overflow", 0, False)


def test_the_proof_stops_at_the_eighth_mismatch(spark):
    source, working = pair(spark, n=40, changed=range(5, 30), wide=(35,))
    document, (target,) = told(spark, source, working)
    # texts 3 and 4 agree, 5 to 12 are the eight mismatches
    assert (document.status, document.reason, document.checked, document.matches, document.mismatches, target.kept) == ("refused", "offset_not_stable", 10, 2, 8, False)


def test_texts_after_the_last_target_prove_nothing(spark):
    document, _ = told(spark, *pair(spark, changed=(15,)))
    assert document.status == "repair_required"
    document, _ = told(spark, *pair(spark, wide=(5,)))
    assert (document.reason, document.checked) == ("offset_not_stable", 3)


def test_anchors(spark):
    source, working = pair(spark)
    for anchor, reason in (("", "empty_anchor"), ("text number", "source_anchor_not_unique"), ("absent", "source_anchor_not_unique"), (None, "empty_anchor")):
        document, targets = told(spark, source, working, anchor)
        assert (document.status, document.reason, document.offset, targets) == ("refused", reason, None, [])
    _, twice = pair(spark, changed=())
    document, _ = told(spark, source, twice.union(twice.where("p = 4").selectExpr("doc", "90L", *twice.columns[2:])))
    assert document.reason == "working_anchor_not_unique"


def test_targets_that_cannot_be_split(spark):
    _, (target,) = told(spark, *pair(spark, formulas=2))
    assert (target.error, target.ordinal, target.kept) == ("not_one_formula", None, False)
    source, working = pair(spark)
    _, (target,) = told(spark, source, working.selectExpr("doc", "p", "plain", "formulas", "objects * 2 AS objects", "width", "soft_breaks", "text_width", "first_ordinal"))
    assert target.error == "not_one_object"
    _, (target,) = told(spark, source.where("p < 10"), working)
    assert (target.error, target.source_p) == ("outside_source", 10)


def test_a_native_formula_left_refuses(spark):
    source, working = pair(spark)
    document, _ = told(spark, source, working.selectExpr("doc", "p", "plain", "IF(p = 1, 1L, 0L) AS formulas", "objects", "width", "soft_breaks", "text_width", "first_ordinal"))
    assert (document.status, document.reason) == ("refused", "native_formulas_left")


def test_plan_by_ordinal_needs_exact_counts(spark):
    places = spark.createDataFrame([(d, o, 10 * o) for d in (1, 2) for o in (1, 2)], "doc long, ordinal long, p long")
    wanted = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 1)], "doc long, ordinal long")
    states = spark.createDataFrame([(1, "exact"), (2, "unexpected_formula_loss"), (3, "exact")], "doc long, state string")
    nothing = L.anchored(places.limit(0).selectExpr("doc", "p", "'' AS plain"), places.limit(0).selectExpr("doc", "p", "'' AS plain"), wanted.limit(0).selectExpr("doc", "'' AS anchor"), "doc")
    got = {r.doc: (r.mode, r.source_p, r.working_p, r.refusal, r.planned) for r in L.local_plan(places, places, wanted, nothing, states, "doc").collect()}
    assert got == {1: ("exact_count", 20, 20, None, True), 2: ("exact_count", 10, None, "counts_not_exact", False), 3: ("exact_count", None, None, "source_ordinal_not_found", False)}


def test_plan_by_offset_refuses_the_whole_document(spark):
    source, working = pair(spark, wide=(2, 10, 12))
    found = L.anchored(source, working, spark.createDataFrame([(1, "text number 03")], "doc long, anchor string"), "doc")
    formulas = spark.createDataFrame([(1, 1, 2), (1, 2, 10), (1, 3, 12)], "doc long, ordinal long, p long")
    objects = spark.createDataFrame([(1, 1, 3), (1, 2, 11), (1, 3, 13), (1, 4, 13)], "doc long, ordinal long, p long")
    states = spark.createDataFrame([], "doc long, state string")

    def plan(*ordinals):
        wanted = spark.createDataFrame([(1, o) for o in ordinals], "doc long, ordinal long")
        return [(r.ordinal, r.mode, r.working_p, r.refusal, r.planned) for r in L.local_plan(formulas, objects, wanted, found, states, "doc").orderBy("ordinal").collect()]

    assert plan(2) == [(2, "offset", 11, None, True)]
    assert plan(1, 2, 3, 9) == [(1, "offset", None, "before_anchor", False), (2, "offset", 11, None, False), (3, "offset", None, "not_one_object", False), (9, "offset", None, "source_ordinal_not_found", False)]


def test_text_that_moves_between_paragraphs_is_unchanged_text(spark):
    before = paragraphs(spark, [(1, "ab", 0, 0, None, 0), (2, "cd", 0, 1, 9.0, 0)])
    after = paragraphs(spark, [(1, "abc", 0, 0, None, 0), (2, "d", 0, 2, 9.0, 1)])
    maps = spark.createDataFrame([(1, L.SPLIT, "s", "A", "b", "B", 2, 2)], "doc long, repair_class string, source string, source_sha256 string, working_sha256 string, now_working string, first_repair long, expected_objects long")
    files = spark.createDataFrame([("s", "a")], "path string, sha256 string")
    targets = spark.createDataFrame([(1, 2, 2, 1)], "doc long, p long, expected_objects long, expected_breaks long")
    rules = lambda m, a, b: sorted(r.rule for r in L.validated_by_map(m, files, a, b, targets, "doc").collect())
    assert rules(maps, before, after) == ["frozen_prefix"]
    assert rules(maps.selectExpr("doc", "repair_class", "source", "source_sha256", "working_sha256", "now_working", "1L AS first_repair", "expected_objects"), before, after) == []
    assert rules(maps, before, before) == ["object_count", "target_failed"]
    lost = after.where("p = 1")
    assert rules(maps, before, lost) == ["frozen_prefix", "object_count", "paragraph_count", "target_outside", "text_changed"]


def test_the_frozen_prefix_compares_four_fields(spark):
    one = paragraphs(spark, [(p, "t", 0, 0, None, 0) for p in range(1, 8)])
    two = paragraphs(spark, [(1, "u", 0, 0, None, 0), (2, "t", 1, 0, None, 0), (3, "t", 0, 1, None, 0), (4, "t", 0, 0, None, 1), (5, "t", 0, 0, 3.0, 0), (6, "t", 0, 0, None, 0), (7, "u", 0, 0, None, 0)])
    first = spark.createDataFrame([(1, 7)], "doc long, first long")
    assert sorted(r.p for r in frozen_prefix(one, two, first, L.SIGNATURE, "doc").collect()) == [1, 2, 3, 4]
