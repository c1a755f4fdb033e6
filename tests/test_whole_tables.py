"""Queries over whole tables against brute force, also where their SQL looks at a part of the rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pandas as pd
from auditlake.functions import dealt
from auditlake.plans import catalogue
from helpers import DATA


def table(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def found(spark, name, *columns, folder=DATA):
    return sorted(tuple(r) for r in catalogue.queries()[name](spark, str(folder)).select(*columns).collect())


def test_class_e_review_takes_every_document(spark, tmp_path):
    # ids beyond any fixed bound
    docs = table("documents").assign(doc_id=lambda d: d.doc_id * 7 + 3)
    docs.to_parquet(tmp_path / "documents.parquet")
    want = []
    for i in docs.doc_id.tolist():
        filed = -1 - i if i % 23 == 0 else i
        if filed != i:
            want += [(i, rule) for rule in ("missing", "identity", "decision", "evidence")] + [(filed, "extra"), (filed, "identity")]
        elif i % 17 == 0:
            want.append((i, "identity"))
        if i % 5 == 0:
            want.append((filed, "decision"))
    got = found(spark, "class_e_review_errors", "ordinal", "rule", folder=tmp_path)
    assert got == sorted(want)
    assert max(i for i, _ in got) >= 520


def test_formula_map_takes_every_order(spark):
    """Every order is a map; its targets and outputs are made and judged here one by one."""
    orders, counts = set(table("orders")["o_orderkey"].tolist()), Counter(table("lineitem")["l_orderkey"].tolist())
    want = []
    for k, n in counts.items():
        if k not in orders:
            continue
        m, at, targets = k % 40, 1, []
        for s in range(1, n + 1):
            width = 2 if s % 3 == 0 else 1
            targets.append([f"SRC-{s:04d}", "source_formula", s, "near", "x", list(range(at, at + width))])
            at += width
        finals, first = at - 1, targets[0]
        if m == 32:
            first[0] = " "
        if m == 33:
            first[5] = []
        if m == 34:
            first[5] = [1, 1]
        if m == 35:
            first[5] = [1, 10000]
        if m == 36 and n > 1:
            targets[1][5] = [1]
        if m in (37, 38):
            first[2] = None if m == 37 else 999
        if m == 39 and n > 1:
            targets[1][2] = 1
        if m == 0:
            first[3], first[4] = "", None
        if m == 1:
            first[1] = "other"
        bound = {1: "schema", 2: "other_source", 3: "stale_source", 4: "source_count", 5: "other_final", 6: "stale_final", 7: "final_count"}
        rules = {bound[m]} if m in bound else set()
        owners = Counter(o for t in targets for o in set(t[5]))
        of_source = [t[2] for t in targets if t[1] == "source_formula" and t[5]]
        rules |= {
            rule
            for rule, broken in (
                ("target_id", any(not t[0].strip() for t in targets)),
                ("no_output", any(not t[5] for t in targets)),
                ("repeated_output", any(len(set(t[5])) < len(t[5]) for t in targets)),
                ("final_out_of_range", any(not 1 <= o <= finals for o in owners)),
                ("several_owners", any(c > 1 for c in owners.values())),
                ("source_ordinal", None in of_source),
                ("source_out_of_range", any(o is not None and not 1 <= o <= n for o in of_source)),
                ("source_mapped_twice", len(set(of_source)) < len(of_source)),
                ("source_anchor", any(not t[3] for t in targets)),
                ("expected_tex", any(not t[4] for t in targets)),
                ("kind", any(t[1] == "other" for t in targets)),
                ("source_coverage", set(of_source) != set(range(1, n + 1))),
                ("final_coverage", set(owners) != set(range(1, finals + 1))),
            )
            if broken
        }
        want += [(k, rule) for rule in rules]
    got = found(spark, "formula_map_errors", "map_id", "rule")
    assert got == sorted(want)
    assert len({rule for _, rule in got}) == 20


def test_formula_map_is_dealt_by_map_once(spark, monkeypatch):
    """Lines are dealt into tasks in a number that follows them, which are not merged; no later step deals rows anew.  Results are the same."""
    want = found(spark, "formula_map_errors", "map_id", "rule")
    monkeypatch.setattr(dealt, "ROWS_A_TASK", 1000)
    plan = catalogue.queries()["formula_map_errors"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), (\w+)", plan)
    assert exchanges and {how for _, how in exchanges} == {"REPARTITION_BY_NUM"}
    assert min(int(n) for n, _ in exchanges) >= 4 * len(table("lineitem")) // 1000
    assert found(spark, "formula_map_errors", "map_id", "rule") == want


def test_formula_map_leaves_out_lines_without_an_order(spark, tmp_path):
    orders, lines = table("orders"), table("lineitem")
    orders[orders.o_orderkey % 3 > 0].to_parquet(tmp_path / "orders.parquet")
    lines = pd.concat([lines, lines.head(3).assign(l_orderkey=None)]).astype({"l_orderkey": "Int64"})
    lines.to_parquet(tmp_path / "lineitem.parquet")
    want = [r for r in found(spark, "formula_map_errors", "map_id", "rule") if r[0] % 3 > 0]
    assert found(spark, "formula_map_errors", "map_id", "rule", folder=tmp_path) == want


def test_page_styles_take_every_order(spark):
    source, working, refused = defaultdict(list), defaultdict(list), set()
    for line in table("lineitem").itertuples():
        source[line.l_orderkey].append((line.l_linenumber, line.l_returnflag))
        if line.l_tax > 0.075:
            refused.add(line.l_orderkey)
        if line.l_discount < 0.09:
            working[line.l_orderkey].append((line.l_linenumber, "none" if line.l_quantity > 40 else line.l_returnflag))
    want = [
        (k, n, old, new) for k, lines in source.items() if k not in refused and len(lines) == len(working[k]) for n, new in lines for m, old in working[k] if n == m and old != new
    ]
    got = found(spark, "page_style_edits", "doc_id", "section", "old", "new")
    assert got == sorted(want)
    assert any(k % 3 for k, *_ in got)


def test_single_owner_takes_every_part(spark):
    owners = defaultdict(Counter)
    for flag, k, n, target in zip(*(table("lineitem")[c].tolist() for c in ("l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey")), strict=True):
        owners[flag, k][target] += 1
        owners[flag, k + n][target] += 1
    want = [(*o, c.total(), len(c)) for o, c in owners.items() if c.total() > 1]
    assert found(spark, "single_owner_violations", "map_id", "ordinal", "owners", "targets") == sorted(want)


def test_reviews_take_every_document(spark):
    inventory = {d.doc_id: hashlib.sha256(d.text.encode()).hexdigest() for d in table("documents").itertuples()}
    reviews = defaultdict(list)
    for label in table("labels").itertuples():
        i = label.doc_id
        if i in inventory:
            reviews[i + (1000000 if i % 40 == 0 else 0)].append(("stale" if i % 14 == 0 else inventory[i], label.quality == 1))
    for i in inventory:
        if i % 26 == 0:
            reviews[i].append((inventory[i], True))
    want = [(i, "missing") for i in inventory if i not in reviews] + [(i, "extra") for i in reviews if i not in inventory]
    want += [(i, "duplicate") for i, r in reviews.items() if len(r) > 1]
    want += [(i, "hash_mismatch") for i, r in reviews.items() if i in inventory and {h for h, _ in r} != {inventory[i]}]
    want += [(i, "not_passed") for i, r in reviews.items() if i in inventory and not all(passed for _, passed in r)]
    got = found(spark, "review_join_errors", "doc_id", "rule")
    assert got == sorted(want)
    assert any(i % 2 for i, _ in got)
    errors = Counter(i for i, _ in want)
    assert found(spark, "finalized_review", "doc_id", "errors", "acceptance_pass") == sorted((i, errors[i], errors[i] == 0) for i in inventory)


def test_alignment_breaks_take_every_line(spark):
    lines = table("lineitem")
    broken = lines[lines.l_returnflag.notna() & lines.l_linestatus.notna() & (lines.l_returnflag != lines.l_linestatus)]
    want = sorted(broken[["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]].itertuples(index=False, name=None))
    assert found(spark, "alignment_breaks", "l_orderkey", "l_linenumber", "before", "after") == want
    assert any(n > 1 for _, n, *_ in want)


def test_requested_takes_every_part(spark):
    parts = table("part")
    want = set(table("lineitem").l_partkey.tolist()) - set(parts[parts.p_size > 10].p_partkey.tolist())
    assert found(spark, "requested_not_available", "ordinal") == sorted((k,) for k in want)
    assert any(k % 2 for k in want)
