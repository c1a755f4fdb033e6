"""Vector search, conversation repair and periodic runs by brute force, with the edge cases their docstrings state."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from auditlake.llm import conversation_repair as C
from auditlake.llm import queries
from auditlake.llm.periodic_runs import periodic_runs
from auditlake.llm.vector_search import top_k
from helpers import DATA
from pyspark.sql import functions as F


def brute_top(rows, every, k):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    bound = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for a, (i, v) in enumerate(whole):
        if i is not None and i % every == 0:
            scored = sorted((-bound(sum(x * y for x, y in zip(v, w))), j is None, j or 0) for b, (j, w) in enumerate(whole) if b != a)
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [1 << 18, 300])
def test_top_k(spark, monkeypatch, cells):
    monkeypatch.setattr("auditlake.llm.vector_search._CELL", cells)
    rng = np.random.RandomState(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # ties across cells
    rows += [(10, rows[10][1]), (10, rows[10][1]), (10, rows[11][1])]  # repeated ids, one a repeated row
    rows += [(None, rows[20][1]), (None, rows[20][1]), (301, None), (310, [1.0, None]), (320, [float("nan")]), (330, [float("inf"), 1.0])]
    rows += [(340, []), (350, [3.0]), (360, [0.5] * 40), (-10, [-1.0] * 12), (370, [1e5, -1e5]), (380, [2.0**40, 1.0]), (390, [2.0**41])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = top_k(df, F.col("vec_id") % 10 == 0, 5)
    assert sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=repr) == brute_top(rows, 10, 5)


def test_top_k_small(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(5, [1.0]), (6, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(one, F.col("vec_id") % 5 == 0).collect()] == [(5, 1, 6, 512 * 256)]
    with pytest.raises(ValueError):
        top_k(one, F.col("vec_id") > 0, 0)


def brute_repair(rows):
    """By trying all states after each row; rows are (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    counts, seen, pairs, states = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), 0, {"": (0, "", ())}

    def inserted(states):
        for _ in range(3):
            new = dict(states)
            for s, (cost, audit, lines) in states.items():
                role = "assistant" if s == "u" else "user"
                way = (cost + 3, audit + "I", (*lines, f"{role}:"))
                new[role[0]] = min(new.get(role[0], way), way)
            states = new
        return states

    for n, (_, role, text) in enumerate(rows):
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        pairs += n > 0 and rows[n - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        new = {}

        def put(s, way, new=new):
            new[s] = min(new.get(s, way), way)

        for s, (cost, audit, lines) in inserted(states).items():
            put(s, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                to = "assistant" if s == "u" else "user"
                put(to[0], (cost + 3 + more, audit + "R", (*lines, f"{to}:{text}")))
                if role[:1] == to[0] or (s == "" and role[:1] == "s"):
                    put(role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        states = new
    cost, audit, lines = min(v for s, v in inserted(states).items() if s in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(seed, many):
    rng, out = random.Random(seed), []
    for c in [None, *range(many)]:
        for t in range(rng.choice([1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", " \n", None, "Yes.", "No", "Why? ", "é…", f"t{t}!", f"t{t}"])
            turn = rng.choice([t, t, t, t - 1, t + 7, None])
            out += [(c, turn, role, text)] * rng.choice([1, 1, 1, 1, 2, 5])
    return out


@pytest.mark.parametrize("coalesced", [True, False])
def test_repair(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        _repairs(spark, int(coalesced))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _repairs(spark, seed):
    rows = conversations(seed, 60)
    rows += [(99, t, "user" if t % 2 else "assistant", f"{t}." if t % 5 else "same.") for t in range(700)]  # over several tasks
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(3)
    conversations_, turns = C.repair(df)
    got = {r.conv_id: tuple(r)[1:] for r in conversations_.collect()}
    by = {c: [r[1:] for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert got.keys() == by.keys()
    for c, of in by.items():
        assert got[c] == brute_repair(of), (c, of)
    texts = {}
    for r in sorted(turns.collect(), key=lambda r: r.piece):
        texts.setdefault(r.conv_id, []).extend(f"{x.role}:{x.text}" for x in r.lines)
    for c in by:
        assert hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == got[c][-1]


def test_repair_pieces():
    """Matrices of any cut give one result, and the audit of the whole."""
    rng = random.Random(8)
    for _ in range(200):
        kinds = "".join(rng.choice("duasUASoO") for _ in range(rng.randint(0, 40)))
        whole = C.scan(kinds)
        a, b = sorted(rng.randint(0, len(kinds)) for _ in range(2))
        assert C.product(C.scan(kinds[:a]), C.product(C.scan(kinds[a:b]), C.scan(kinds[b:]))) == whole
        folded = C.ONE
        for k in kinds:
            folded = C.product(folded, C.turn(k))
        assert folded == whole


def test_fold_in_pieces():
    """What a task does with a conversation longer than a piece: the same as in one piece."""
    rows = [(t, "user" if t % 3 else "assistant", f"{t}." if t % 4 else "x", t % 3 + 1) for t in range(50)]

    def summed(size):
        fold, lines, total = C._Fold(1, True), [], None
        for t, role, text, copies in rows:
            fold.take(t, role, text, copies, False, text == "x", (t, role, text))
            if len(fold.kinds) >= size:
                lines += fold.cut()["lines"]
        piece, total = fold.end(True)
        return lines + piece["lines"], {k: v for k, v in total.items() if k != "what"}

    assert summed(4) == summed(10**6)


def test_repair_nothing(spark):
    found, turns = C.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.count() == 0 and turns.count() == 0


def test_repair_query_keeps_dropped(spark, tmp_path):
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "A.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    (row,) = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def brute_runs(words, shortest=24, times=3):
    got = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q) and j > i:
                got.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in got.items())


def collapsed(words, runs):
    gone = set(itertools.chain.from_iterable(range(a + q, a + n) for a, n, q in runs))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("shortest", "times"), [(24, 3), (7, 3), (1, 4)])
def test_periodic_runs(spark, shortest, times):
    rng, rows = random.Random(shortest), [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (None, "b " * 30), (6, "b " * 30), (6, "b " * 30), (7, " x\x0by\x1cz" * 40), (8, "a " * 90000), (9, "é" * 70000)]
    rows.append((10, " ".join([f"v{i}" for i in range(9000)] * 3)))
    for n in range(150):
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.randint(0, 200))]
        if n % 5 == 0:
            words = (["a"] * rng.randint(1, 60) + ["b"]) * rng.randint(1, 8) + words + ["a"] * rng.randint(0, 90)
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(len(words) + 1), rng.randint(1, 40)
            for i in range(a + p, min(len(words), a + 150)):
                words[i] = words[i - p]
        rows.append((100 + n, " ".join(words)))
    df = spark.createDataFrame([(*r, 3, "c") for r in rows], "doc_id long, text string, runs int, `Collapsed_Text` string")
    got = periodic_runs(df, shortest, times)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed_text"]
    for r in got.collect():
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        runs = [tuple(x) for x in r.runs]
        assert r.n_words == len(words)
        if len(words) < 20000:
            assert runs == brute_runs(words, shortest, times)
        elif r.doc_id == 10:
            assert (0, 27000, 9000) in runs if times == 3 else runs == []
        else:
            assert runs == [(0, 90000, 1)]
        assert r.collapsed_text == collapsed(words, runs)
    assert periodic_runs(df.limit(0)).count() == 0


def test_periodic_query(spark):
    import re
    import zlib
    from fractions import Fraction

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, DATA).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        if n > 4000:
            continue
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        milli = None if not runs else 1000 * best[1] // best[2]
        told = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        kept = hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        assert tuple(r) == (r.doc_id, len(runs), *best, milli, told, kept)
    assert planted > 5
