"""Operators that SQL cannot express: round trips, held-out accuracy and brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from auditlake.llm import language_id, language_model, license_scan, max_plus, queries, sentencepiece_codec, toxicity
from auditlake.llm._components import connected_components
from helpers import DATA
from pyspark.sql import functions as F

TOKENIZER = queries.TOKENIZER


@pytest.fixture(scope="module")
def pieces():
    return max_plus.Pieces(open(TOKENIZER, "rb").read())


def cut_up(pieces, text, size):
    body = max_plus.marked(text)
    chunks = []
    for p in range(0, len(body), size):
        q = min(len(body), p + size)
        a, b = max(0, p - pieces.longest), min(len(body), q + pieces.longest)
        chunks.append(max_plus.Chunk(pieces, body[a:b], p - a, q - a, p == 0, q == len(body)))
    if not chunks:
        return []
    matrices = [c.matrix() for c in chunks]
    # combination is associative
    if len(matrices) > 2:
        left = max_plus.combine(max_plus.combine(matrices[0], matrices[1]), matrices[2])
        assert np.array_equal(left, max_plus.combine(matrices[0], max_plus.combine(matrices[1], matrices[2])))
    return [n for c, (e, x) in zip(chunks, max_plus.choose(matrices), strict=True) for n in c.trace(e, x)]


def merges(pieces, text):
    """Encoding by definition: of all neighbours that make a piece, the best and leftmost merge first."""
    parts = list(max_plus.marked(text))
    while True:
        ranked = [(-pieces.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in pieces.scores]
        if not ranked:
            return [n for p in parts for n in pieces.numbers(p)]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("text", ["", "a", "hello world, it is", "  two  spaces ", "internationalization of things", "日本語 text", "x" * 70])
def test_encoding_by_definition(pieces, text):
    assert pieces.encode(text) == merges(pieces, text) == (cut_up(pieces, text, 40) if text else [])


def test_own_decoding_equals_the_library(pieces):
    rng = np.random.RandomState(7)
    for _ in range(400):
        ids = [int(i) for i in np.where(rng.rand(8) < 0.5, rng.randint(0, 300, 8), rng.randint(0, 32000, 8))]
        assert pieces.decode(ids) == pieces.lib.decode(ids)


@pytest.mark.parametrize("size", [40, 64, 257])
@pytest.mark.parametrize("text", ["", " ", "a", "x" * 300, "   " * 60 + "a", "日本語のテキスト" * 20, "a\n\nb \t" * 40, "𝔘𝔙 " * 30, "ab▁▁c " * 30, "http://foo.bar/baz?q=1&r=2" * 10, "internationalization of things, " * 12, "ἡ" * 80])
def test_scan_equals_the_library(pieces, text, size):
    assert cut_up(pieces, text, size) == pieces.lib.encode(text)


def test_encode_and_decode(spark, edges, nothing, pieces):
    docs = edges.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").limit(40).select("doc_id", "text", "lang", F.lit(1).alias("n_words"), F.lit(True).alias("kept"), F.lit("c").alias("chunk")))
    for size in (400, 1 << 15):
        got = sentencepiece_codec.encode(docs, TOKENIZER, chunk_chars=size)
        texts = Counter((r.doc_id, r.text) for r in docs.collect())
        seen = Counter()
        for r in sentencepiece_codec.decode(got, TOKENIZER).collect():
            assert (r.ids is None) == (r.decoded is None) and r.round_trip and r.n_ids == len(r.ids or ())
            seen[r.doc_id, r.decoded] += 1
            assert r.ids is None or list(r.ids) == pieces.lib.encode(r.decoded)
        assert seen == texts
    assert sentencepiece_codec.encode(nothing, TOKENIZER).count() == 0


def test_licences(edges, nothing):
    known = license_scan.Recogniser()
    for n, (licence, ids) in enumerate(license_scan.RULES):
        body = "\n".join(license_scan.SENTENCES[i] for i in ids)
        assert [m[0] for m in known.matches(f"Some text\n\n{body}\nMore text.")] == [licence], n
        assert [m[0] for m in known.matches(f"{body.upper()} Released under the MIT License.")][-1] == "MIT"
        assert known.matches(body.replace(" ", " no ", 3)) == [] or len(ids) > 1
    wrapped = license_scan.SENTENCES["mit-grant"].replace(" including", "\n  including")
    rest = [license_scan.SENTENCES[i] for i in ("mit-condition", "mit-disclaimer")]
    assert known.matches("\n\n".join([wrapped, *rest])) == [("MIT", 0, 3)]
    # an order that no rule has, and a gap that is too wide, are no licence
    assert known.matches("\n".join([rest[0], wrapped])) == []
    assert known.matches("\n".join([wrapped, "a.", "b.", "c.", *rest])) == []
    got = license_scan.scan_licences(edges)
    assert got.count() == edges.count() and got.where("n_matches > 0").count() == 0
    assert license_scan.scan_licences(nothing).count() == 0


def test_licence_lines_in_documents(spark):
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: sorted({v for k, v in lines.items() if k in r.text.split("\n")}) for r in docs.collect()}
    got = {r.doc_id: r.licences for r in queries.op4_license_scans(spark, DATA).collect()}
    assert all(set(want[i]) <= set(got[i]) for i in want) and any(want.values())


def test_language_accuracy_on_held_out_documents(spark, edges, nothing):
    folder = DATA.replace("sf0.001", "sf0.01")
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_language_id(spark, folder).join(lang, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98
    model = language_id.train(spark.read.parquet(f"{folder}/documents.parquet"))
    found = {r.doc_id: r for r in language_id.identify(edges, model).collect()}
    assert [found[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and found[2].score == 0 and found[9].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(edges, language_id.train(nothing)).collect()} == {"und"}


def test_language_model_is_a_distribution():
    counts = {}
    for lang, text in (("a", "abba baab abab"), ("b", "cdcd ddcc dcab")):
        owners, parts = next(language_id._pieces([text]))
        codes, starts, ends, *_ = language_id._words(owners, parts)
        grams, _ = language_id._positions(codes, starts, ends)
        _, at, n = np.unique(language_id.gram_keys(grams, 4), return_index=True, return_counts=True)
        counts[lang] = grams[at], n
    model = language_id.fit(counts)
    alphabet = [ord(c) for c in "abcd"] + [language_id._END]
    for history in ("", "a", "ab", "abb", "zzz", "dc"):
        past = ([language_id._START] * 3 + [ord(c) for c in history])[-3:]
        p = 10.0 ** model.score(np.array([[*past, c] for c in alphabet], np.uint32))
        assert (p.sum(axis=0) < 1.0001).all() and (p.sum(axis=0) > 0.75).all()


def test_toxicity_on_held_out_documents(spark, edges, nothing):
    folder = DATA.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    graded = labels.select("doc_id", F.col("toxic").alias("grade"))
    model = toxicity.train(docs, graded.where("doc_id % 3 <> 0"), 2, split=True)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs.where("doc_id % 3 = 0"), model).join(graded, "doc_id")
    hit, bad, false, clean = got.agg(*(F.expr(f"count_if({c})") for c in ("toxic and grade = 1", "grade = 1", "toxic and grade = 0", "grade = 0"))).first()
    assert hit > 0.8 * bad and false < 0.02 * clean
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == edges.count() and not any(r.toxic for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(edges, toxicity.train(nothing, graded.where("false"), 2)).count() == edges.count()


def test_ordinal_fit_recovers_the_order():
    rng = np.random.RandomState(1)
    rows = []
    for _ in range(900):
        on = rng.rand(6) < 0.4
        grade = min(3, int(on[:3].sum()))
        rows.append((grade, np.flatnonzero(on).astype(np.uint64) + np.uint64(10)))
    model = toxicity.fit(rows, 4, least_z=3)
    assert (np.diff(model.thresholds) > 0).all()
    margin = np.array([model.weights[np.isin(model.features, h)].sum() for _, h in rows])
    severity = model.above(margin).sum(axis=1)
    means = [severity[[g == k for g, _ in rows]].mean() for k in range(4)]
    assert all(a < b for a, b in zip(means, means[1:], strict=False))


def test_language_model_scores(spark, edges, nothing):
    got = queries.op9_lm_scoring(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    counts = Counter(w for r in got if not r.held_out for w in tokens[r.doc_id])
    total, kinds = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own), rel_tol=1e-9)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    rows = language_model.score(edges, F.col("doc_id") > 5).collect()
    assert len(rows) == edges.count()
    same = [r for r in rows if r.doc_id == 11]
    assert same[0] == same[1] and [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert language_model.score(nothing, F.lit(True)).count() == 0
    assert language_model.score(edges, F.lit(False)).agg(F.max("n_known")).first()[0] == 0


def test_scores_are_a_property_of_the_documents(spark, edges):
    """However the rows are split, scores are the same to the last bit."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    learned = F.col("doc_id") % 5 != 2
    one, two = ({r.doc_id: tuple(r) for r in language_model.score(d, learned).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two and len(one) == docs.count()


def test_first_step_by_products_equals_the_sums():
    rng = np.random.RandomState(5)
    texts = [" ".join(f"w{rng.randint(400)}" for _ in range(200)) for _ in range(20)]
    hashes, _ = language_model.tokens(texts)
    words, counts = np.unique(hashes, return_counts=True)
    cell = (words & np.uint64(language_model.CELLS - 1)).astype(int)
    n, v = (np.bincount(cell, weights=x, minlength=language_model.CELLS).astype(np.int64) for x in (counts, np.ones(len(words))))
    model = language_model.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), n, v, 2048)
    one, two = language_model.Sums(model), language_model.Sums(model)
    two.fresh = False
    for sums in (one, two):
        sums.add(texts)
        sums.settle()
    assert (one.observed == two.observed).all() and (one.expected == two.expected).all() and one.observed.sum() == 6 * len(hashes)


def brute_model(texts, size, steps_of):
    """The model of a few texts with dictionaries: log10 probability of any text, word by word."""
    L = language_model

    def split(text):
        hashes, _ = L.tokens([text])
        return [int(h) for h in hashes]

    counts = Counter(h for t in texts for h in split(t))
    own = {h: i for i, h in enumerate(sorted(counts, key=lambda h: (-counts[h], np.uint64(h).astype(np.int64)))[: L.OWN])}
    cell = lambda h: own.get(h, h % L.CELLS)
    n, v = Counter(), Counter()
    for h, c in counts.items():
        n[cell(h)] += c
        v[cell(h)] += 1
    weights = {}

    def softmax(level, c1, rows):
        group = range(L.CLASSES)
        sizes = [n[c1 * L.CLASSES + k] if level else sum(n[k * L.CLASSES + j] for j in group) for k in group]
        z = [math.log((m + 1) / (sum(sizes) + L.CLASSES)) + sum(weights.get((level, f, r, k), 0.0) for f, r in enumerate(rows)) for k, m in enumerate(sizes)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    def each(text):
        past = [0, 0]
        for h in split(text):
            c1, c2 = divmod(cell(h), L.CLASSES)
            mixed = [int(L.H.mix(np.array([x % 2**64], np.uint64))[0]) for x in (past[1] + 1, past[0] + 2, past[1] * 3 + past[0] + 3)]
            deep = [int(L.H.mix(np.array([(x + (c1 + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) for x in mixed]
            yield h, c1, c2, [x % size for x in mixed], [x % size for x in deep]
            past = [past[1], h]

    for part in steps_of:
        seen, hoped = Counter(), Counter()
        for t in part:
            for _, c1, c2, one, two in each(t):
                for level, target, rows in ((0, c1, one), (1, c2, two)):
                    for k, p in enumerate(softmax(level, c1, rows)):
                        for f, r in enumerate(rows):
                            hoped[level, f, r, k] += p
                            seen[level, f, r, k] += k == target
        for key, e in hoped.items():
            weights[key] = weights.get(key, 0.0) + L.RATE * (seen[key] - e) / ((seen[key] + e) / 2 + L.PRIOR)

    def score(text):
        total = 0.0
        for h, c1, c2, one, two in each(text):
            k = cell(h)
            inside = 1.0 if h in own else (counts[h] + 1) / (n[k] + v[k] + 1)
            total += math.log10(softmax(0, c1, one)[c1] * softmax(1, c1, two)[c2] * inside)
        return total

    return score


def test_language_model_against_brute_force(spark):
    rng = np.random.RandomState(4)
    texts = [" ".join(f"w{rng.zipf(1.15) % 5000}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert len({w for t in texts for w in t.split()}) > language_model.OWN + 100
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    share = {r.doc_id: r.s for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sum(language_model.SHARES))).alias("s")).collect()}
    learned = [i for i in range(60) if i % 4]
    score = brute_model([texts[i] for i in learned], language_model.LEAST_ROWS, [[texts[i] for i in learned if at <= share[i] < at + size] for at, size in zip(np.cumsum([0, *language_model.SHARES]), language_model.SHARES, strict=False)])
    got = {r.doc_id: r for r in language_model.score(rows, F.col("doc_id") % 4 != 0).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i].score, score(t), rel_tol=1e-3), i
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_components(spark):
    rng = np.random.RandomState(2)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 120, (80, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 301 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got, hubs = ({r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hub=h).collect()} for h in (1 << 20, 3))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == hubs == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_against_brute_force(spark, pieces):
    import corpus_pipeline
    from test_exact import brute_groups

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "substring dedup", "decontamination", "sentencepiece"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    quality = {r.doc_id for r in queries.op6_quality_rules(spark, DATA).collect() if r.kept}
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in quality]
    groups = {d: c for d, _, c in brute_groups(texts)}
    kept = [(i, t) for i, t in texts if groups[i] == i]
    least, out = {}, []
    for i, t in kept:
        words = t.split()
        for j in range(len(words) - 12):
            least.setdefault(tuple(words[j : j + 13]), i)
    for i, t in kept:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        words, gone = [t[a:b] for a, b in spans], [False] * len(spans)
        for j in range(len(words) - 12):
            if least[tuple(words[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        if any(gone):
            # from a removed word up to the next kept one, or the end, all goes
            body, at = "", 0
            for n, (a, _) in enumerate(spans):
                if gone[n] and not (n and gone[n - 1]):
                    body += t[at:a]
                if not gone[n] and n and gone[n - 1]:
                    at = a
            t = body if gone[-1] else body + t[at:]
        if not gone or not all(gone):
            out.append((i, t))
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[j : j + min(10, len(w))]) for w in items for j in range(len(w) - min(10, len(w)) + 1) if w}
    want = {}
    for i, t in out:
        lower = low(t)
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
        words, hit = [lower[a:b] for a, b in spans], [False] * len(spans)
        for size in {len(w) for w in windows}:
            for j in range(len(words) - size + 1):
                if tuple(words[j : j + size]) in windows:
                    hit[j : j + size] = [True] * size
        if hit and all(hit):
            continue
        for n in range(len(spans) - 1, -1, -1):
            if hit[n] and not (n + 1 < len(hit) and hit[n + 1]):
                first = n
                while first and hit[first - 1]:
                    first -= 1
                t = t[: spans[first][0]] + t[spans[n][1] :]
        want[i] = t
    assert set(got) == set(want)
    for i, t in want.items():
        assert list(got[i].ids) == pieces.lib.encode(t), i


def test_near_dedup_judges_rows_of_repeated_ids_by_their_own_text(spark):
    """Against groups by brute force, where ids repeat with copies, near copies and unlike texts."""
    import corpus_pipeline
    from test_exact import brute_groups

    rng = np.random.RandomState(6)
    bases = [[f"{b}w{i}" for i in range(90)] for b in "abcdef"]
    near = lambda b, n: " ".join(w if i % 89 or not n else f"x{n}" for i, w in enumerate(bases[b]))
    rows = [(0, near(1, 0)), (1, near(0, 0)), (1, near(1, 0)), (2, near(0, 0)), (3, near(2, 1)), (3, near(2, 2)), (3, near(2, 1)), (4, near(3, 0)), (4, near(4, 0)), (4, near(4, 1)), (5, near(3, 0))]
    rows += [(9, ""), (9, " "), (9, None), (9, ""), (None, near(0, 0)), (None, near(0, 0))]
    rows += [(int(rng.randint(10, 30)), near(rng.randint(6), rng.randint(3))) for _ in range(60)]
    told = brute_groups(rows)
    groups: dict = {}
    # brute groups by text, so that components that begin with one id are told apart
    texts = sorted({t for _, t in rows if (t or "").split()})
    parts = {t: c for (_, _, c), t in zip(sorted(brute_groups([(n, t) for n, t in enumerate(texts)])), texts, strict=True)}
    for i, t in rows:
        if i is not None and (t or "").split():
            groups.setdefault(parts[t], []).append((i, hashlib.sha256(t.encode()).hexdigest(), t))
    want = [min(g)[::2] for g in groups.values()] + [(9, ""), (9, " "), (9, None)] + [r for r in rows if r[0] is None]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert got.columns == docs.columns and len(told) == len(rows)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_stages_keep_clashing_columns(spark, edges, nothing):
    import corpus_pipeline

    for docs in (edges, nothing):
        rows = {(r.doc_id, r.text): r for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.dtypes == docs.dtypes, name
            for r in out.collect():
                old = rows.get((r.doc_id, r.text))
                assert old is None or (r.n_words, r.kept, r.chunk) == (old.n_words, old.kept, old.chunk), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
