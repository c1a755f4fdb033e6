"""Operators whose results SQL or a brute-force version can tell exactly."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from auditlake.llm import decontamination, fm_index, near_duplicates, queries, substring_dedup
from auditlake.llm import quality_rules as Q
from auditlake.llm import url_filter as U
from helpers import DATA, agrees
from hypothesis import given, settings
from hypothesis import strategies as st

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, duck):
    agrees(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name])


def brute_removed(rows, size=13):
    least = {}
    for i, t in rows:
        words = re.findall(SPACE, t or "")
        for j in range(len(words) - size + 1):
            key = tuple(words[j : j + size])
            least[key] = min(least.get(key, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        words = re.findall(SPACE, t or "")
        gone = [False] * len(words)
        for j in range(len(words) - size + 1):
            if least[tuple(words[j : j + size])] < (1 << 62 if i is None else i):
                gone[j : j + size] = [True] * size
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_edges(edges, nothing, monkeypatch):
    monkeypatch.setattr(substring_dedup, "chunk_bytes", lambda total: 2000)
    got = substring_dedup.remove_repeats(edges)
    assert got.columns[:2] == ["doc_id", "text"] and "chunk" in got.columns
    rows = got.collect()
    want = brute_removed([(r.doc_id, r.text) for r in edges.collect()])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr) == want
    for r in rows:
        assert (r.kept_text is None) == (r.text is None)
        assert sum(s.n_words for s in r.repeats) == r.n_removed
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_many_copies(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "chunk_bytes", lambda total: 3000)
    rng = np.random.RandomState(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(150):
        words = [f"w{rng.randint(40)}" for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            at = rng.randint(len(words))
            words[at:at] = passage.split()[rng.randint(10) : 60 - rng.randint(10)]
        rows.append((i, " ".join(words)))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == brute_removed(rows)


def brute_groups(rows):
    sets = {}
    for n, (i, t) in enumerate(rows):
        words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[n] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {n: n for n in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a]:
                continue
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for n in sets:
        groups[find(n)].append(rows[n][0])
    return sorted(((rows[n][0], len(sets[n]), None if rows[n][0] is None else min(groups[find(n)])) for n in sets), key=repr)


def test_near_duplicates_edges(edges, nothing):
    got = near_duplicates.near_duplicates(edges).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups([(r.doc_id, r.text) for r in edges.collect()])
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_near_duplicates_hot_group(spark):
    """A group of near copies of one text, copies of copies, truncated ones, and a passage that unrelated texts share."""
    rng = np.random.RandomState(5)
    base = [f"b{i}" for i in range(150)]
    passage = [f"s{i}" for i in range(30)]
    rows, texts = [], [base]
    for _ in range(90):
        words = list(texts[rng.randint(min(len(texts), 12))])
        for _ in range(rng.randint(0, 5)):
            at, kind = rng.randint(len(words)), rng.randint(3)
            if kind == 0:
                words[at] = f"e{rng.randint(10**6)}"
            elif kind == 1:
                del words[at : at + rng.randint(1, 8)]
            else:
                words[at:at] = [f"e{rng.randint(30)}"]
        texts.append(words)
    for _ in range(60):
        own = [f"u{rng.randint(10**6)}" for _ in range(rng.randint(3, 120))]
        texts.append(own[:2] + passage + own[2:])
    rows = [(int(i), " ".join(w)) for i, w in zip(rng.permutation(len(texts)), texts, strict=True)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_every_occurrence(body, phrases):
    index = fm_index.FMIndex(np.array(body), 6, step=3)
    width = max(map(len, phrases))
    table = np.zeros((len(phrases), width), np.int64)
    for row, p in zip(table, phrases, strict=True):
        row[width - len(p) :] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(body)) if body[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_edges(spark, edges, nothing, monkeypatch):
    items = [(1, "Beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu"), (2, "same row"), (3, None), (4, "..."), (None, "one"), (2, "nu xi omicron pi rho sigma tau upsilon phi chi psi")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def brute(text):
        words, hit, found = re.findall(word, lower(text)), set(), set()
        for item, t in items:
            own = re.findall(word, lower(t))
            m = min(10, len(own))
            for j in range(len(own) - m + 1 if m else 0):
                for i in range(len(words) - m + 1):
                    if words[i : i + m] == own[j : j + m]:
                        hit.update(range(i, i + m))
                        found |= {str(item)} if item is not None else set()
        return len(words), len(hit), sorted(found)

    for block in (8 << 20, 20):  # one block, and several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        got = decontamination.decontaminate(edges, benchmark).collect()
        assert len(got) == edges.count()
        for r in got:
            n, hit, found = brute(r.text)
            assert (r.n_words, r.n_hit, r.item_ids, r.n_items, r.contaminated) == (n, hit, found, len(found), hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert (r.clean_text is None) == (r.text is None)
            assert r.text is None or len(re.findall(word, lower(r.clean_text))) == n - hit
        assert decontamination.decontaminate(nothing, benchmark).count() == 0
    assert decontamination.decontaminate(edges, benchmark.where("false")).where("contaminated").count() == 0


def test_quality_edges(edges, nothing):
    got = Q.quality_rules(edges).collect()
    assert len(got) == edges.count()
    by = {r.doc_id: r for r in got}
    assert by[2].base_failed and by[2].n_words == 0 and not by[2].kept
    assert by[10].n_words == 5100 and by[10].n_repeat_words == 5100 and by[10].base_failed
    assert by[9].word_chars == 70000
    assert Q.quality_rules(edges).where("kept").count() == sum(r.kept for r in got)
    assert Q.quality_rules(nothing).count() == 0


def test_urls(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q=1", "http://example.com/en/6", "x.com/en/", None, "a://b.net/de/", "a://b.example.net/de/8#/x", "a://notexample.net/de/8", "://c.org", "a://b://c.org/es/", "a://x.org\n/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(7, None), (None, True), (0, True)], "page_id long, bad boolean")
    got = {r.page_id: r for r in U.filter_urls(pages, outcomes).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[1].rule, got[1].verdict) == ("com/en/", "block")
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (2, 3)] == [("", "", None, "allow")] * 2
    assert [got[i].rule for i in (4, 5, 6, 7)] == ["net/de/", "example.net/de/8", "net/de/", None]
    assert (got[8].host, got[8].path) == ("b:", "//c.org/es/")
    assert U.filter_urls(pages.where("false"), outcomes.where("false")).count() == 0


def test_host_reputation_shrinks(spark):
    rows = [("a.big.com", i < 80) for i in range(100)] + [("b.big.com", True)] + [("c.good.com", i < 2) for i in range(100)] + [("d.good.com", True)] + [("e.other.org", False)] * 20
    got = {r.host: r for r in U.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    # one bad page says little: a host of a bad domain stays bad, a host of a good one stays good
    assert got["a.big.com"].mean > 0.7 and 0.7 < got["b.big.com"].mean < 1
    assert 0 < got["c.good.com"].mean < got["d.good.com"].mean < 0.2


def test_unlabelled_hosts_take_the_judgement_of_their_domain(spark):
    labelled = [("a.bad.xyz", i < 95) for i in range(100)] + [("b.bad.xyz", i < 97) for i in range(100)] + [("a.fine.xyz", False)] * 300 + [("a.foul.biz", True)] * 100 + [("a.good.dev", i < 2) for i in range(300)]
    fresh = ["new.bad.xyz", "new.fine.xyz", "new.other.biz", "new.good.dev", "new.unseen.top"]
    urls = [f"http://{h}/x" for h, _ in labelled] + [f"http://{h}/x" for h in fresh]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(labelled)], "page_id long, bad boolean")
    rows = U.filter_urls(pages, outcomes).collect()
    got = {r.host: r for r in rows}
    assert len(rows) == len(urls)
    # a bad domain and a bad suffix block hosts never seen
    assert [got[h].verdict for h in fresh[:4]] == ["block", "allow", "block", "allow"]

    # by hand: each level shrunk to the one above, no labels of its own at the last
    def strength(groups):
        k, n, x = len(groups), sum(g[0] for g in groups), sum(g[1] for g in groups)
        q = (x + 1) / (n + 2) * (1 - (x + 1) / (n + 2))
        room = n - sum(g[0] ** 2 for g in groups) / n - (k - 1)
        return 1 / min(0.5, max(0.01, (sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - q * (k - 1)) / (q * room))) - 1

    overall = (294 + 1) / (900 + 2)
    tlds = {"xyz": (500, 192, overall), "biz": (100, 100, overall), "dev": (300, 2, overall)}
    m = strength(list(tlds.values()))
    top = {k: (x + m * mu) / (n + m) for k, (n, x, mu) in tlds.items()}
    domains = {"bad.xyz": (200, 192, top["xyz"]), "fine.xyz": (300, 0, top["xyz"]), "foul.biz": (100, 100, top["biz"]), "good.dev": (300, 2, top["dev"])}
    m = strength(list(domains.values()))
    mean = {k: (x + m * mu) / (n + m) for k, (n, x, mu) in domains.items()}
    m = strength([(100, 95, mean["bad.xyz"]), (100, 97, mean["bad.xyz"]), (300, 0, mean["fine.xyz"]), (100, 100, mean["foul.biz"]), (300, 2, mean["good.dev"])])
    for host, mu in zip(fresh, (mean["bad.xyz"], mean["fine.xyz"], top["biz"], mean["good.dev"], overall), strict=True):
        assert abs(got[host].bad_bound - (mu - 1.6448536269514722 * (mu * (1 - mu) / (m + 1)) ** 0.5)) < 1e-9


def test_only_texts_that_pairs_name_are_moved(spark):
    from auditlake.llm import near_duplicates as N
    from auditlake.llm._frames import stored

    texts = stored(spark.createDataFrame([(i, f"a b c d e f {i % 2}") for i in range(9)], "cls long, text string"), "t")
    pairs = stored(spark.createDataFrame([(1, 3), (2, 3)], "a long, b long"), "p")
    found = N._compared(pairs, texts, 5, 85, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2
    assert sorted(map(tuple, found.collect())) == [(1, 3, True), (2, 3, False)]


def test_a_small_memory_gives_the_same_pieces_and_stays_small():
    from auditlake.llm import max_plus

    with open("/opt/tokenizers/piece_bpe_32k.model", "rb") as f:
        proto = f.read()
    text = " ".join(f"word{i}le unfound{i % 7}ation" for i in range(400))
    whole, little = max_plus.Pieces(proto), max_plus.Pieces(proto, held=8)
    assert little.encode(text) == whole.encode(text) == whole.lib.encode(text)
    assert len(little._words) <= 8 and len(little._pairs) <= 8


def test_a_hot_group_of_copies_is_split_by_few_centres(spark, monkeypatch):
    """Rows made of differences; the group's own members are centres of many of its lists."""
    rng = np.random.RandomState(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randint(len(words))] = f"e{rng.randint(40)}"
        rows.append((i, " ".join(words)))
    counts, stored = Counter(), near_duplicates.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows)
    assert counts["split"] < 20 * len(rows)


def test_parts_that_no_piece_joins_are_found_once(monkeypatch):
    from auditlake.llm import max_plus

    with open("/opt/tokenizers/piece_bpe_32k.model", "rb") as f:
        pieces = max_plus.Pieces(f.read())
    asked, first = [], max_plus.Pieces._first
    monkeypatch.setattr(max_plus.Pieces, "_first", lambda self, word: asked.append(word) or first(self, word))
    ends = [f"{a},{b}" for a in ("ting", "thre", "é", "日本", "x") for b in ("erth", "ou", "ß", "\n", "語", "")]
    text = " ".join(f"{a};{b}" for a in ends for b in ends)
    assert pieces.encode(text) == pieces.lib.encode(text)
    assert len(asked) == len(set(asked)) < len(ends) ** 2 / 4


def test_members_that_lie_equally_far_are_not_split_again_and_again(spark, monkeypatch):
    """Members of a group that share no edits: a split leaves nearly all of a list, so it is not repeated; small lists with many members in one component are no large ones."""
    rng = np.random.RandomState(3)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.randint(0, 13)):
            words[rng.randint(len(words))] = f"e{rng.randint(10**6)}"
        rows.append((i, " ".join(words)))
    names, stored = Counter(), near_duplicates.stored
    monkeypatch.setattr(near_duplicates, "stored", lambda df, name: names.update([name]) or stored(df, name))
    monkeypatch.setattr(near_duplicates, "SMALL", 2)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows)
    assert names["differences"] <= 4
