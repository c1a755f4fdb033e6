"""Periodic runs: stretches of words that repeat with one period, found by matching aligned blocks.

A run of period q and length L has L - q >= 2 B - 1 for the power of two B with B <= q < 2 B (and for the
smallest B where q < B), so it holds a block of B words that starts at a multiple of B and stands again q words
later, still within the run.  For every B the aligned blocks become integer-sequence keys of an Aho-Corasick
automaton, the document is searched with it, and an occurrence that follows its block at a distance of that scale
is a seed.  A seed is extended word by word to both sides; the result is exact.

Blocks that cannot have a seed are no keys: each gram of a block must stand again within 2 B words, and a block
within a run of a short period stands again at its multiples only.  Scales and distances rise, so a seed within a
run whose period divides its distance adds nothing and is passed over.

Words are compared as dictionary numbers of the batch, not as hashes.  Nothing is shuffled: a document is one
task's work, in time about n log n (longer where long periods are made of stretches of short ones).
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm._frames import checked_name
from auditlake.llm._hashing import mix

_SPACES = " \t\n\x0b\x0c\r"
_SLICE = 4 << 20
_FAR = np.int64(1 << 62)
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _distances(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Words to the next gram of ``size`` words with the same hash in the same document, at most the true distance."""
    far = np.full(len(words), _FAR)
    count = len(words) - size + 1
    if count < 2:
        return far
    each, grams = mix(words.astype(np.uint64) + np.uint64(1)), np.zeros(count, np.uint64)
    for j in range(size):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + each[j : j + count]
    order = np.argsort(grams, kind="stable")
    here, after = order[:-1], order[1:]
    same = (grams[here] == grams[after]) & (doc[here] == doc[after])
    far[here[same]] = after[same] - here[same]
    whole = doc[:count] == doc[size - 1 :]
    far[:count][~whole] = _FAR
    return far


def _seeds(words: np.ndarray, starts: np.ndarray, size: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and start of every aligned block that stands again ``low`` to 2 ``size`` - 1 words later."""
    plain = words.tolist()
    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number = np.full(len(words) // size + 1, -1)
    for s in starts.tolist():
        key = tuple(plain[s : s + size])
        number[s // size] = keys.get(key, len(keys))
        keys.add_word(key, int(number[s // size]))
    keys.make_automaton()
    # what lies in no block's reach need not be searched
    reach = np.zeros(len(words) + 1, np.int64)
    np.add.at(reach, starts, 1)
    np.add.at(reach, np.minimum(starts + 3 * size, len(words)), -1)
    edges = np.flatnonzero(np.diff(np.cumsum(reach) > 0, prepend=False)).tolist()
    hits = [(a + end, k) for a, b in zip(edges[0::2], edges[1::2], strict=True) for end, k in keys.iter(tuple(plain[a:b]))]
    hits = np.array(hits, np.int64).reshape(-1, 2)
    at, which = hits[:, 0] - size + 1, hits[:, 1]
    found = []
    for back in (0, size):  # at most two aligned starts lie in reach before an occurrence
        s = (at - low) // size * size - back
        ok = (s >= 0) & (at - s < 2 * size)
        ok[ok] = number[s[ok] // size] == which[ok]
        found.append(np.stack([at[ok] - s[ok], s[ok]]))
    distance, start = np.concatenate(found, axis=1)
    order = np.lexsort((start, distance))
    return distance[order], start[order]


def _extended(words: np.ndarray, start: int, size: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``start`` that keeps ``period``, compared in steps that double."""
    left, step = start, 64
    while left > 0:
        to = max(0, left - step)
        unlike = np.flatnonzero(words[to:left] != words[to + period : left + period])
        if len(unlike):
            left = to + int(unlike[-1]) + 1
            break
        left, step = to, 2 * step
    right, step, end = start + size, 64, len(words) - period
    while right < end:
        to = min(end, right + step)
        unlike = np.flatnonzero(words[right:to] != words[right + period : to + period])
        if len(unlike):
            right += int(unlike[0])
            break
        right, step = to, 2 * step
    return left, right + period


def runs_of(words: np.ndarray, near: np.ndarray, shortest: int, times: int, block: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one document, by start, then period."""
    n, size, found = len(words), block, []
    within: dict[int, list[tuple[int, int]]] = {}
    while n >= shortest and times * (low := 1 if size == block else size) <= n:
        count = n // size
        blocks = near[: count * size].reshape(count, size)[:, : size - block + 1].max(axis=1) < 2 * size
        starts = np.flatnonzero(blocks) * size
        for start, length, period in found:
            if 2 * period <= size:
                end = start + length
                inside = (starts >= start) & (starts + 3 * size <= end)
                if size >= max(shortest, times * period):
                    # across the end of its run a block stands again in another run of that period only
                    others = [l for l, r in within[period] if l > start and r - l >= size]
                    inside |= (starts >= start) & (starts + size <= end) & (starts + 3 * size <= min(others, default=len(words) + 3 * size))
                starts = starts[~inside]
        if len(starts):
            distance, start = _seeds(words, starts, size, low)
            cuts = np.flatnonzero(np.diff(distance, prepend=-1)).tolist() + [len(distance)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                d, group = int(distance[a]), start[a:b]
                if times * d > n:
                    break
                for period, spans in within.items():
                    if d % period == 0:
                        for l, r in spans:
                            group = group[(group < l) | (group + d + size > r)]
                while len(group):
                    l, r = _extended(words, int(group[0]), size, d)
                    if r - l >= max(shortest, times * d):
                        found.append((l, r - l, d))
                        within.setdefault(d, []).append((l, r))
                    group = group[group + d + size > r]
        size *= 2
    return sorted(found, key=lambda x: (x[0], x[2]))


def _slice(texts: pa.Array, shortest: int, times: int, block: int) -> tuple[list, list, list]:
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    ids, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    near = _distances(ids, np.repeat(np.arange(len(sizes)), sizes), block)
    # every list has a word, the empty one where the text has none
    close = np.minimum.reduceat(near, offsets[:-1]) < _FAR
    joined, runs = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist(), [[] for _ in sizes]
    for i in np.flatnonzero(close & (sizes >= shortest)).tolist():
        a, b = offsets[i], offsets[i + 1]
        runs[i] = runs_of(ids[a:b], near[a:b], shortest, times, block)
        if runs[i]:
            kept = np.ones(b - a, bool)
            for start, length, period in runs[i]:
                kept[start + period : start + length] = False
            joined[i] = " ".join(coded.dictionary.take(pa.array(ids[a:b][kept])).to_pylist())
    return [0 if text == "" else int(n) for text, n in zip(joined, sizes, strict=True)], runs, joined


def _batch(texts: pa.Array, shortest: int, times: int, block: int) -> pa.Array:
    """n_words, runs and collapsed text of a batch, a few megabytes at a time."""
    clean = pc.ascii_trim(pc.fill_null(texts.cast(pa.large_string()), ""), _SPACES)
    ends = np.cumsum(pc.binary_length(clean).to_numpy(zero_copy_only=False))
    counts, runs, joined = [], [], []
    at = 0
    while at < len(clean):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
        for out, part in zip((counts, runs, joined), _slice(clean.slice(at, upto - at), shortest, times, block), strict=True):
            out += part
        at = upto
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(rows, pa.list_(item)), pa.array(joined, pa.string())], ["n_words", "runs", "collapsed_text"])


def periodic_runs(docs: DataFrame, shortest: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with n_words, runs and collapsed_text; these names replace columns of the input.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch whose smallest period is q, of at least
    ``shortest`` words and ``times`` periods (3 or more), that neither neighbouring word extends.  collapsed_text
    holds the words that are in no run behind its first q words, joined by one space.

    A null, empty or blank text has no words: 0, no runs, empty text.  Other columns, null and repeated ids pass
    through, repeated rows are each judged alone, a table without rows gives none.  A very long text is read whole,
    by one task, in memory in proportion to its length.
    """
    checked_name(docs, "text")
    if times < 3 or shortest < 1:
        raise ValueError("a run needs three periods or more, and a length")
    block = 1 << ((shortest + 2) // 3).bit_length() - 1
    judged = F.arrow_udf(lambda texts: _batch(texts, shortest, times, block), f"struct<n_words:bigint,runs:{_RUNS},collapsed_text:string>")
    made = ("n_words", "runs", "collapsed_text")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return docs.select(*others, judged(F.col("text")).alias("_judged")).select(*others, "_judged.*")
