"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order ``ORDER`` over lower-cased words of letters,
with a start and an end mark; a history does not reach beyond its word.  The models of all
languages share sorted arrays of 64-bit n-gram hashes, one row of probabilities for each
n-gram with a column per language, so that one search serves all languages.  The language of
least cross-entropy per character wins.

Fit on a bounded sample: at most ``per_language`` documents of each language, those of least
hash of their id.  The scoring pass covers all documents and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import _hashing as H
from auditlake.llm._frames import checked_name, least_by_hash

ORDER = 4
_PIECE = 1 << 19
_START, _END = 1, 2
_U = np.uint64
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _pieces(texts: list) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of pieces of about _PIECE characters, cut where no word is, with the number of the text of each."""
    group: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while at < len(text):
            end = min(len(text), at + _PIECE)
            while end < len(text) and text[end].isalpha():
                end += 1
            group.append((i, text[at:end]))
            held += end - at
            at = end
            if held >= _PIECE:
                yield np.array([g[0] for g in group]), [g[1] for g in group]
                group, held = [], 0
    if group:
        yield np.array([g[0] for g in group]), [g[1] for g in group]


def _words(owners: np.ndarray, pieces: list[str]):
    """Codes of the joined pieces; start, end, hash and text number of every word."""
    codes = np.frombuffer(" ".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(letters()[codes].view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    up, down = H._power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum((codes.astype(_U) * _U(0xBF58476D1CE4E5B9) + _U(1)) * up[: len(codes)], out=total[1:])
    hashes = H.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    bounds = np.cumsum([0] + [len(p) + 1 for p in pieces])
    return codes, starts, ends, hashes, owners[np.searchsorted(bounds, starts, "right") - 1] if len(starts) else np.zeros(0, int)


def _positions(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every character of the words and their end marks: the ORDER codes up to it, and its word."""
    sizes = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = np.empty((len(word), ORDER), np.uint32)
    base = starts[word] + within
    for back in range(ORDER):
        at = within - back
        got = codes[np.clip(base - back, 0, max(0, len(codes) - 1))]
        got = np.where(at < 0, _START, got)
        grams[:, ORDER - 1 - back] = np.where(at == sizes[word] - 1, _END, got)
    return grams, word


def gram_keys(grams: np.ndarray, n: int, drop_last: bool = False) -> np.ndarray:
    """Hash of the last ``n`` codes; with ``drop_last``, of the history before the last one."""
    cols = grams[:, ORDER - n : ORDER - 1] if drop_last else grams[:, ORDER - n :]
    out = np.full(len(grams), n if not drop_last else n - 1, _U)
    for j in range(cols.shape[1]):
        out = out * _U(0x9E3779B97F4A7C15) + cols[:, j].astype(_U)
    return H.mix(out)


@dataclass
class Model:
    """Sorted hash arrays: ``keys[n]`` with log10 probabilities ``probs[n]``, ``histories[n]`` with log10 weights ``weights[n]``."""

    langs: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    probs: dict[int, np.ndarray] = field(default_factory=dict)
    histories: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, grams: np.ndarray, n: int = ORDER) -> np.ndarray:
        """log10 p of the last code of each row, for each language."""
        if n == 0:
            return np.broadcast_to(self.floor, (len(grams), len(self.langs))).copy()
        key = gram_keys(grams, n)
        at = np.minimum(np.searchsorted(self.keys[n], key), max(0, len(self.keys[n]) - 1))
        found = self.keys[n][at] == key if len(self.keys[n]) else np.zeros(len(key), bool)
        out = np.empty((len(grams), len(self.langs)), np.float32)
        out[found] = self.probs[n][at[found]]
        if not found.all():
            rest = grams[~found]
            lower = self.score(rest, n - 1)
            past = gram_keys(rest, n, True)
            at = np.minimum(np.searchsorted(self.histories[n], past), max(0, len(self.histories[n]) - 1))
            known = self.histories[n][at] == past if len(self.histories[n]) else np.zeros(len(past), bool)
            lower[known] += self.weights[n][at[known]]
            out[~found] = lower
        return out


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """From the distinct highest-order n-grams of each language and their counts."""
    langs = sorted(counts)
    model = Model(langs)
    alphabet = len(np.unique(np.concatenate([g[:, -1] for g, _ in counts.values()]))) + 1 if counts else 1
    model.floor = np.full(len(langs), -np.log10(alphabet))
    stats: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}
    for lang in langs:
        grams, c = counts[lang]
        c = c.astype(np.float64)
        for n in range(ORDER, 0, -1):
            key = gram_keys(grams, n)
            past = gram_keys(grams, n, True)
            names, group = np.unique(past, return_inverse=True)
            d = c.clip(max=4).astype(int)
            n1, n2 = (d == 1).sum(), (d == 2).sum()
            discount = min(0.95, max(0.1, n1 / max(1.0, n1 + 2 * n2)))
            total = np.bincount(group, weights=c)
            kinds = np.bincount(group)
            stats[n].append((key, grams, (c - discount) / total[group], names, discount * kinds / total))
            # what is left is the number of different codes seen before each shorter n-gram
            if n > 1:
                short = gram_keys(grams, n - 1)
                _, first, c = np.unique(short, return_index=True, return_counts=True)
                grams, c = grams[first], c.astype(np.float64)
    for n in range(1, ORDER + 1):
        model.histories[n] = np.unique(np.concatenate([s[3] for s in stats[n]])) if stats[n] else np.zeros(0, _U)
        weight = np.ones((len(model.histories[n]), len(langs)))
        for j, (_, _, _, names, w) in enumerate(stats[n]):
            weight[np.searchsorted(model.histories[n], names), j] = w
        model.weights[n] = np.log10(weight).astype(np.float32)
        every = np.concatenate([s[0] for s in stats[n]]) if stats[n] else np.zeros(0, _U)
        model.keys[n], first = np.unique(every, return_index=True)
        grams = np.concatenate([s[1] for s in stats[n]])[first] if stats[n] else np.zeros((0, ORDER), np.uint32)
        own = np.zeros((len(grams), len(langs)))
        for j, (key, _, p, _, _) in enumerate(stats[n]):
            own[np.searchsorted(model.keys[n], key), j] = p
        past = np.searchsorted(model.histories[n], gram_keys(grams, n, True))
        lower = 10.0 ** model.score(grams, n - 1)
        model.probs[n] = np.log10(own + weight[past] * lower).astype(np.float32) if len(grams) else np.zeros((0, len(langs)), np.float32)
    return model


def _count_grams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    all_grams, all_counts = [], []
    for owners, pieces in _pieces(table["text"].to_pylist()):
        codes, starts, ends, hashes, _ = _words(owners, pieces)
        if not len(starts):
            continue
        _, first, times = np.unique(hashes, return_index=True, return_counts=True)
        grams, word = _positions(codes, starts[first], ends[first])
        _, at, inverse = np.unique(gram_keys(grams, ORDER), return_index=True, return_inverse=True)
        all_grams.append(grams[at])
        all_counts.append(np.bincount(inverse, weights=times[word]).astype(np.int64))
    if not all_grams:
        return pa.table({"lang": pa.array([], pa.string()), "grams": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
    grams, counts = np.concatenate(all_grams), np.concatenate(all_counts)
    _, at, inverse = np.unique(gram_keys(grams, ORDER), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=counts).astype(np.int64)
    return pa.table({"lang": [key[0].as_py()], "grams": [grams[at].tobytes()], "counts": [counts.tobytes()]})


class Scorer:
    """Cross-entropies of texts; scores of words already met are kept, up to a bound."""

    KEPT = 1_000_000

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.scores = np.zeros(0, _U), np.zeros((0, len(self.model.langs)), np.float32)

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Sum of -log10 p of each text under each language, and the number of characters (end marks included)."""
        sums, sizes = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts))
        for owners, pieces in _pieces(texts):
            codes, starts, ends, hashes, owner = _words(owners, pieces)
            if not len(starts):
                continue
            names, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hashes, names), max(0, len(self.hashes) - 1))
            known = self.hashes[at] == names if len(self.hashes) else np.zeros(len(names), bool)
            scores = np.empty((len(names), len(self.model.langs)), np.float32)
            scores[known] = self.scores[at[known]]
            if not known.all():
                new = first[~known]
                grams, word = _positions(codes, starts[new], ends[new])
                each = self.model.score(grams)
                cut = np.flatnonzero(np.diff(word, prepend=-1))
                scores[~known] = np.add.reduceat(each, cut, axis=0)
                if len(self.hashes) + len(new) > self.KEPT:
                    self._forget()
                order = np.argsort(np.concatenate([self.hashes, names[~known]]), kind="stable")
                self.hashes = np.concatenate([self.hashes, names[~known]])[order]
                self.scores = np.concatenate([self.scores, scores[~known]])[order]
            for j in range(scores.shape[1]):
                sums[:, j] -= np.bincount(owner, weights=scores[inverse, j], minlength=len(texts))
            sizes += np.bincount(owner, weights=ends - starts + 1, minlength=len(texts))
        return sums, sizes


def learned_from(id_col: str, folds: int = 5, held: int = 0):
    """Whether crc32 of the id as text, modulo ``folds``, is not ``held``; null without id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds != held


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000) -> Model:
    """Fit on at most ``per_language`` rows of each non-null language, those of least xxhash64 of their id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("id is not null and text is not null and lang is not null")
    chosen = least_by_hash(rows.select("id", "lang").distinct(), "lang", "id", per_language)
    sample = rows.join(F.broadcast(chosen), ["id", "lang"])
    got = sample.select("lang", "text").groupBy("lang").applyInArrow(_count_grams, "lang string, grams binary, counts binary").collect()
    model = fit({r.lang: (np.frombuffer(r.grams, np.uint32).reshape(-1, ORDER), np.frombuffer(r.counts, np.int64)) for r in got})
    if not model.langs:
        return model
    # rejection: beyond what all but one in a thousand of the learned documents of the language reach
    shared = spark.sparkContext.broadcast(model)

    def entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            sums, sizes = scorer.entropies(batch.column(1).to_pylist())
            own = [scorer.model.langs.index(x) for x in batch.column(0).to_pylist()]
            value = sums[np.arange(len(own)), own] / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["lang", "entropy"])

    limits = sample.select("lang", "text").where(F.col("lang").isin(model.langs)).mapInArrow(entropy, "lang string, entropy double").groupBy("lang").agg(F.percentile("entropy", F.lit(0.999)).alias("top"))
    found = {r.lang: r.top for r in limits.collect()}
    model.limits = np.array([found.get(x, np.inf) for x in model.langs])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``.

    ``score`` is the posterior of the predicted language over at most 100 characters' worth of
    evidence; ``rejected`` tells that the cross-entropy is beyond the calibrated limit of that
    language, which leaves ``lang_pred`` as it is.

    Defined cases: a null text or one without a letter is ``und`` with score 0, no cross-entropy and
    rejected; a text of any length is read whole, in slices; ties go to the first language by name; a model without languages says ``und``
    throughout; repeated rows get the same result; other columns are not looked at.
    """
    checked_name(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = scorer.model.langs
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums, sizes = scorer.entropies(texts) if langs else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
            mean = sums / np.maximum(sizes, 1)[:, None]
            best = mean.argmin(axis=1)
            evidence = -(mean - mean.min(axis=1, keepdims=True)) * np.log(10) * np.minimum(sizes, 100)[:, None]
            post = np.exp(evidence)
            score = post[np.arange(len(texts)), best] / post.sum(axis=1)
            none = sizes == 0
            ce = mean[np.arange(len(texts)), best]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(["und" if n else langs[b] for n, b in zip(none, best, strict=True)], pa.string()),
                    pa.array(np.where(none, 0.0, score)),
                    pa.array(ce, mask=none),
                    pa.array([bool(n or c > scorer.model.limits[b]) for n, c, b in zip(none, ce, best, strict=True)], pa.bool_()),
                ],
                names=[id_col, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
