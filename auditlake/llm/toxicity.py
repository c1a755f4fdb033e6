"""Toxicity by cumulative-link ordinal regression over sparse word features.

Severity has ordered grades.  One weight vector is shared by all thresholds:
P(grade > k | x) = sigmoid(w.x - theta_k) with rising theta_k, and the prediction is the
expected severity, the sum over k of P(grade > k).  Features are the distinct words of a
text and their first ``HEADS`` bytes (compounds and inflections share them), by 64-bit hash;
those that do not tell the grades apart in the sample are dropped, so that the many words
seen in a few documents only carry no weight.

Fit on a bounded sample of labelled rows (``per_grade`` of each grade, those of least hash of
their id); every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import _hashing as H
from auditlake.llm._frames import checked_name, least_by_hash

_WORDS = H.alnum_words()
HEADS = (4, 5, 6, 7, 8)
_SLICE = 2 << 20


@dataclass
class Model:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(-(margin[:, None] - self.thresholds[None, :])))


def _features(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices [first, last) of the texts: hashes of all words and heads, and the text of each, counted from first."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= _SLICE or i + 1 == len(texts):
            hashes, offsets, heads = H.words([H.utf8(t) for t in texts[start : i + 1]], _WORDS, lengths=HEADS)
            every = np.concatenate([hashes[:, None], heads], axis=1)
            owner = np.repeat(np.arange(i + 1 - start), np.diff(offsets))
            some = every != 0
            yield start, i + 1, every[some], np.broadcast_to(owner[:, None], every.shape)[some]
            start, held = i + 1, 0


def _word_sets(texts: list) -> list[np.ndarray]:
    """Distinct features of each text."""
    out = []
    for first, last, hashes, owner in _features(texts):
        cuts = np.searchsorted(owner, np.arange(1, last - first))
        out += [np.unique(x) for x in np.split(hashes, cuts)]
    return out


def fit(rows: list[tuple[int, np.ndarray]], grades: int, least_df: int = 5, least_z: float = 5.5, l2: float = 0.1, steps: int = 400, split: bool = False) -> Model:
    """From (grade, distinct word hashes) of the sample; full-batch gradient steps with momentum on numpy arrays.

    With ``split``, rows of the top grade with more than the median number of telling features
    make a grade of their own.
    """
    y = np.array([g for g, _ in rows], np.int64)
    lengths = np.array([len(h) for _, h in rows], np.int64)
    every = np.concatenate([h for _, h in rows]) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    names, at = np.unique(every, return_inverse=True)
    df = np.bincount(at, minlength=len(names))
    bad = np.bincount(at, weights=(y > 0)[owner], minlength=len(names))
    share = (y > 0).mean() if len(y) else 0.0
    z = (bad - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    chosen = (df >= least_df) & (np.abs(z) >= least_z)
    number = np.cumsum(chosen) - 1
    use = chosen[at]
    column, line = number[at[use]], owner[use]
    if split and len(y):
        told = np.bincount(line, minlength=len(y))
        top = y == grades - 1
        y = np.where(top & (told > (np.median(told[top]) if top.any() else 0)), grades, y)
        grades += 1
    w = np.zeros(int(chosen.sum()))
    counts = np.array([(y > k).sum() for k in range(grades - 1)])
    p = (counts + 0.5) / (len(y) + 1)
    theta = np.log((1 - p) / p)
    theta = np.maximum.accumulate(theta + np.arange(len(theta)) * 1e-3)
    gap = np.log(np.maximum(np.diff(theta), 1e-3))
    params, speed, scale = np.concatenate([w, theta[:1], gap]), 0.0, 0.0
    m = len(w)

    def unpack(v: np.ndarray) -> np.ndarray:
        return v[m] + np.concatenate([[0.0], np.cumsum(np.exp(v[m + 1 :]))])

    target = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    for step in range(1, steps + 1 if len(y) else 0):
        margin = np.bincount(line, weights=params[:m][column], minlength=len(y))
        t = unpack(params)
        up = 1 / (1 + np.exp(-(margin[:, None] - t[None, :])))
        # likelihood of the grade's cell: difference of two neighbouring cumulative probabilities
        full = np.concatenate([np.ones((len(y), 1)), up, np.zeros((len(y), 1))], axis=1)
        cell = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(y), 1)), up * (1 - up), np.zeros((len(y), 1))], axis=1)
        d_margin = (slope[np.arange(len(y)), y] - slope[np.arange(len(y)), y + 1]) / cell
        d_theta = np.zeros_like(target)
        for k in range(grades - 1):
            d_theta[:, k] = (np.where(y == k, slope[:, k + 1], 0) - np.where(y == k + 1, slope[:, k + 1], 0)) / cell
        g_theta = d_theta.sum(axis=0)
        gradient = np.concatenate([np.bincount(column, weights=d_margin[line], minlength=m) - l2 * params[:m], [g_theta.sum()], np.exp(params[m + 1 :]) * np.cumsum(g_theta[::-1])[::-1][1:]]) / len(y)
        speed = 0.9 * speed + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient**2
        params = params + 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    return Model(names[chosen], params[:m], unpack(params))


def train(docs: DataFrame, graded: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", per_grade: int = 1000, split: bool = False) -> Model:
    """``graded`` has the id and ``grade`` (0 to ``grades`` - 1; others and nulls are ignored; a label that is repeated counts once)."""
    known = graded.select(F.col(f"`{id_col}`").alias("id"), F.col("grade").cast("int").alias("grade")).where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1))
    chosen = least_by_hash(known.distinct(), "grade", "id", per_grade)
    # at most grades * per_grade ids
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id").select("grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in _word_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["grade", "words"])

    rows = sample.mapInArrow(features, "grade int, words binary").collect()
    return fit(sorted(((r.grade, np.frombuffer(r.words, np.uint64)) for r in rows), key=lambda r: (r[0], r[1].tobytes())), grades, split=split)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """Per row: the id column, ``severity`` (expected grade), ``p_toxic`` (P(grade > 0)) and ``toxic`` (p_toxic above ``limit``).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Defined cases: a null or empty
    text has no features and gets what the thresholds alone say; a text of any length is read whole, in slices; a model fit on no rows says 0 words matter;
    repeated rows get the same result; other columns are not looked at; empty tables are fine.
    """
    checked_name(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        near = np.zeros(1 << 16, bool)
        near[(model.features & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            margin = np.zeros(len(texts))
            for first, last, hashes, owner in _features(texts):
                maybe = np.flatnonzero(near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(model.features, hashes[maybe]), max(0, len(model.features) - 1))
                hit = model.features[at] == hashes[maybe] if len(model.features) else np.zeros(len(maybe), bool)
                pairs = np.unique(owner[maybe[hit]] * (len(model.features) + 1) + at[hit])
                text, at = pairs // (len(model.features) + 1), pairs % (len(model.features) + 1)
                margin[first:last] += np.bincount(text, weights=model.weights[at], minlength=last - first)
            above = model.above(margin)
            p = above[:, 0] if above.shape[1] else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(p), pa.array(p > limit)], names=[id_col, "severity", "p_toxic", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {kind}, severity double, p_toxic double, toxic boolean")
