"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(cell | class, history) * P(word | cell).  There are
``CLASSES`` classes of as many cells.  The most frequent words of the learned documents have a
cell each, in the order of their counts; every other word's class follows from its first two
bytes and its length, its cell from its hash.  Both softmaxes are log-linear in hashed features
of the history: the word before, the one before that (a skip feature) and both together; for the
cells, features are those of the class.  Within a cell of several words a word has its smoothed
relative frequency, with one place for all unknown words.

* Counts cover all learned documents and grow with them.  Documents are dealt into chunks; a chunk
  sends each of its distinct words once, to the bucket of the word, and the bucket answers with its
  count.  A word that every document has is one entry a chunk.
* Training takes a synchronous step for each of ``SHARES``, over the documents of that share (by hash
  of the id; each document is in one): tasks sum observed and expected counts of each feature and cell, sums of blocks of rows are
  added up, and the step is the gradient over its diagonal curvature.  Expected counts are whole
  numbers of 2**-16, so that sums do not depend on how rows are split: scores are a property of
  the documents alone.
* Rows of the weight tables grow with the root of the corpus, from ``LEAST_ROWS`` up to
  ``MOST_ROWS``, which bounds what is broadcast (50 MB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import _hashing as H
from auditlake.llm._frames import checked_name, chunk_bytes, stored

CLASSES = 32
CELLS = CLASSES * CLASSES
OWN = 15 * CLASSES  # words with a cell of their own
LEAST_ROWS, MOST_ROWS = 1 << 11, 1 << 16
FEATURES = 3
#: Tenths of the documents that each step sums; the first is the largest, because from no weights expected counts are products.
SHARES = (6, 2, 2)
RATE, PRIOR = 0.5, 8.0
ONE = 1 << 16  # expected counts are whole numbers of 1 / ONE
_BATCH = 1 << 14
_BLOCK = 16  # rows of a table that travel together
_SLICE = 1 << 21
_WORDS = H.whitespace_words(True)
_U = np.uint64
END = _U(0x5EED0FE4D0F7E840) | _U(CELLS - 1)


def table_rows(total: int) -> int:
    """Rows of each weight table for a corpus of ``total`` bytes."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (math.isqrt(total) // 4).bit_length()))


@dataclass
class Model:
    own: np.ndarray  # sorted hashes of the words with a cell of their own
    own_cell: np.ndarray
    n: np.ndarray  # learned tokens of each cell
    v: np.ndarray  # distinct learned words of each cell
    size: int  # rows of a table
    tables: np.ndarray = field(default=None)  # 2 levels, FEATURES, size, CLASSES
    bias: np.ndarray = field(default=None)  # 1 + CLASSES rows: of the classes, and of each class's cells

    def __post_init__(self):
        if self.tables is None:
            self.tables = np.zeros((2, FEATURES, self.size, CLASSES), np.float32)
        n = self.n.reshape(CLASSES, CLASSES).astype(np.float64)
        both = np.concatenate([n.sum(axis=1)[None, :], n])
        self.bias = np.log((both + 1) / (both.sum(axis=1, keepdims=True) + CLASSES)).astype(np.float32)

    @property
    def places(self) -> np.ndarray:
        """log10 of the places in each cell; 0 where a word has it alone."""
        out = np.log10(self.n + self.v + 1.0)
        out[self.own_cell] = 0.0
        return out

    def cells(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each token, and whether the token has it alone."""
        cell = (hashes & _U(CELLS - 1)).astype(np.int64)
        alone = np.zeros(len(hashes), bool)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            alone = self.own[at] == hashes
            cell[alone] = self.own_cell[at[alone]]
        return cell, alone

    def chances(self, level: int, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or of the cells of ``classes``, for each token."""
        z = self.bias[1 + classes] if level else np.repeat(self.bias[:1], rows.shape[1], axis=0)
        for f in range(FEATURES):
            z += self.tables[level, f][rows[f]]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, and an end after each text) and where each text begins.

    The low bits of a hash are the cell that the word shares with others, so that whoever has the hash knows it.
    """
    words, offsets, first, last, heads = H.words([H.utf8(t) for t in texts], _WORDS, True, (2,))
    shape = np.where(heads[:, 0] != 0, heads[:, 0], words) + np.minimum(last - first, 12).astype(_U) // _U(3)
    classes = H.mix(shape) % _U(CLASSES - OWN // CLASSES) + _U(OWN // CLASSES)
    cells = classes * _U(CLASSES) + (H.mix(words) & _U(CLASSES - 1))
    ends = offsets[1:] + np.arange(len(texts))
    out = np.empty(len(words) + len(texts), _U)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = (words & ~_U(CELLS - 1)) | cells, END
    return out, offsets + np.arange(len(texts) + 1)


def histories(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of each token, as hashes: the word before, the one before that, both."""
    one, two = np.zeros(len(hashes), _U), np.zeros(len(hashes), _U)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    begin = offsets[:-1]
    one[begin] = two[begin] = 0
    later = begin + 1
    two[later[later < offsets[1:]]] = 0
    return np.stack([H.mix(one + _U(1)), H.mix(two + _U(2)), H.mix(one * _U(3) + two + _U(3))])


def table_places(found: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """Rows of the tables for tokens with these features: for classes, and for the cells of each token's class."""
    cells = H.mix((found + (classes.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)).ravel()).reshape(found.shape)
    return np.stack([found & _U(size - 1), cells & _U(size - 1)]).astype(np.int64)


class Sums:
    """Observed and expected counts of every feature and class or cell over some documents, in whole numbers."""

    def __init__(self, model: Model):
        self.model = model
        self.observed = np.zeros((2, FEATURES, model.size, CLASSES), np.int64)
        self.expected = np.zeros((2, FEATURES, model.size, CLASSES), np.int64)
        self.fresh = not model.tables.any()
        self.times = np.zeros((2, FEATURES, model.size, CLASSES), np.int64) if self.fresh else None

    def add(self, texts: list) -> None:
        model = self.model
        hashes, offsets = tokens(texts)
        cells, _ = model.cells(hashes)
        found = histories(hashes, offsets)
        for at in range(0, len(hashes), _BATCH):
            part = cells[at : at + _BATCH]
            classes = part // CLASSES
            rows = table_places(found[:, at : at + _BATCH], classes, model.size)
            for level, target in ((0, classes), (1, part % CLASSES)):
                for f in range(FEATURES):
                    self._count(self.observed[level, f], rows[level, f], target)
                    if self.fresh and level:
                        self._count(self.times[1, f], rows[1, f], classes)
                if self.fresh:
                    continue
                chance = self._whole(model.chances(level, rows[level], classes))
                for f in range(FEATURES):
                    row = rows[level, f]
                    order = np.argsort(row, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
                    self.expected[level, f, row[order][first]] += np.add.reduceat(chance[order], first, axis=0)

    @staticmethod
    def _whole(chance: np.ndarray) -> np.ndarray:
        return np.rint(chance * ONE).astype(np.int32)

    def _count(self, table: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        table += np.bincount(rows * CLASSES + columns, minlength=table.size).reshape(table.shape)

    def settle(self) -> None:
        """Without weights, what is expected of a feature is how often it came with a class, times the shares of the class's cells."""
        if self.fresh:
            none = np.zeros((FEATURES, 1), np.int64)
            of_classes = self._whole(self.model.chances(0, none, none[0]))[0].astype(np.int64)
            each = np.arange(CLASSES)
            of_cells = self._whole(self.model.chances(1, np.zeros((FEATURES, CLASSES), np.int64), each)).astype(np.int64)
            self.expected[0] = self.observed[0].sum(axis=-1, keepdims=True) * of_classes
            self.expected[1] = self.times[1] @ of_cells

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Blocks of rows that some token used."""
        self.settle()
        observed, expected = (x.reshape(-1, _BLOCK * CLASSES) for x in (self.observed, self.expected))
        for block in np.flatnonzero(observed.any(axis=1)).tolist():
            yield block, observed[block].tobytes() + expected[block].tobytes()


def step(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """What a step adds to weights: the gradient of the log likelihood over its diagonal curvature."""
    expected = expected / ONE
    return (RATE * (observed - expected) / ((observed + expected) / 2 + PRIOR)).astype(np.float32)


_PACKED = "block int, body binary"


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "body"])


def train(docs: DataFrame, model: Model, shares: tuple[int, ...] = SHARES) -> Model:
    """``docs``: id and text of the documents to learn from.  The model is changed in place and returned."""
    context = docs.sparkSession.sparkContext
    tenth = F.pmod(F.xxhash64("id"), F.lit(sum(shares)))
    for s, size in enumerate(shares):
        shared = context.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = Sums(shared.value)
            for batch in batches:
                for texts in _slices_of(batch.column(0).to_pylist()):
                    held.add(texts)
            rows: list[tuple[int, bytes]] = []
            for row in held.blocks():
                rows.append(row)
                if len(rows) == 1024:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts = np.frombuffer(body, np.int64)
                    held[block] = held[block] + counts if block in held else counts
            yield _batch([(block, step(*np.split(counts, 2)).tobytes()) for block, counts in held.items()])

        low = sum(shares[:s])
        share = docs.where((tenth >= low) & (tenth < low + size))
        flat = model.tables.reshape(-1, _BLOCK * CLASSES)
        # a block's sums all go to one partition and are added as they come
        for row in share.select("text").mapInArrow(sums, _PACKED).repartition("block").mapInArrow(added, _PACKED).toLocalIterator():
            flat[row.block] += np.frombuffer(row.body, np.float32)
        shared.unpersist()
    return model


_MESSAGE = "bucket int, chunk int, words binary, times binary"
_ANSWER = "chunk int, bucket int, counts binary, n array<long>, v array<long>, word array<long>, times array<long>"


def _slices_of(texts: list) -> Iterator[list]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= _SLICE or i + 1 == len(texts):
            yield texts[start : i + 1]
            start, held = i + 1, 0


def _distinct(found: list[tuple[np.ndarray, np.ndarray]], learned: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Distinct words of a chunk (given as ``tokens`` of its slices), their learned counts, the order of their buckets, and the runs of buckets in it."""
    words: list[np.ndarray] = []
    times: list[np.ndarray] = []
    done = 0
    for hashes, offsets in found:
        n = len(offsets) - 1
        w, at = np.unique(hashes, return_inverse=True)
        words.append(w)
        times.append(np.bincount(at, weights=np.repeat(learned[done : done + n], np.diff(offsets)), minlength=len(w)) if learned is not None else np.zeros(len(w)))
        done += n
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate(times), minlength=len(every)).astype(np.int64)
    home = ((every >> _U(24)) % _U(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.flatnonzero(np.diff(home[order])) + 1
    runs = [(int(home[order[a]]), a, b) for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(order)].tolist(), strict=True)]
    return every, counts, order, runs


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64).tobytes()


def _unpacked(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, np.uint32 if len(body) == 4 * n else np.uint64).astype(np.int64)


def _counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Answers to each chunk: the learned counts of the words it sent; and for chunk -1 totals of cells and the bucket's most frequent words."""
    chunks = table["chunk"].to_pylist()
    words = [np.frombuffer(w, _U) for w in table["words"].to_pylist()]
    times = [_unpacked(t, len(w)) for t, w in zip(table["times"].to_pylist(), words, strict=True)]
    names, at = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate(times), minlength=len(names)).astype(np.int64)
    cuts = np.cumsum([len(w) for w in words])[:-1]
    cell = (names & _U(CELLS - 1)).astype(np.int64)
    n, v = (np.bincount(cell, weights=x, minlength=CELLS).astype(np.int64) for x in (count, count > 0))
    top = np.lexsort((names.view(np.int64), -count))[:OWN]
    top = top[count[top] > 0]
    bucket = key[0].as_py()
    rows = [(c, bucket, _packed(count[part]), None, None, None, None) for c, part in zip(chunks, np.split(at, cuts), strict=True)]
    rows.append((-1, bucket, None, n, v, names[top].view(np.int64), count[top]))
    kinds = (pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 4)
    names_ = ("chunk", "bucket", "counts", "n", "v", "word", "times")
    return pa.table({c: pa.array(x, k) for c, x, k in zip(names_, zip(*rows, strict=True), kinds, strict=True)})


def counted_model(answers: DataFrame, size: int) -> Model:
    """The model before training, from at most CELLS totals and OWN words."""
    totals = answers.where("chunk < 0")
    n, v = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for row in totals.select(F.posexplode(F.arrays_zip("n", "v"))).groupBy("pos").agg(F.sum("col.n").alias("n"), F.sum("col.v").alias("v")).collect():
        n[row.pos], v[row.pos] = row.n, row.v
    most = totals.select(F.explode(F.arrays_zip("word", "times"))).select("col.*").orderBy(F.desc("times"), "word").limit(OWN).collect()
    own = np.array([r.word for r in most], np.int64).view(_U)
    for i, (word, times) in enumerate(zip(own, (r.times for r in most), strict=True)):
        shared = int(word & _U(CELLS - 1))
        n[shared], v[shared] = n[shared] - times, v[shared] - 1
        n[i], v[i] = times, 1
    order = np.argsort(own)
    return Model(own[order], order.astype(np.int64), n, v, size)


def score_tokens(model: Model, hashes: np.ndarray, offsets: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known tokens, sum of log10(count + 1), log10 probability; ``count`` has the learned count of each token."""
    logs = np.log10(count + 1.0)
    cells, alone = model.cells(hashes)
    found = histories(hashes, offsets)
    each = np.where(alone, 0.0, logs) - model.places[cells]
    for at in range(0, len(hashes), _BATCH):
        part = cells[at : at + _BATCH]
        classes, index = part // CLASSES, np.arange(len(part))
        rows = table_places(found[:, at : at + _BATCH], classes, model.size)
        chance = model.chances(0, rows[0], classes)[index, classes].astype(np.float64) * model.chances(1, rows[1], classes)[index, part % CLASSES]
        each[at : at + _BATCH] += np.log10(np.maximum(chance, 1e-60))
    begin = offsets[:-1]
    return np.diff(offsets), np.add.reduceat((count > 0).astype(np.int64), begin), np.add.reduceat(logs, begin), np.add.reduceat(each, begin)


def score(docs: DataFrame, learned, id_col: str = "doc_id", text_col: str = "text", shares: tuple[int, ...] = SHARES) -> DataFrame:
    """Score every document; ``learned`` is a boolean column over ``docs``, true for those to learn from.

    Returns the id column, ``n_tokens`` (words and one end), ``n_known`` (tokens that occur in the
    learned documents), ``train_tokens``, ``base_score`` (add-one unigram log10 probability) and
    ``score`` (the model's log10 probability of the text).

    Defined cases: a null text is an empty one, that is an end alone; a null ``learned`` is false; with
    nothing learned all words are unknown; rows that repeat an id are scored by their own texts; repeated
    rows count, and get the same result; texts of any length are scored whole, in batches of tokens; an
    empty table gives an empty one; other columns are not looked at.
    """
    checked_name(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = chunk_bytes(total)
    chunks, buckets = total // size + 1, total // (4 * size) + 1
    by_chunk = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")).groupBy("chunk")

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [tokens(texts) for texts in _slices_of(table["text"].to_pylist())]
        words, times, order, runs = _distinct(found, table["learned"].to_numpy().astype(float), buckets)
        out = [(bucket, key[0].as_py(), words[order[a:b]].tobytes(), _packed(times[order[a:b]])) for bucket, a, b in runs]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("bucket", "chunk", "words", "times"), zip(*out, strict=True), kinds, strict=True)})

    answers = stored(by_chunk.applyInArrow(send, _MESSAGE).groupBy("bucket").applyInArrow(_counted, _ANSWER), "counts")
    model = counted_model(answers, table_rows(total))
    n, v = int(model.n.sum()), int(model.v.sum())
    shared = spark.sparkContext.broadcast(train(rows.where("learned and id is not null").select("id", "text"), model, shares))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        found = [tokens(texts) for texts in _slices_of(table["text"].to_pylist())]
        words, _, order, runs = _distinct(found, None, buckets)
        payload = dict(zip(told["bucket"].to_pylist(), told["counts"].to_pylist(), strict=True))
        count = np.zeros(len(words), np.int64)
        for bucket, a, b in runs:
            count[order[a:b]] = _unpacked(payload[bucket], b - a)
        parts = [score_tokens(shared.value, hashes, offsets, count[np.searchsorted(words, hashes)]) for hashes, offsets in found]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table([table["id"], *(pa.array(c) for c in columns)], names=["id", "n_tokens", "n_known", "logs", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = answers.where("chunk >= 0").select("chunk", "bucket", "counts").groupBy("chunk")
    scored = by_chunk.cogroup(told).applyInArrow(run, f"id {kind}, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
