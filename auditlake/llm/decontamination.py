"""Benchmark decontamination: an FM-index per shard of documents, searched for test phrases.

Every run of ``window`` consecutive words of a test item is a phrase (an item of fewer words is
one).  A shard is some megabytes of documents.  Its words become the phrases' word numbers;
words that no phrase has only separate, and runs shorter than the shortest phrase cannot hold
one, so neither needs a place in the index.  All phrases are searched backwards at once through
the wavelet ranks, occurrences are located by sampled suffix positions, and their words merge
into removal spans.

Documents are read once and never shuffled.  Items are taken in blocks of bounded size; each
block is one pass over the rows in the same stage, so the largest broadcast is bounded whatever
the size of the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import _hashing as H
from auditlake.llm._frames import checked_name
from auditlake.llm.fm_index import GAP, FMIndex

_WORDS = H.alnum_words()
_SLICE = 4 << 20
#: Bytes of item text in one block.
BLOCK_BYTES = 2 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans", "clean_text")


class Phrases:
    """The distinct phrases of some items: word numbers, right-aligned, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        hashes, offsets = H.words([H.utf8(t) for _, t in items], _WORDS)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = numbers + 2
        owners: dict[bytes, set] = {}
        for (item, _), a, b in zip(items, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            size = min(window, b - a)
            for at in range(a, b - size + 1) if size else ():
                owners.setdefault(numbers[at : at + size].astype(np.int64).tobytes(), set()).add(item)
        self.lengths = np.array([len(k) // 8 for k in owners], np.int64)
        self.numbers = np.zeros((len(owners), window), np.int64)
        for row, k in zip(self.numbers, owners, strict=True):
            row[window - len(k) // 8 :] = np.frombuffer(k, np.int64)
        self.items = [sorted(x for x in s if x is not None) for s in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def occurrences(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in documents given by word hashes and offsets."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.shortest or not len(hashes):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        starts = np.zeros(len(hashes) + 1, bool)
        starts[offsets] = True
        begin = np.flatnonzero(known & (starts[:-1] | ~np.r_[False, known[:-1]]))
        end = np.flatnonzero(known & (starts[1:] | ~np.r_[known[1:], False])) + 1
        long = end - begin >= self.shortest
        begin, sizes = begin[long], (end - begin)[long]
        if not len(begin):
            return none
        # runs one after the other, a gap behind each
        place = np.cumsum(sizes + 1) - (sizes + 1)
        word = np.repeat(begin - place, sizes + 1) + np.arange(int((sizes + 1).sum()))
        gaps = place + sizes
        word[gaps] = 0
        text = at[word] + 2
        text[gaps] = GAP
        index = FMIndex(text, len(self.vocabulary) + 2)
        low, high = index.search(self.numbers, self.lengths)
        counts = high - low
        phrase = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return word[index.locate(rows)], phrase


def _merge(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


_SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))
_STATE = T.StructType([T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS)])


def _arrow_spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
    return pa.array([[{"first_word": a, "n_words": b - a} for a, b in x] for x in spans], kind)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
) -> DataFrame:
    """Find every occurrence of a phrase of ``benchmark`` in ``docs`` and cut it.

    Returns all columns of ``docs`` and ``n_words``, ``n_hit`` (words inside any occurrence),
    ``n_items`` and ``item_ids`` (items with occurring phrases, as strings, sorted),
    ``items_sha256`` (of those, comma-joined), ``contaminated`` (n_hit > 0), ``spans`` (merged
    removal spans in words) and ``clean_text``; same-named input columns are replaced.  Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

    Defined cases: a null text, of a document or an item, has no words (a null text stays null); an
    item without id still hits, and is not listed; rows repeating an item id are one item; repeated
    documents get the same result each; empty tables are fine.
    """
    checked_name(docs, id_col, text_col)
    checked_name(benchmark, item_col, item_text_col)
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    blocks = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1
    names = [c for c in docs.columns if c not in RESULTS or c in (id_col, text_col)]
    own = [f"c{i}" for i in range(len(names))]
    text_at = names.index(text_col)
    rows = docs.select(*(F.col(f"`{n}`").alias(o) for n, o in zip(names, own, strict=True)), F.lit(None).cast(_STATE).alias("state"))
    plain = T.StructType([T.StructField(o, docs.schema[n].dataType) for o, n in zip(own, names, strict=True)])
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        phrases = spark.sparkContext.broadcast(Phrases(sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] or "", r[1])), window))
        final = block == blocks - 1
        schema = T.StructType(plain.fields + ([] if final else [T.StructField("state", _STATE)]))
        if final:
            kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.ArrayType(T.StringType()), _SPANS, T.StringType())
            schema = T.StructType(schema.fields + [T.StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True)])
        rows = rows.mapInArrow(_scan(phrases, text_at, len(own), final), schema)
    return rows.toDF(*names, *RESULTS)


def _scan(phrases, text_at: int, width: int, final: bool):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            start = held = 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held >= _SLICE or i + 1 == len(texts):
                    yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                    start, held = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases.value
        for batch, texts in slices(batches):
            bodies = [H.utf8(t) for t in texts]
            hashes, offsets, first, last = H.words(bodies, _WORDS, True)
            start, phrase = known.occurrences(hashes, offsets)
            step = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + known.lengths[phrase], -1)
            covered = np.cumsum(step[:-1]) > 0
            found: dict[int, set] = {}
            for d, p in set(zip((np.searchsorted(offsets, start, "right") - 1).tolist(), phrase.tolist(), strict=True)):
                found.setdefault(d, set()).update(known.items[p])
            for d, state in enumerate(batch.column(width).to_pylist()):
                if state is not None:
                    found.setdefault(d, set()).update(state["items"])
                    for s in state["spans"]:
                        covered[offsets[d] + s["first_word"] : offsets[d] + s["first_word"] + s["n_words"]] = True
            spans = [_merge(covered[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [batch.column(i) for i in range(width)]
            listed = [sorted(found.get(d, ())) for d in range(len(texts))]
            if not final:
                state = pa.StructArray.from_arrays([pa.array(listed, pa.list_(pa.string())), _arrow_spans(spans)], names=["items", "spans"])
                yield pa.RecordBatch.from_arrays([*columns, state], names=[*batch.schema.names[:width], "state"])
                continue
            hit = np.add.reduceat(np.r_[covered, False], offsets[:-1]) if len(texts) else []
            hit = np.where(np.diff(offsets) > 0, hit, 0)
            cleaned = [t if not s else _cut(b, s, first[o:], last[o:]) for t, b, s, o in zip(texts, bodies, spans, offsets[:-1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(np.diff(offsets)),
                    pa.array(hit.astype(np.int64)),
                    pa.array([len(x) for x in listed], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]),
                    pa.array(hit > 0),
                    pa.array(listed, pa.list_(pa.string())),
                    _arrow_spans(spans),
                    pa.array(cleaned, pa.string()),
                ],
                names=[*batch.schema.names[:width], *RESULTS],
            )

    return run


def _cut(body: bytes, spans: list[tuple[int, int]], first: np.ndarray, last: np.ndarray) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    left = [0, *(int(last[b - 1]) for _, b in spans)]
    right = [*(int(first[a]) for a, _ in spans), len(body)]
    return b"".join(body[a:b] for a, b in zip(left, right, strict=True)).decode("utf-8", "surrogatepass")
