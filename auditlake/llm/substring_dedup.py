"""Substring deduplication: seed and extend over winnowed anchors.

A passage is a repeat when ``min_words`` consecutive words (a window) also start in a
document with a smaller id.  Winnowing picks, for every window, the smallest hash among
its ``anchor_words``-grams as its anchor: two equal windows always pick equal anchors, so
joining documents on anchors loses no repeat.  From a shared anchor the match is extended
window by window: all windows to its left and right that hold it are looked up, each against
every document at once and not against one partner, because neighbouring windows may have
different sources.  Runs of windows found are the maximal repeats.

No pair of documents is ever made.  Documents are dealt into chunks (``chunk_bytes``); a
chunk is read three times through one shuffle of the text:

1. each chunk sends its distinct anchors, once, to the anchor's bucket (4 bytes each; the
   bucket number makes up the rest of the hash); the bucket answers one bit per anchor;
2. each chunk sends the distinct windows around shared anchors with the smallest document
   id that it has for them; the bucket answers whether a smaller id exists elsewhere;
3. each chunk cuts the covered words.

A hot passage is one entry per chunk, whatever the number of its copies.  Chunks and buckets
both grow with the root of the corpus.  Windows are equal where 96 bits are: two hashes of the
words made with different bases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import _hashing as H
from auditlake.llm._frames import checked_name, chunk_bytes

_LAST = np.iinfo(np.int64).max
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_MESSAGE = "bucket int, chunk int, kind int, keys binary, docs binary, refs binary"
_ANSWER = "chunk int, bucket int, kind int, payload binary"
_RESULTS = ("n_words", "n_removed", "kept_text", "kept_sha256", "repeats")


class _Chunk:
    """The documents of one chunk in a fixed order, with their words and windows."""

    def __init__(self, ids: list, texts: list[bytes], min_words: int, anchor_words: int, buckets: int, spans: bool = False):
        keys = [_LAST if i is None else i for i in ids]
        self.order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = np.array([keys[i] for i in self.order], np.int64)
        found = H.words(self.texts, H.whitespace_words(False), spans)
        self.words, self.offsets = found[:2]
        self.spans = found[2:]
        self.buckets = buckets
        self.doc = np.repeat(np.arange(len(keys)), np.diff(self.offsets))
        last = len(self.words) - min_words + 1
        if last <= 0:
            self.starts = np.zeros(0, np.int64)
            self.anchors = self.windows = np.zeros(0, np.uint64)
            self.checks = np.zeros(0, np.uint32)
            return
        self.starts = np.flatnonzero(self.doc[:last] == self.doc[min_words - 1 :])
        grams = H.ngrams(self.words, anchor_words)
        least = grams[:last].copy()
        for shift in range(1, min_words - anchor_words + 1):
            np.minimum(least, grams[shift : shift + last], out=least)
        self.anchors = least[self.starts]
        self.windows = H.ngrams(self.words, min_words)[self.starts]
        self.checks = (H.ngrams(H.mix(self.words ^ _OTHER), min_words)[self.starts] >> np.uint64(32)).astype(np.uint32)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors as (bucket << 32 | low bits), ascending; which anchor each window has; which lie in two documents."""
        seeds = ((self.anchors >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | self.anchors & np.uint64(0xFFFFFFFF)
        distinct, at = np.unique(seeds, return_inverse=True)
        docs = self.doc[self.starts]
        low, high = np.full(len(distinct), len(self.texts)), np.full(len(distinct), -1)
        np.minimum.at(low, at, docs)
        np.maximum.at(high, at, docs)
        return distinct, at, low < high

    def candidates(self, mask: np.ndarray, at: np.ndarray):
        """Windows around shared anchors: positions, distinct hashes and checks, index into them, smallest id of each."""
        where = np.flatnonzero(mask[at]) if len(at) else np.zeros(0, np.int64)
        windows, checks = self.windows[where], self.checks[where]
        first, index = _distinct(windows, checks)
        least = np.full(len(first), _LAST, np.int64)
        np.minimum.at(least, index, self.ids[self.doc[self.starts[where]]])
        return where, windows[first], checks[first], index, least


def _distinct(windows: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct pairs of a hash and a check, where each is first, and for all pairs which of them they are."""
    order = np.lexsort((checks, windows))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(windows[order]) != 0) | (np.diff(checks[order]) != 0)
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return order[new], index


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _parts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of an ascending array."""
    if not len(buckets):
        return []
    cut = np.flatnonzero(np.diff(buckets)) + 1
    return list(zip(buckets[np.r_[0, cut]].tolist(), np.r_[0, cut].tolist(), np.r_[cut, len(buckets)].tolist(), strict=True))


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, anchor_words: int = 5) -> DataFrame:
    """Cut every word that lies in a window which also starts in a document with a smaller id.

    Returns all columns of ``docs`` and ``n_words``, ``n_removed``, ``kept_text``,
    ``kept_sha256`` (of the kept words joined by one space) and ``repeats`` (array of
    maximal removed spans: first word, number of words, as the text had them); same-named
    input columns are replaced.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Windows are
    judged on the input, not on what is left.

    Defined cases: a null text has no words and stays null; texts of fewer than
    ``min_words`` words lose nothing; a null id counts as larger than all others and never
    as smaller than itself; rows with equal ids are judged one by one against smaller ids
    only (repeated rows give repeated results); a text of any length is judged whole, in one
    task; ids must be whole numbers, others are refused; an empty table gives an empty one.
    """
    checked_name(docs, id_col, text_col)
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("ids must be whole numbers: their order decides which passage stays")
    if not 1 <= anchor_words <= min_words:
        raise ValueError("anchor_words must lie between 1 and min_words")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = chunk_bytes(total)
    chunks, buckets = total // size + 1, total // (4 * size) + 1
    names = [c for c in docs.columns if c not in _RESULTS or c in (id_col, text_col)]
    own = [f"c{i}" for i in range(len(names))]
    the_id, the_text = own[names.index(id_col)], own[names.index(text_col)]
    source = docs.select(*(F.col(f"`{n}`").alias(o) for n, o in zip(names, own, strict=True)))
    source = source.withColumn(the_id, F.col(the_id).cast("long")).withColumn("chunk", F.pmod(F.xxhash64(the_id, the_text), F.lit(chunks)).cast("int"))

    def opened(table: pa.Table, spans: bool = False) -> _Chunk:
        return _Chunk(table[the_id].to_pylist(), [H.utf8(t) for t in table[the_text].to_pylist()], min_words, anchor_words, buckets, spans)

    def send_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = opened(table)
        seeds, _, twice = chunk.seeds()
        rows = []
        for bucket, a, b in _parts((seeds >> np.uint64(32)).astype(np.int64)):
            rows.append((bucket, key[0].as_py(), 0, (seeds[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), None, _bits(twice[a:b])))
        return _table(rows, _MESSAGE)

    def shared_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seeds = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        twice = [_flags(x, len(s)) for x, s in zip(table["refs"].to_pylist(), seeds, strict=True)]
        _, at = np.unique(np.concatenate(seeds), return_inverse=True)
        shared = np.bincount(at, weights=1 + np.concatenate(twice))[at] >= 2
        cuts = np.cumsum([len(s) for s in seeds])[:-1]
        return _table([(c, key[0].as_py(), 0, _bits(m)) for c, m in zip(table["chunk"].to_pylist(), np.split(shared, cuts), strict=True)], _ANSWER)

    def anchor_mask(chunk: _Chunk, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        seeds, at, _ = chunk.seeds()
        mask = np.zeros(len(seeds), bool)
        for bucket, a, b in _parts((seeds >> np.uint64(32)).astype(np.int64)):
            mask[a:b] = _flags(answers[bucket], b - a)
        return mask, at

    def send_windows(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        chunk, me = opened(table), key[0].as_py()
        answers = dict(zip(told["bucket"].to_pylist(), told["payload"].to_pylist(), strict=True))
        mask, at = anchor_mask(chunk, answers)
        _, windows, checks, _, least = chunk.candidates(mask, at)
        # what is known of the anchors comes back with the answer on the windows
        rows = [(b, me, 1, p, None, None) for b, p in answers.items()]
        home = (windows % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        windows, checks, least, home = windows[order], checks[order], least[order], home[order]
        for bucket, a, b in _parts(home):
            docs_here, refs = np.unique(least[a:b], return_inverse=True)
            rows.append((bucket, me, 2, windows[a:b].tobytes() + checks[a:b].tobytes(), docs_here.tobytes(), refs.astype(np.uint32 if len(docs_here) > 65535 else np.uint16).tobytes()))
        return _table(rows, _MESSAGE)

    def judge_windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, asked = [], []
        for chunk, kind, keys, ids, refs in zip(*(table[c].to_pylist() for c in ("chunk", "kind", "keys", "docs", "refs")), strict=True):
            if kind == 1:
                rows.append((chunk, key[0].as_py(), 1, keys))
                continue
            ids = np.frombuffer(ids, np.int64)
            n = len(keys) // 12
            asked.append((chunk, np.frombuffer(keys, np.uint64, n), np.frombuffer(keys, np.uint32, n, 8 * n), ids[np.frombuffer(refs, np.uint32 if len(ids) > 65535 else np.uint16)]))
        if asked:
            windows, checks, ids = (np.concatenate([a[k] for a in asked]) for k in (1, 2, 3))
            first, at = _distinct(windows, checks)
            least = np.full(len(first), _LAST, np.int64)
            np.minimum.at(least, at, ids)
            smaller = least[at] < ids
            cuts = np.cumsum([len(a[1]) for a in asked])[:-1]
            rows += [(a[0], key[0].as_py(), 2, _bits(m)) for a, m in zip(asked, np.split(smaller, cuts), strict=True)]
        return _table(rows, _ANSWER)

    kept_names = names
    schema = T.StructType(
        [T.StructField(n, T.LongType() if n == id_col else docs.schema[n].dataType) for n in kept_names]
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))),
        ]
    )

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = opened(table, True)
        anchors, judged = {}, {}
        for bucket, kind, payload in zip(told["bucket"].to_pylist(), told["kind"].to_pylist(), told["payload"].to_pylist(), strict=True):
            (anchors if kind == 1 else judged)[bucket] = payload
        mask, at = anchor_mask(chunk, anchors)
        where, windows, _, index, least = chunk.candidates(mask, at)
        home = (windows % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        smaller = np.zeros(len(windows), bool)
        for bucket, a, b in _parts(home[order]):
            smaller[order[a:b]] = _flags(judged[bucket], b - a)
        starts = chunk.starts[where]
        hit = starts[smaller[index] | (chunk.ids[chunk.doc[starts]] > least[index])]
        step = np.zeros(len(chunk.words) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + min_words, -1)
        covered = np.cumsum(step[:-1]) > 0
        first, last = chunk.spans
        nulls = table[the_text].take(chunk.order).is_null().to_pylist()
        n_words, n_removed, kept, digests, repeats = [], [], [], [], []
        for i, text in enumerate(chunk.texts):
            a, b = chunk.offsets[i], chunk.offsets[i + 1]
            gone = covered[a:b]
            edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
            if len(edge):
                begin, stop = edge[0::2], edge[1::2]
                left = np.r_[0, np.where(stop < b - a, first[a:b][np.minimum(stop, b - a - 1)], len(text))]
                right = np.r_[first[a:b][begin], len(text)]
                text = b"".join(text[x:y] for x, y in zip(left.tolist(), right.tolist(), strict=True))
                repeats.append([{"first_word": x, "n_words": y - x} for x, y in zip(begin.tolist(), stop.tolist(), strict=True)])
            else:
                repeats.append([])
            n_words.append(int(b - a))
            n_removed.append(int(gone.sum()))
            kept.append(None if nulls[i] else text.decode("utf-8", "surrogatepass"))
            digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
        taken = table.take(chunk.order)
        spans = pa.array(repeats, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())])))
        columns = [taken[o] for o in own] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string()), spans]
        return pa.Table.from_arrays(columns, names=[f.name for f in schema.fields])

    by_chunk = source.groupBy("chunk")
    anchors = by_chunk.applyInArrow(send_anchors, _MESSAGE).groupBy("bucket").applyInArrow(shared_anchors, _ANSWER)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, _MESSAGE)
    judged = windows.groupBy("bucket").applyInArrow(judge_windows, _ANSWER)
    return by_chunk.cogroup(judged.groupBy("chunk")).applyInArrow(cut, schema)
