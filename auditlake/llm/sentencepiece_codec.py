"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

A document of up to ``chunk_chars`` characters is a single chunk, without boundary states, and is
traced where it lies.  Longer ones are split into chunks that are dealt out over the cluster; each
chunk yields its boundary-state transfer matrix, the small matrices of a document are combined, and
every chunk is traced back on its own between the states chosen for it.  All ids come from these
paths; the result equals the public library's, byte for byte, for models that leave texts as they
are (others are refused).

The model file is read on the driver and broadcast (a vocabulary, so of bounded size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import max_plus as M
from auditlake.llm._frames import checked_name

CHUNK_CHARS = 1 << 15
_SLICE = 1 << 20
_CHUNK = "key long, n int, body string, begin int, end int, is_first boolean, is_last boolean"
_held: dict[int, M.Pieces] = {}


def _pieces(shared, held: int = M.HELD) -> M.Pieces:
    """The model, opened once in each worker, which remembers ``held`` words and pairs of pieces at most."""
    key = hash(shared.value)
    if key not in _held:
        _held.clear()
        _held[key] = M.Pieces(shared.value)
    _held[key].held = held
    return _held[key]


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= _SLICE or i + 1 == len(texts):
            yield start, i + 1
            start, held = i + 1, 0


def _read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, held: int = M.HELD) -> DataFrame:
    """Per row: the id column, ``n_ids``, ``ids`` (array of piece ids) and ``round_trip`` (decoding gives the text back).

    Defined cases: a null text has null ``ids``, 0 ``n_ids`` and a true ``round_trip``; an empty text has
    an empty array; a text of any length is encoded whole; a text that holds the model's own space mark (U+2581) comes back with a space there,
    and ``round_trip`` says so; lone surrogates cannot reach Spark strings; rows that repeat an id are
    encoded by their own texts and repeated rows get the same result; an empty table gives an empty one;
    other columns are not looked at.  ``held`` bounds what a worker remembers, some 250 bytes for a word and for a pair;
    what it forgets it finds again, so results do not depend on it.
    """
    checked_name(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(_read_model(model_path))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared, held)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in _slices(every):
                texts = every[a:b]
                ids = [None if t is None else pieces.encode(t) for t in texts]
                same = [t is None or t == pieces.decode(i) for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(i or ()) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["id", "n_ids", "ids", "round_trip"]
                )

    schema = f"id {kind}, n_ids long, ids array<int>, round_trip boolean"
    small = rows.where(~giant).mapInArrow(whole, schema)
    large = rows.where(giant).withColumn("key", F.xxhash64("id", "text"))
    traced = _scan(large.select("key", "text"), shared, chunk_chars, held)
    found = large.select("id", "key").join(traced, "key")
    return small.unionByName(found.select("id", "n_ids", "ids", "round_trip")).withColumnRenamed("id", id_col)


def _scan(large: DataFrame, shared, chunk_chars: int, held: int) -> DataFrame:
    """key, n_ids, ids, round_trip of giant documents; equal documents are encoded once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = _pieces(shared, held).longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = M.marked(text)
                rows = []
                for n, p in enumerate(range(0, len(body), chunk_chars)):
                    q = min(len(body), p + chunk_chars)
                    a, b = max(0, p - reach), min(len(body), q + reach)
                    rows.append((key, n, body[a:b], p - a, q - a, p == 0, q == len(body)))
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
                names = ["key", "n", "body", "begin", "end", "is_first", "is_last"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, int, M.Chunk]]:
        pieces = _pieces(shared, held)
        names = ("key", "n", "body", "begin", "end", "is_first", "is_last")
        for key, n, body, begin, end, first, last in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            yield key, n, M.Chunk(pieces, body, begin, end, first, last)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, n, (m := c.matrix()).shape[0], m.astype(np.float64).tobytes()) for key, n, c in opened(batch)]
            keys, ns, sizes, bodies = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())], names=["key", "n", "size", "matrix"])

    def combined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("n", "size", "matrix")), strict=True))
        chosen = M.choose([np.frombuffer(m, np.float64).reshape(size, -1) for _, size, m in rows])
        return pa.table({"key": pa.array([key[0].as_py()] * len(rows), pa.int64()), "n": pa.array([r[0] for r in rows], pa.int32()), "entry": pa.array([c[0] for c in chosen], pa.int32()), "goal": pa.array([c[1] for c in chosen], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = zip(batch.column(batch.schema.get_field_index("entry")).to_pylist(), batch.column(batch.schema.get_field_index("goal")).to_pylist(), strict=True)
            rows = [(key, n, c.trace(e, g)) for (key, n, c), (e, g) in zip(opened(batch), chosen, strict=True)]
            keys, ns, ids = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["key", "n", "ids"])

    def join_up(key: tuple[pa.Scalar, ...], parts: pa.Table, text: pa.Table) -> pa.Table:
        ids = [i for _, part in sorted(zip(parts["n"].to_pylist(), parts["ids"].to_pylist(), strict=True)) for i in part]
        same = _pieces(shared, held).decode(ids) == text["text"][0].as_py()
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32())), "round_trip": pa.array([same])})

    once = large.dropDuplicates(["key"])
    # dealt by chunk, so that the chunks of one document lie in many tasks
    chunks = once.mapInArrow(split, _CHUNK)
    dealt = chunks.repartition("key", "n")
    states = dealt.mapInArrow(transfer, "key long, n int, size int, matrix binary").groupBy("key").applyInArrow(combined, "key long, n int, entry int, goal int")
    parts = chunks.join(states, ["key", "n"]).mapInArrow(trace, "key long, n int, ids array<int>")
    return parts.groupBy("key").cogroup(once.groupBy("key")).applyInArrow(join_up, "key long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of an array of piece ids (null for null); a same-named column is replaced."""
    checked_name(encoded, ids_col)
    shared = encoded.sparkSession.sparkContext.broadcast(_read_model(model_path))
    names = [c for c in encoded.columns if c != out_col]
    source = encoded.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in batches:
            texts = [None if i is None else pieces.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())])
    return source.mapInArrow(run, schema).toDF(*names, out_col)
