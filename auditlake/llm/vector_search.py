"""Exact top-k by inner product: multi-resolution segment statistics, coarse to fine, exact distances for survivors.

Components are floored to 1/``scale`` and then whole numbers.  A vector is cut into 1, 2, 4, ... equal segments; of
each segment its mean and its standard deviation are kept.  With m, s of a query and m', s' of a candidate over
segments of length L,

    distance^2 >= sum L ((m - m')^2 + (s - s')^2),

and, because |q|^2 = sum L (m^2 + s^2), that says the same as  q x <= sum L (m m' + s s').  A candidate leaves as soon
as the bound of one level shows that it cannot reach the k-th score known so far; what survives the finest level is
scored exactly, in whole numbers.

Queries and candidates meet in cells of a grid, blocks against blocks: each side is dealt to cells by a hash and
bounded in bytes, so a task holds two blocks, whatever the number of rows.  A first sixteenth of the cells gives each
query a score to reach; the other cells return only what reaches it, so the rows between the rounds and the end stay
some tens a query.  Rows that repeat an id and a vector are one row with a count before anything is dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm._frames import checked_name, stored

_CELL = 16 << 20
_CELLS = 64
_ROWS, _COLUMNS = 256, 1024
_LIMIT = float(1 << 63)
_FOUND = "query_id bigint, query binary, copies bigint, vec_id bigint, n bigint, score bigint"


def _packed(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Whole-number vectors as bytes: one that names the width of a component, then the components."""
    for batch in batches:
        lists = batch.column("embedding").cast(pa.list_(pa.float64()))
        offsets, flat = lists.offsets.to_numpy(), lists.values
        values = flat.fill_null(math.nan).to_numpy(zero_copy_only=False)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        whole = np.floor(scale * np.where(np.isfinite(values), values, 0))
        most = np.nextafter(_LIMIT, 0)
        whole = np.clip(whole, -most, most).astype(np.int64)
        ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(ok)
        out = []
        for i in rows.tolist():
            v = whole[offsets[i] : offsets[i + 1]]
            top = max(int(v.max()), -int(v.min())) if len(v) else 0
            width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
            out.append(bytes([width]) + v.astype(f"<i{width}").tobytes())
        kept = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([kept.column("vec_id"), pa.array(out, pa.binary()), kept.column("asked")], ["vec_id", "vector", "asked"])


class _Block:
    """Vectors of like size, padded with zeros to a power of two, and their segment statistics."""

    def __init__(self, rows: np.ndarray, vectors: list[bytes], size: int) -> None:
        self.rows = rows
        self.whole = np.zeros((len(rows), size), np.int64)
        for at, i in enumerate(rows.tolist()):
            v = np.frombuffer(vectors[i], f"<i{vectors[i][0]}", offset=1)
            self.whole[at, : len(v)] = v

    def statistics(self, size: int) -> list[np.ndarray]:
        """Per level, coarse to fine: sqrt(L) times the means, then times the deviations, of all segments."""
        x, levels, parts = self.whole[:, :size].astype(np.float64), [], 1
        while parts < max(2, size):
            s = x.reshape(len(x), parts, size // parts)
            mean = s.mean(axis=2, keepdims=True)
            levels.append(np.concatenate([mean[:, :, 0] * math.sqrt(size // parts), np.sqrt(np.square(s - mean).sum(axis=2))], axis=1))
            parts *= 2
        return levels


def _blocks(vectors: list[bytes], most: int) -> list[_Block]:
    """Blocks of up to ``most`` vectors whose sizes have one power of two; the order within a size is kept."""
    sizes = np.array([1 << max(0, (len(v) - 1) // v[0] - 1).bit_length() for v in vectors], np.int64)
    out = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out += [_Block(rows[a : a + most], vectors, size) for a in range(0, len(rows), most)]
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond a long are its bounds."""
    top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if top(a) * top(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    product = a.astype(object) @ b.astype(object).T
    return np.clip(product, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(queries: list[bytes], floors: np.ndarray, candidates: list[bytes], own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's ``k`` best that reach its floor; of equal scores the first candidates.

    ``own`` is the candidate that a query may not find, or -1.  Floors are -inf where none is known.
    """
    found = []
    columns = _blocks(candidates, _COLUMNS)
    columns.sort(key=lambda b: int(b.rows[0]))
    for block in _blocks(queries, _ROWS):
        ours: dict[int, list[np.ndarray]] = {}
        floor = floors[block.rows].astype(np.float64)
        best = np.zeros((0, 3), np.int64)
        for other in columns:
            size = min(block.whole.shape[1], other.whole.shape[1])
            if size not in ours:
                ours[size] = block.statistics(size)
            rows, cols = np.arange(len(block.rows)), np.arange(len(other.rows))
            alive = np.ones((len(rows), len(cols)), bool)
            for q, x in zip(ours[size], other.statistics(size), strict=True):
                bound = q[rows] @ x[cols].T
                # rounding may not lose a candidate
                bound += 1e-9 * np.linalg.norm(q[rows], axis=1)[:, None] * np.linalg.norm(x[cols], axis=1)[None, :] + 1e-3
                alive &= bound >= floor[rows][:, None]
                r, c = alive.any(axis=1), alive.any(axis=0)
                rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
                if not len(rows):
                    break
            if not len(rows):
                continue
            score = _scores(block.whole[rows, :size], other.whole[cols, :size])
            alive &= (score >= floor[rows][:, None]) & (own[block.rows[rows]][:, None] != other.rows[cols][None, :])
            i, j = np.nonzero(alive)
            if not len(i):
                continue
            best = np.concatenate([best, np.stack([rows[i], other.rows[cols[j]], score[i, j]], axis=1)])
            best = best[np.lexsort((best[:, 1], -best[:, 2], best[:, 0]))]
            first = np.flatnonzero(np.diff(best[:, 0], prepend=-1))
            place = np.arange(len(best)) - np.repeat(first, np.diff(np.append(first, len(best))))
            last = best[place == k - 1]
            if len({b.whole.shape[1] for b in columns}) == 1:
                # candidates come in order, so a later one has to be better than the k-th
                floor[last[:, 0]] = np.maximum(floor[last[:, 0]], last[:, 2].astype(np.float64) + 1)
            else:
                floor[last[:, 0]] = np.maximum(floor[last[:, 0]], last[:, 2].astype(np.float64))
            best = best[place < k]
        found += [(int(block.rows[q]), x, s) for q, x, s in best.tolist()]
    return found


def _cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    order = [("vec_id", "ascending"), ("vector", "ascending")]
    candidates = candidates.sort_by(order)
    rows, vectors = candidates.column("vec_id").to_pylist(), candidates.column("vector").to_pylist()
    n = candidates.column("n").to_pylist()
    at = {pair: i for i, pair in enumerate(zip(rows, vectors, strict=True))}
    ids, asked = queries.column("vec_id").to_pylist(), queries.column("vector").to_pylist()
    floors = queries.column("floor").cast(pa.float64(), safe=False).fill_null(-math.inf).to_numpy(zero_copy_only=False)
    # a query whose row has copies finds the copies
    own = np.array([i if (i := at.get(pair, -1)) >= 0 and n[i] == 1 else -1 for pair in zip(ids, asked, strict=True)], np.int64)
    found = search(asked, floors, vectors, own, k) if ids and rows else []
    copies = queries.column("n").to_pylist()
    out = [(ids[q], asked[q], copies[q], rows[x], n[x] - (at.get((ids[q], asked[q]), -1) == x), s) for q, x, s in found]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["query_id", "query", "copies", "vec_id", "n", "score"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query, copies counted."""
    each = found.withColumn("copy", F.explode(F.expr(f"sequence(1L, least(n, {k}L))")))
    place = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return each.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, asked: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """For each row where ``asked`` holds (on vec_id) its ``k`` other rows of highest inner product.

    ``rows`` has vec_id (whole numbers) and embedding (an array of numbers); other columns are not read.  Returns
    query_id, rank (from 1), vec_id and score, the inner product of components floored to 1/``scale``, times its
    square.  Ties go to the smaller vec_id, null last.  Fewer rows than ``k``: all of them.

    A vector that is null, or holds a null, NaN or infinity, takes no part.  An empty vector has score 0 with all;
    a shorter vector counts as if zeros followed.  A row without vec_id is a candidate, never a query.  Rows that
    repeat an id are rows: each is a query of its own, none finds itself, and each finds the others.  Components and
    scores beyond a long count as its bounds.  Very long vectors: a block holds them whole.  An empty table gives no rows.
    """
    checked_name(rows, "vec_id", "embedding")
    if k < 1:
        raise ValueError("k is 1 or more")
    plain = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    plain = plain.withColumn("asked", F.coalesce(asked & F.col("vec_id").isNotNull(), F.lit(False)))
    whole = plain.mapInArrow(lambda batches: _packed(batches, scale), "vec_id bigint, vector binary, asked boolean")
    whole = stored(whole.groupBy("vec_id", "vector", "asked").agg(F.count("*").alias("n")), "vectors")
    totals = whole.agg(F.sum(F.length("vector")).alias("all"), F.sum(F.when(F.col("asked"), F.length("vector"))).alias("asked")).first()
    held = totals["all"] or 0
    down = max(1, math.ceil(held / min(_CELL, max(1 << 18, held // _CELLS))))
    across = max(1, math.ceil((totals["asked"] or 0) / _CELL))
    key = F.xxhash64("vec_id", "vector")
    queries = whole.where("asked").select("vec_id", "vector", "n", F.pmod(key, F.lit(across)).alias("g"))
    dealt = whole.select("vec_id", "vector", "n", F.pmod(key, F.lit(down)).alias("r"))

    def searched(floors: DataFrame, first: int, end: int) -> DataFrame:
        left = floors.withColumn("r", F.explode(F.sequence(F.lit(first), F.lit(end - 1)))).select("g", F.col("r").cast("bigint").alias("r"), "vec_id", "vector", "n", "floor")
        right = dealt.where((F.col("r") >= first) & (F.col("r") < end))
        right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select(F.col("g").cast("bigint").alias("g"), "r", "vec_id", "vector", "n")
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)
        return left.groupBy("g", "r").cogroup(right.groupBy("g", "r")).applyInArrow(lambda q, x: _cell(q, x, k), _FOUND)

    first = math.ceil(down / 16)
    found = stored(searched(queries.withColumn("floor", F.lit(None).cast("bigint")), 0, first), "found")
    if first < down:
        reached = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("query").alias("vector"), F.col("score").alias("floor"))
        found = found.unionByName(searched(queries.join(reached, ["vec_id", "vector"], "left"), first, down))
    best = _ranked(found, k)
    return best.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
