"""Repair of the structure of conversations by a min-plus scan of 4 x 4 matrices.

What came so far is one of four states: nothing, a system turn, a user turn, an assistant turn.  A turn is a matrix
from state to state whose elements are (cost, audit): the cheapest edits that take it in, and their initials.  The
product takes the least sum of costs and joins the audits; of equal costs the audit that is least in ASCII stays.
Inserted turns are a closure of their own, put before every turn and once at the end.  The product is associative,
because two audits of one cost over the same turns are never each other's beginning (each further initial is an
insertion and costs), so a conversation may be cut anywhere and its parts combined as a tree.

Rows are range-partitioned by conversation and turn, so a conversation of any length spreads over tasks.  A task folds
its rows in pieces of bounded size.  Conversations that a task sees from end to end, in one piece, are done there; of
the others it returns one matrix and the pieces of text.  Matrices of all tasks are combined in a tree, eight at a
time, and the texts are put in order behind the audit found.

Rows that repeat a conversation, turn, role and text are counted before the shuffle.  Repeats at different turns are
found on hashes alone, with the key salted, and come to the task as markers that sort before their row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm._frames import checked_name, stored

_SPACES = " \t\n\x0b\x0c\r"
_SALTS = 16
_FAN = 8
_PIECE_ROWS, _PIECE_BYTES = 4096, 1 << 20
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {"su", "ua", "au"}

Matrix = tuple  # 16 elements, row by row: (cost, audit), or None where there is no way


def _matrix(ways: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(ways.get((i, j)) for i in range(4) for j in range(4))


def product(a: Matrix, b: Matrix) -> Matrix:
    """Least cost, then least audit, over the state between; audits are only joined where costs tie or win."""
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(x[0] + y[0], k) for k in range(4) if (x := a[i + k]) is not None and (y := b[4 * k + j]) is not None]
            if not ways:
                out.append(None)
                continue
            least = min(ways)[0]
            out.append((least, min(a[i + k][1] + b[4 * k + j][1] for cost, k in ways if cost == least)))
    return tuple(out)


def _allowed(state: int) -> list[str]:
    return ["s", "u"] if state == START else ["a"] if state == USER else ["u"]


ONE = _matrix({(i, i): (0, "") for i in range(4)})
_STEP = _matrix({(i, i): (0, "") for i in range(4)} | {(i, _AFTER[_NEXT[i][0]]): (INSERT, "I") for i in range(4)})
#: The closure: no shortest way over four states has more than three insertions.
CLOSURE = product(_STEP, product(_STEP, _STEP))


def turn(kind: str) -> Matrix:
    """The matrix of a turn: kind ``d`` must go, else its role's initial (``o`` for others), in capitals where its text is cut short."""
    ways = {(i, i): (DELETE, "D") for i in range(4)}
    if kind != "d":
        extra = CUT if kind.isupper() else 0
        for i in range(4):
            to = _AFTER[_NEXT[i][0]]
            ways[i, to] = min(ways.get((i, to), (math.inf, "")), (REROLE + extra, "R"))
            if kind.lower() in _allowed(i):
                to = _AFTER[kind.lower()]
                ways[i, to] = min(ways.get((i, to), (math.inf, "")), (KEEP + extra, "K"))
    return product(CLOSURE, _matrix(ways))


@lru_cache(1 << 16)
def _short(kinds: str) -> Matrix:
    return _tree(kinds)


def _tree(kinds: str) -> Matrix:
    if len(kinds) < 2:
        return turn(kinds) if kinds else ONE
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return product(scan(kinds[:half]), scan(kinds[half:]))


def scan(kinds: str) -> Matrix:
    """The product of the turns, as a balanced tree; short stretches are remembered."""
    return _short(kinds) if len(kinds) <= 8 else _tree(kinds)


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """From nothing to nothing or to an assistant turn."""
    whole = product(matrix, CLOSURE)
    return min(x for x in (whole[START], whole[ASSISTANT]) if x is not None)


class Rewriter:
    """Applies an audit to the rows of one conversation, in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = _NEXT[self.state]
            self.at, self.state = self.at + 1, _AFTER[role[0]]
            yield role, ""

    def lines(self, rows: list[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
        for role, text, copies in rows:
            for _ in range(copies):
                yield from self._inserted()
                edit, self.at = self.audit[self.at], self.at + 1
                if edit != "D":
                    role = _NEXT[self.state] if edit == "R" else role
                    self.state = _AFTER[role[:1]]
                    yield role, text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class _Sum:
    """What a stretch of a conversation adds up to."""

    def __init__(self) -> None:
        self.matrix, self.first, self.last = ONE, None, None
        self.low = self.high = self.first_turn = self.last_turn = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0

    def add(self, other: _Sum) -> _Sum:
        """This stretch with the one behind it."""
        if self.first is None or other.first is None:
            return other if self.first is None else self
        out = _Sum()
        out.matrix = product(self.matrix, other.matrix)
        for name in _COUNTS:
            setattr(out, name, getattr(self, name) + getattr(other, name))
        out.illegal += self.last + other.first not in LEGAL
        out.turns -= self.last_turn is not None and self.last_turn == other.first_turn
        out.first, out.last, out.first_turn, out.last_turn = self.first, other.last, self.first_turn, other.last_turn
        known = [x for x in (self.low, other.low) if x is not None]
        out.low, out.high = min(known, default=None), max((x for x in (self.high, other.high) if x is not None), default=None)
        return out

    def row(self) -> dict:
        costs, audits = [-1 if x is None else x[0] for x in self.matrix], ["" if x is None else x[1] for x in self.matrix]
        return {"costs": costs, "audits": audits} | {k: v for k, v in self.__dict__.items() if k != "matrix"}

    @staticmethod
    def read(row: dict) -> _Sum:
        out = _Sum()
        out.matrix = tuple(None if c < 0 else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True))
        for name in out.__dict__.keys() - {"matrix"}:
            setattr(out, name, row[name])
        return out


_SUM_NAMES = ("costs", "audits", *_COUNTS, "first", "last", "low", "high", "first_turn", "last_turn")
_SUM = (
    "costs array<bigint>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
    "first string, last string, low bigint, high bigint, first_turn bigint, last_turn bigint"
)
_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))
_SUM_TYPES = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 4]


def _record(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)


class _Fold:
    """The rows of one conversation that a task sees, piece by piece."""

    def __init__(self, conv, first: bool) -> None:
        self.conv, self.open, self.sum, self.seq = conv, first, _Sum(), 0
        self.kinds: list[str] = []
        self.lines: list[tuple[str, str, int]] = []
        self.held, self.piece, self.key, self.marked = 0, _Sum(), None, None

    def take(self, turn_, role: str, text: str, copies: int, blank: bool, cut: bool, key: tuple) -> None:
        p, initial = self.piece, role[:1]
        repeat = key in (self.key, self.marked)
        self.key = key
        again = copies - 1 + (repeat and not blank)
        p.blank += copies if blank else 0
        p.duplicate += 0 if blank else again
        whole = not (blank or repeat)
        p.truncated += whole and cut
        kind = "d" if not whole else initial if initial in _AFTER else "o"
        self.kinds += [kind.upper() if whole and cut else kind] + ["d"] * (copies - 1)
        p.illegal += copies - 1 + (p.first is not None and p.last + initial not in LEGAL)
        if turn_ is not None and (p.first is None or turn_ != p.last_turn):
            p.turns += 1
        if p.first is None:
            p.first, p.first_turn = initial, turn_
        p.last, p.last_turn = initial, turn_
        if turn_ is not None:
            p.low, p.high = turn_ if p.low is None else p.low, turn_
        self.lines.append((role, text, copies))
        self.held += len(text) + copies
        if len(self.kinds) >= _PIECE_ROWS or self.held >= _PIECE_BYTES:
            self.open = True

    def cut(self) -> dict:
        """The piece held so far, as it goes out; its sum is kept."""
        self.piece.matrix = scan("".join(self.kinds))
        self.sum, out = self.sum.add(self.piece), {"what": "piece", "conv_id": self.conv, "seq": self.seq, "lines": [dict(zip(("role", "text", "copies"), x, strict=True)) for x in self.lines]}
        self.seq, self.kinds, self.lines, self.held, self.piece = self.seq + 1, [], [], 0, _Sum()
        return out

    def end(self, last: bool) -> list[dict]:
        if self.open or last:
            return [self.cut(), {"what": "sum", "conv_id": self.conv} | self.sum.row()]
        rows = self.lines
        self.cut()
        cost, audit = cheapest(self.sum.matrix)
        rewriter = Rewriter(audit)
        lines = [{"role": r, "text": t} for r, t in [*rewriter.lines(rows), *rewriter.rest()]]
        return [{"what": "done", "conv_id": self.conv, "seq": 0, "cost": cost, "audit": audit, "lines": lines} | self.sum.row() | {"costs": None, "audits": None}]


_FOLD_NAMES = ["what", "conv_id", "part", "seq", "cost", "audit", "lines", *_SUM_NAMES]


def _folded(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), conv, pa.int64(), pa.int64(), pa.int64(), pa.string(), _LINES, *_SUM_TYPES]
    part, fold, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "hash", "text", "copies", "blank", "cut")), strict=True):
            conv_id, turn_, role, digest, text, copies, blank, cut = r
            if fold is None or conv_id != fold.conv:
                if fold is not None:
                    out += fold.end(False)
                fold = _Fold(conv_id, fold is None)
            key = (turn_, role, digest)
            if copies == 0:
                fold.marked = key
                continue
            fold.take(turn_, role, text, copies, blank, cut, key)
            if len(fold.kinds) >= _PIECE_ROWS or fold.held >= _PIECE_BYTES:
                out.append(fold.cut())
                yield _record([x | {"part": part} for x in out], _FOLD_NAMES, types)
                out = []
        if out:
            yield _record([x | {"part": part} for x in out], _FOLD_NAMES, types)
            out = []
    if fold is not None:
        yield _record([x | {"part": part} for x in fold.end(True)], _FOLD_NAMES, types)


def _combined(table: pa.Table) -> pa.Table:
    """The sums of one conversation from neighbouring parts as one."""
    rows, total = table.sort_by("part").to_pylist(), _Sum()
    for row in rows:
        total = total.add(_Sum.read(row))
    one = rows[0] | total.row()
    return pa.Table.from_batches([_record([one], table.column_names, table.schema.types)])


def _rewritten(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces in order behind the audit of their conversation; the digest comes with the last one."""
    names, types = ["conv_id", "piece", "lines", "repaired_sha256"], [conv, pa.int64(), _LINES, pa.string()]
    current, rewriter, digest, n = (), None, None, 0

    def close() -> pa.RecordBatch:
        lines = list(rewriter.rest())
        feed(lines)
        return _record([{"conv_id": current[0], "piece": n, "lines": [{"role": r, "text": t} for r, t in lines], "repaired_sha256": digest.hexdigest()}], names, types)

    def feed(lines: list[tuple[str, str]]) -> None:
        nonlocal begun
        for role, text in lines:
            digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True

    begun = False
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if rewriter is not None:
                    yield close()
                current, rewriter, digest, n, begun = (row["conv_id"],), Rewriter(row["audit"]), hashlib.sha256(), 0, False
                continue
            lines = list(rewriter.lines([(x["role"], x["text"], x["copies"]) for x in row["lines"]]))
            feed(lines)
            yield _record([{"conv_id": row["conv_id"], "piece": n, "lines": [{"role": r, "text": t} for r, t in lines]}], names, types)
            n += 1
    if rewriter is not None:
        yield close()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one with its number of copies."""
    for batch in batches:
        if batch.num_rows:
            groups = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([([], "count_all")])
            yield from groups.rename_columns([*batch.schema.names, "copies"]).to_batches()


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of rows with conv_id, turn (whole numbers), role and text; other columns are not read.

    conversations, one row for each conv_id (null is one of them): gaps (greatest turn - least + 1 - distinct turns;
    0 without turns), blank, duplicate and truncated (rows by their first fault), illegal (neighbouring roles that may
    not follow each other), cost, audit (the initials of Keep, Rerole, Delete, Insert) and repaired_sha256.
    turns: conv_id, piece, lines (array of role and text); the pieces of a conversation, in order, are its repair.

    Rows are taken by turn, null first; rows of one turn by role, then by the SHA-256 of their text, so repeated rows
    stand together.  A null role or text is one space; an empty or blank text is blank.  A repaired conversation has
    roles that begin ``(s?(ua)+)?``: any role that begins so is kept, another is given user or assistant.  Very long
    texts and conversations are folded in pieces; one text is held whole.  A table without rows gives none.
    """
    checked_name(rows, "conv_id", "turn", "role", "text")
    text = F.coalesce(F.col("text"), F.lit(" "))
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("hash"), text.alias("text"))
    conv = plain.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {conv}, turn bigint, role string, hash binary"
    counted = plain.mapInArrow(_counted, f"{key}, text string, copies bigint")

    # rows that repeat role and text of an earlier turn
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = plain.groupBy("conv_id", "role", "hash").agg(F.min(at).alias("low"), F.max(at).alias("high")).where(~F.col("low").eqNullSafe(F.col("high")))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "low", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("s"))
    each = plain.select("conv_id", "turn", "role", "hash").distinct().withColumn("salt", F.pmod(F.hash("turn"), F.lit(_SALTS)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s"))
    markers = each.join(first, same).where(~at.eqNullSafe(F.col("low"))).select("conv_id", "turn", "role", "hash", F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("copies"))
    markers = stored(markers, "markers")

    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    both = counted.unionByName(markers).repartitionByRange("conv_id", "turn", "role", "hash").sortWithinPartitions("conv_id", "turn", "role", "hash", "copies")
    both = both.select("*", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    kind = pa.schema(both.limit(0).toArrow().schema).field("conv_id").type
    names = f"what string, conv_id {conv}, part bigint, seq bigint, cost bigint, audit string, lines array<struct<role:string,text:string,copies:bigint>>, {_SUM}"
    folded = stored(both.mapInArrow(lambda batches: _folded(batches, kind), names), "folded")

    sums = folded.where("what = 'sum'").select("conv_id", "part", *_SUM_NAMES)
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for level in range(1, math.ceil(math.log(parts, _FAN)) + 1):
        sums = sums.withColumn("node", F.floor(F.col("part") / _FAN**level)).groupBy("conv_id", "node").applyInArrow(_combined, sums.withColumn("node", F.lit(0).cast("bigint")).schema).drop("node")
    found = stored(_finished(sums, conv, kind), "sums")

    pieces = folded.where("what = 'piece'").select("conv_id", F.lit(None).cast("string").alias("audit"), "part", "seq", "lines")
    heads = found.select("conv_id", "audit", F.lit(-1).cast("bigint").alias("part"), F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast(pieces.schema["lines"].dataType).alias("lines"))
    lines = "array<struct<role:string,text:string,copies:bigint>>"
    ordered = heads.unionByName(pieces).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    long = stored(ordered.mapInArrow(lambda batches: _rewritten(batches, kind), f"conv_id {conv}, piece bigint, lines {lines}, repaired_sha256 string"), "repaired")

    done = folded.where("what = 'done'")
    joined = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    told = ["conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    digests = long.where("repaired_sha256 is not null").select(F.col("conv_id").alias("c"), "repaired_sha256")
    conversations = done.withColumn("repaired_sha256", F.sha2(joined, 256)).select(*told).unionByName(found.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).select(*told))
    bare_lines = F.transform("lines", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("lines")
    turns = done.select("conv_id", F.col("seq").alias("piece"), bare_lines).unionByName(long.select("conv_id", "piece", bare_lines))
    return conversations, turns


def _finished(sums: DataFrame, conv: str, kind: pa.DataType) -> DataFrame:
    """Cost and audit of whole conversations in place of their matrices."""
    names = ["conv_id", "low", "high", *_COUNTS, "cost", "audit"]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["cost"], r["audit"] = cheapest(_Sum.read(r).matrix)
            yield _record(rows, names, [kind, *[pa.int64()] * 8, pa.string()])

    return sums.mapInArrow(finished, f"conv_id {conv}, low bigint, high bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, cost bigint, audit string")
