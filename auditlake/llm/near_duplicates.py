"""Near-duplicate groups from bottom-k sketches.

One hash function orders the shingles; a document's sketch is its ``SKETCH`` smallest
shingle hashes (for shorter sets, the set).  Inverted lists of retained values propose
pairs, the sketch of the union estimates their similarity, and exact Jaccard on the full
sets confirms every link.

How the work stays linear when a third of the corpus is one group:

* documents with equal shingle sets form a class and are handled once;
* a class links to something only if enough of its retained values lie in other sketches,
  and only if at least ``percent`` of its full set lies in other classes; these counts come
  from one packed exchange of 4 bytes a value, dealt by hash bucket.  A value that a task finds
  in two classes is counted there and sent once for the whole task, so a value that every
  document has is one entry a task;
* a class is listed under the rarest of its retained values, so that values of common
  passages are not used where rarer ones decide;
* each list is compared with one typical member, its centre.  Lists that still hold several
  components are split by what their members do *not* share with the centre (below), and
  the parts are treated in the same way until nothing is left.  Pairs are only made in lists of
  at most ``SMALL`` members outside their largest component, or where one side of a list has no more:
  at most ``SMALL`` for each entry; or where those of all lists are fewer than the classes;
* where a split leaves over three quarters of the entries it was given, splitting ends and the members
  outside the largest component of each list are paired with the others.  That is quadratic where many
  members lie equally far from each other, but the pairs are joined and counted once in tasks that spill.

Splitting a list.  For a centre c let D(x) be the symmetric difference of x and c.  Then
|x ^ y| = |D(x) ^ D(y)|, and two classes are linked when (100 + p) |x ^ y| <= (100 - p) (|x| + |y|).
If x is not linked with c, a link between x and y therefore needs a number of common elements
of D(x) and D(y) that follows from the sizes alone and is at least one.  By the prefix rule it is
enough to list x under the |D(x)| - needed + 1 elements of D(x) that fewest members have.
Copies with different edits then have hardly a list in common.

Two linked documents of more than ``SKETCH`` shingles share at least ``least_common(percent)``
retained values but for a chance below 1e-8 (binomial tail; 35 of 64 at 85); for sets that fit in
the sketch this is certain.  Sets are compared as 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm import _hashing as H
from auditlake.llm._components import connected_components
from auditlake.llm._frames import FEW, checked_name, chunk_bytes, small, stored

SKETCH = 64
#: A list is compared pair by pair where one of its sides has so many members, or fewer.
SMALL = 32
#: A task remembers so many values of many classes, those that OFTEN classes of a slice have.
_REMEMBERED = 1 << 16
_OFTEN = 8
_SLICE = 1 << 20
_WORDS = H.whitespace_words(True)


def least_common(percent: int) -> int:
    """Of SKETCH values of a union, how many two linked sets share but for a chance below 1e-8."""
    p, below, m = percent / 100, 0.0, 0
    while m < SKETCH:
        below += math.comb(SKETCH, m) * p**m * (1 - p) ** (SKETCH - m)
        if below >= 1e-8:
            break
        m += 1
    if m < 1:
        raise ValueError(f"a similarity of {percent} % is too small for sketches of {SKETCH} values")
    return m


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    hashes, offsets = H.words(texts, _WORDS)
    grams = H.ngrams(hashes, size)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - size + 1]) if b - a >= size else H.ngrams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    """The first SKETCH values as signed numbers in the same order."""
    return (values[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64)


def set_class(values: np.ndarray) -> int:
    """64-bit identity of a shingle set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(H.mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)
    return int(H.mix(np.array([total + np.uint64(len(values))]))[0].astype(np.int64))


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    return _runs_of([len(text or "") for text in texts])


def _runs_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of these sizes, each of about _SLICE."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= _SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _opened(column: pa.Array) -> Iterator[tuple[int, int, list]]:
    """Slices of a column of texts, turned into strings one after the other."""
    for a, b in _runs_of(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        yield a, b, column.slice(a, b - a).to_pylist()


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in _opened(batch.column(1)):
                sets = shingle_sets([H.utf8(t) for t in texts], size)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_class(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([_signed(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "cls", "sketch"],
                )

    return run


_PACKED = "bucket int, classes binary, counts binary, keys binary"


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    cut = np.flatnonzero(np.diff(marks)) + 1
    return list(zip(np.r_[0, cut].tolist(), np.r_[cut, len(marks)].tolist(), strict=True)) if len(marks) else []


class _Packer:
    """Packs the values of classes by bucket; one for each task.

    A row of a bucket from 0 holds the low 32 bits of values, grouped by class (the bucket is made
    from the high bits), and, after these, values that lie in several classes and are not listed by class.
    A row of a bucket below 0 holds counts of values already known to be shared, by class.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known = np.zeros(0, np.uint64)

    def pack(self, classes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        rows: list[tuple] = []
        if sets and sum(map(len, sets)):
            ids = np.array(classes, np.int64)
            values = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.lexsort((ids[owner], values))
            values, owner = values[order], owner[order]
            # rows that repeat a class count once
            again = np.r_[False, (values[1:] == values[:-1]) & (ids[owner[1:]] == ids[owner[:-1]])]
            values, owner = values[~again], owner[~again]
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            times = np.diff(np.r_[first, len(values)])
            distinct = values[first]
            at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
            old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
            fresh = distinct[(times > 1) & ~old]
            here = np.repeat((times > 1) | old, times)
            often = distinct[(times >= _OFTEN) & ~old]
            if len(often) and len(self.known) + len(often) <= _REMEMBERED:
                self.known = np.union1d(self.known, often)
            counts = np.bincount(owner[here], minlength=len(ids))
            some = counts > 0
            if some.any():
                rows.append((-1 - int(ids[0] % self.buckets), ids[some].tobytes(), counts[some].astype(np.uint32).tobytes(), b""))
            rest, whose = values[~here], owner[~here]
            homes = [((v >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64) for v in (rest, fresh)]
            order = np.lexsort((whose, homes[0]))
            rest, whose, home = rest[order].astype(np.uint32), whose[order], homes[0][order]
            for a, b in _runs(home):
                first = np.array([x for x, _ in _runs(whose[a:b])])
                rows.append((int(home[a]), ids[whose[a:b][first]].tobytes(), np.diff(np.r_[first, b - a]).astype(np.uint32).tobytes(), rest[a:b].tobytes()))
            order = np.argsort(homes[1], kind="stable")
            for a, b in _runs(homes[1][order]):
                rows.append((int(homes[1][order[a]]), b"", b"", fresh[order[a:b]].astype(np.uint32).tobytes()))
        bucket, one, two, three = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(three, pa.binary())], names=["bucket", "classes", "counts", "keys"])


def _count_shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each class, how many of its values in this bucket another class has too (rows that repeat a class may count twice)."""
    rows = list(zip(*(table[c].to_pylist() for c in ("classes", "counts", "keys")), strict=True))
    classes = np.concatenate([np.frombuffer(c, np.int64) for c, _, _ in rows])
    counts = np.concatenate([np.frombuffer(n, np.uint32) for _, n, _ in rows])
    names, at = np.unique(classes, return_inverse=True)
    if key[0].as_py() < 0:
        n = np.bincount(at, weights=counts, minlength=len(names)).astype(np.int64)
    else:
        listed = [np.frombuffer(k, np.uint32) for c, _, k in rows if c]
        many = [np.frombuffer(k, np.uint32) for c, _, k in rows if not c]
        pairs = (np.concatenate(listed) if listed else np.zeros(0, np.uint32)).astype(np.uint64) << np.uint64(32)
        pairs = np.unique(pairs | np.repeat(at, counts).astype(np.uint64))
        values = pairs >> np.uint64(32)
        same = values[1:] == values[:-1]
        shared = (np.r_[False, same] | np.r_[same, False])[: len(values)]
        if many:
            shared |= np.isin(values, np.unique(np.concatenate(many)).astype(np.uint64))
        n = np.bincount((pairs[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
    some = n > 0
    return pa.table({"cls": pa.array(names[some], pa.int64()), "shared": pa.array(n[some], pa.int64())})


def _shared_values(rows: DataFrame, values: int, pack) -> DataFrame:
    """cls, shared: over ``rows``, by the packed exchange; ``values`` bounds the number of values sent."""
    buckets = values // (4 << 20) + 1
    sent = rows.mapInArrow(pack(buckets), _PACKED)
    return sent.groupBy("bucket").applyInArrow(_count_shared, "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))


def _pack_sketches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for batch in batches:
            first = {c: s for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
            yield packer.pack(list(first), [np.array(s, np.int64).astype(np.uint64) for s in first.values()])

    return run


def _pack_texts(size: int):
    def make(buckets: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = _Packer(buckets)
            for batch in batches:
                classes = batch.column(0).to_pylist()
                for a, b, texts in _opened(batch.column(1)):
                    yield packer.pack(classes[a:b], shingle_sets([H.utf8(t) for t in texts], size))

        return run

    return make


def _difference(centre: np.ndarray, other: np.ndarray, percent: int) -> tuple[bool, np.ndarray, int, int, int]:
    """Whether ``other`` is linked with the centre, their symmetric difference, and under how many of its elements ``other`` is listed: for any pairs, and for pairs with others that are not linked with the centre either; and its ``low`` (see ``_listed``)."""
    elements = np.setxor1d(other, centre, assume_unique=True)
    size, p, q = len(elements), 100 + percent, 100 - percent
    linked = p * size <= q * (len(other) + len(centre))
    # common elements needed with any other class, and with one that is not linked with the centre either
    with_any = max(1, -((q * len(other) - percent * size) // percent))
    with_apart = max(with_any, (p * size - q * len(other) + q * len(centre)) // (2 * p) + 1)
    short = max(0, size - with_apart + 1)
    return linked, elements.view(np.int64), short if linked else max(0, size - with_any + 1), short, p * size - q * len(other)


def _compared(pairs: DataFrame, texts: DataFrame, size: int, percent: int, chunks: int, split: bool = False) -> DataFrame:
    """The pairs (a, b), a table read back, and whether exact Jaccard links them; the set of ``a`` is sent once to each chunk that needs it.

    Only texts that the pairs name are moved, unless the pairs are more than FEW.

    With ``split`` also their difference and under how many of its elements ``b`` is listed (``_difference``), ``a`` being the centre.
    """

    def home(c: str):
        return F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")

    def sets_of(table: pa.Table, wanted: set) -> dict[int, np.ndarray]:
        held = {c: t for c, t in zip(table["cls"].to_pylist(), table["text"].to_pylist(), strict=True) if c in wanted}
        found: dict[int, np.ndarray] = {}
        classes, bodies = list(held), list(held.values())
        for a, b in _slices(bodies):
            found |= zip(classes[a:b], shingle_sets([H.utf8(t) for t in bodies[a:b]], size), strict=True)
        return found

    def send(key: tuple[pa.Scalar, ...], table: pa.Table, asked: pa.Table) -> pa.Table:
        a, to = asked["a"].to_pylist(), asked["to"].to_pylist()
        sets = sets_of(table, set(a))
        return pa.table({"chunk": pa.array(to, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.nulls(len(a), pa.int64()), "body": pa.array([sets[x].tobytes() for x in a], pa.binary())})

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        a, b, body = (told[c].to_pylist() for c in ("a", "b", "body"))
        sent = {x: np.frombuffer(s, np.uint64) for x, s in zip(a, body, strict=True) if s is not None}
        todo = [(x, y) for x, y in zip(a, b, strict=True) if y is not None]
        own = sets_of(table, {y for _, y in todo})
        found = [_difference(sent[x], own[y], percent) for x, y in todo]
        out = {"a": pa.array([x for x, _ in todo], pa.int64()), "b": pa.array([y for _, y in todo], pa.int64()), "linked": pa.array([f[0] for f in found], pa.bool_())}
        if split:
            out |= {"elements": pa.array([f[1] for f in found], pa.list_(pa.int64())), "places": pa.array([f[2] for f in found], pa.int32()), "short": pa.array([f[3] for f in found], pa.int32()), "low": pa.array([f[4] for f in found], pa.int64())}
        return pa.table(out)

    message = "chunk int, a long, b long, body binary"
    some = pairs.count() <= FEW

    def by_chunk(side: str):
        named = texts.join(F.broadcast(pairs.select(F.col(side).alias("cls")).distinct()), "cls", "left_semi") if some else texts
        return named.withColumn("chunk", home("cls")).groupBy("chunk")

    asked = pairs.select("a", home("a").alias("chunk"), home("b").alias("to")).distinct()
    sent = by_chunk("a").cogroup(asked.groupBy("chunk")).applyInArrow(send, message)
    told = sent.unionByName(pairs.select(home("b").alias("chunk"), "a", "b", F.lit(None).cast("binary").alias("body")))
    return by_chunk("b").cogroup(told.groupBy("chunk")).applyInArrow(compare, "a long, b long, linked boolean" + ", elements array<long>, places int, short int, low long" * split)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, detail: bool = False) -> DataFrame:
    """Groups of documents linked by ``100 * |A & B| >= percent * |A | B|`` over their shingle sets.

    Returns one row per input row: the id column, ``n_shingles`` (size of the set),
    ``component_id`` (least id reachable over links, its own included) and ``kept`` (the
    id is the component's).  Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  With ``detail`` also ``set_class``
    (of the row's shingle set, see ``text_class``) and ``root`` (the least class reachable; components that begin with one id
    differ in it), both null for an empty set.

    Defined cases: a text of 1 to ``size`` - 1 words is one shingle; a null text or one without
    words has an empty set and is linked with nothing; a document without id is linked with
    nothing, has a null ``component_id`` and is kept; rows that repeat an id are compared by
    their own texts, and rows repeating id and text get the same result; ties on the least id
    cannot occur between different ids; an empty table gives an empty one; other columns are
    not looked at.
    """
    checked_name(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    known = stored(rows.mapInArrow(_sketches(size), f"id {kind}, n long, cls long, sketch array<long>"), "sketches")
    links = _links(rows, known, size, percent)
    classes = known.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("least"))
    grouped = classes.join(connected_components(links).select(F.col("node").alias("cls"), "root"), "cls", "left")
    roots = grouped.where("root is not null").groupBy("root").agg(F.min("least").alias("lowest"))
    grouped = grouped.join(roots, "root", "left").select("cls", F.coalesce("lowest", "least").alias("found"), F.coalesce("root", "cls").alias("root"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    more = [F.col("cls").alias("set_class"), "root"] if detail else []
    return known.select("id", "n", "cls").join(grouped, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *more
    )


def text_class(text: Column, size: int = 5) -> Column:
    """The class of a text's shingle set, by which rows of one id are told apart; null for an empty set."""

    @F.arrow_udf("bigint")
    def classes(texts: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for _, _, part in _opened(texts):
            out += [set_class(s) if len(s) else None for s in shingle_sets([H.utf8(t) for t in part], size)]
        return pa.array(out, pa.int64())

    return classes(text)


def _links(rows: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    listed = known.where("cls is not null and id is not null")
    retained = listed.agg(F.sum(F.size("sketch"))).first()[0] or 0
    common = least_common(percent)
    # what another sketch shares at least: a share of sets that fit in a sketch, unless the other may be larger
    enough = F.ceil(F.col("n") * percent / 100 - F.lit(1e-9))
    enough = F.when(F.col("n") * 100 <= SKETCH * percent, enough).otherwise(F.least(enough, F.lit(common)))
    possible = _shared_values(listed.select("cls", "sketch"), retained, _pack_sketches)
    heads = listed.groupBy("cls").agg(F.min("id").alias("id"), F.min("n").alias("n"))
    heads = heads.join(possible, "cls").where(F.col("shared") >= enough).select("cls", "id")
    heads = small(stored(heads, "heads"))

    # the texts of the classes that are left, one each; a repeated id brings its own text only
    texts = rows.where("id is not null").join(heads, "id").mapInArrow(_own_text(size), "cls long, text string, n long, sketch array<long>")
    texts = stored(texts, "candidates")
    total, values, len_texts = texts.agg(F.sum(F.octet_length("text")), F.sum("n"), F.count("*")).first()
    chunks = (total or 0) // chunk_bytes(total or 0) + 1
    exact = _shared_values(texts.select("cls", "text"), values or 0, _pack_texts(size))
    left = texts.groupBy("cls").agg(F.min("n").alias("n")).join(exact, "cls").where(F.col("shared") * 100 >= F.col("n") * percent)
    left = stored(left.select("cls", "n", "shared"), "bounded")

    sketches = texts.select("cls", "sketch").join(left, "cls").dropDuplicates(["cls"])
    entries = sketches.select("cls", "n", "shared", F.size("sketch").alias("k"), enough.alias("enough"), F.explode("sketch").alias("value"))
    often = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    entries = entries.join(often, "value")
    rank = "row_number() over (partition by cls order by df, value)"
    entries = entries.selectExpr("*", f"{rank} as rank", "count(*) over (partition by cls) as c", "sum(df) over (partition by cls) / k as typical")
    lists = entries.where("c - rank >= enough - 1").select(F.col("value").alias("list"), "cls", "n", "shared", "typical")
    lists = stored(_of_use(stored(lists, "entries"), "cls"), "lists")

    def confirmed(pairs: DataFrame) -> DataFrame:
        found = _compared(stored(_estimated(pairs, texts, percent, common), "pairs"), texts.select("cls", "text"), size, percent, chunks)
        return stored(found.where("linked").select("a", "b"), "links")

    most = F.least("sa", "sb")
    bounded = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (most * 100 >= (F.col("na") + F.col("nb") - most) * percent)
    # of the split that made a list (see _listed)
    reach = F.coalesce((F.col("la") <= F.col("hb")) & (F.col("lb") <= F.col("ha")), F.lit(True))
    one = [F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa")]
    two = [F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb")]

    def met(left: DataFrame, right: DataFrame, once) -> DataFrame:
        """Pairs of members of two sides of lists, in different components and within the bounds."""
        left = left.select("list", *one, F.col("root").alias("ra"), F.col("low").alias("la"), F.col("high").alias("ha"))
        right = right.select("list", *two, F.col("root").alias("rb"), F.col("low").alias("lb"), F.col("high").alias("hb"), *[c for c in ("minor",) if c in right.columns])
        return left.join(right, "list").where((F.col("ra") != F.col("rb")) & once & bounded & reach).select("a", "b", "na", "nb")

    def across(held: DataFrame) -> DataFrame:
        """Pairs of lists' members outside the largest component of their list with all others."""
        return met(held.where("minor"), held, ~F.col("minor") | (F.col("a") < F.col("b")))

    links, pairs, before = None, [], None
    lists = lists.withColumn("low", F.lit(None).cast("long")).withColumn("high", F.lit(None).cast("long"))
    while True:
        star = lists.select("a", "na", "sa", *two).where(F.col("a") != F.col("b")).where(bounded)
        found = confirmed(star.select("a", "b", "na", "nb").distinct())
        links = found if links is None else links.unionByName(found)
        roots = connected_components(links).withColumnRenamed("node", "cls")
        # what is linked so far, as stars, so that rounds do not add to it
        links = roots.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
        held = lists.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        of_centre = F.max(F.when(F.col("cls") == F.col("a"), F.col("root"))).alias("component")
        counted = held.groupBy("list", "root").agg(F.count("*").alias("size"), F.first("a").alias("a"), F.first("order").alias("order"), of_centre)
        largest = F.max(F.struct("size", "root")).alias("largest")
        mixed = counted.groupBy("list").agg(F.count("*").alias("roots"), F.sum("size").alias("size"), largest, F.first("a").alias("a"), F.first("order").alias("order"), F.max("component").alias("component"))
        mixed = mixed.where("roots > 1").select("*", F.col("largest.root").alias("main"), (F.col("size") - F.col("largest.size")).alias("outside")).drop("roots", "largest")
        mixed = stored(mixed, "several")
        # large lists whose centres are in one component are split by the most typical of these, so that a member is compared once for all of them;
        # the first of all members is the hub of every list that holds it and is in no list after that, so that rounds end
        hubs = mixed.where(F.col("outside") > SMALL).groupBy("component").agg(F.min(F.struct("order", "a")).alias("m")).select("component", F.col("m.a").alias("hub"))
        mixed = mixed.select("list", "size", "outside", "main", "component").join(hubs, "component", "left").drop("component")
        held = stored(held.drop("a").join(mixed, "list").withColumn("minor", F.col("root") != F.col("main")), "mixed")
        few, many = held.where(F.col("outside") <= SMALL), held.where(F.col("outside") > SMALL)
        pairs.append(across(few))
        entries = many.count()
        # a split that leaves most of what it was given is not repeated: members that lie equally far from each other are compared in pairs
        if not entries or before is not None and entries * 4 > before * 3:
            pairs.append(across(many))
            break
        before = entries
        members = many.withColumnRenamed("hub", "a").where(F.col("a") != F.col("cls"))
        parts, beside = _split(members, percent, lambda asked: _compared(stored(asked, "pairs"), texts.select("cls", "text"), size, percent, chunks, split=True))
        links = links.unionByName(beside)
        linked, apart, close = parts.where("not apart"), parts.where("apart"), parts.where("apart and short")
        pairs.append(met(apart.where(F.least("loose", "others") <= SMALL), linked.where(F.least("loose", "others") <= SMALL), F.lit(True)))
        pairs.append(met(close.where(F.col("close") <= SMALL), close.where(F.col("close") <= SMALL), F.col("a") < F.col("b")))
        lists = parts.where(F.least("loose", "others") > SMALL).unionByName(close.where(F.col("close") > SMALL).withColumn("list", F.xxhash64("list")))
        lists = stored(_of_use(lists).select("list", "cls", "n", "shared", "typical", "root", "a", "na", "sa", "order", "low", "high"), "lists")
        # where all pairs of all lists are no more than there are classes, they are made at once
        possible = lists.groupBy("list").agg(F.count("*").alias("size")).agg(F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()[0] or 0
        if possible <= len_texts:
            pairs.append(met(lists, lists, F.col("a") < F.col("b")))
            break
        lists = lists.drop("root")
    every = reduce(DataFrame.unionByName, pairs)
    swapped = F.col("a") > F.col("b")
    every = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swapped, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swapped, F.col("na")).otherwise(F.col("nb")).alias("nb"))
    return links.unionByName(confirmed(every.distinct()))


def _split(members: DataFrame, percent: int, compared) -> tuple[DataFrame, DataFrame]:
    """Parts of lists by what their members (``cls``) do not share with the centre ``a``, lists of a centre together; and the links of members with it.

    Of each member of a part: whether it is apart from the centre and serves for pairs with others apart (``short``);
    and how many members of the part are apart (``loose``), linked with the centre (``others``), and both apart and short (``close``).
    """
    told = compared(members.select("a", F.col("cls").alias("b")).distinct())
    told = stored(told.select(F.col("b").alias("cls"), (~F.col("linked")).alias("apart"), "places", "short", "low", "a", "elements"), "differences")
    beside = told.where("not apart").select("a", F.col("cls").alias("b"))
    told = _listed(told, percent).select("cls", "apart", "places", "short", "low", "high", "a", F.explode("elements").alias("element"))
    told = stored(told.withColumn("list", F.xxhash64("a", "element")), "split")
    often = told.groupBy("list").agg(F.count("*").alias("df"), F.count_if("apart").alias("loose")).where("df > 1").select("list", "df", F.col("loose").alias("any"))
    found = told.join(often, "list").selectExpr("*", "row_number() over (partition by a, cls order by df, element) as rank", "count(*) over (partition by a, cls) as c")
    # elements that no other member has come first and are not listed
    alone = told.groupBy("a", "cls").agg(F.count("*").alias("size"))
    found = found.join(alone, ["a", "cls"]).withColumn("place", F.col("size") - F.col("c") + F.col("rank")).where("place <= places and any > 0")
    found = found.select("list", "cls", "apart", (F.col("place") <= F.col("short")).alias("short"), "low", "high")
    sides = found.groupBy("list").agg(F.count_if("apart").alias("loose"), F.count_if(~F.col("apart")).alias("others"), F.count_if(F.col("apart") & F.col("short")).alias("close"))
    used = found.join(sides.where("loose > 0 and (others > 0 or close > 1)"), "list")
    kinds = members.groupBy("cls").agg(*(F.max(c).alias(c) for c in ("n", "shared", "typical", "root")))
    return stored(used.join(kinds, "cls"), "parts"), beside


def _listed(told: DataFrame, percent: int) -> DataFrame:
    """The members that can be listed, with ``high``, and under fewer elements where their possible partners allow it.

    With p = 100 + percent, q = 100 - percent and low(x) = p |D(x)| - q |x|, x and y are linked where low(x) + low(y) <= 2 p |D(x) & D(y)|.
    No common element is one that no other member of the centre has; with shared(x) of x's elements in other members and
    high(x) = 2 p shared(x) - low(x), a link needs low(x) <= high(y) and low(y) <= high(x).  So a member linked with the centre is listed
    only where its high reaches the least low of those that are apart, and one that is apart only where its high reaches the least low of all;
    and common elements needed follow from the least low among partners left.  A member with so many elements of its own that
    too few are left is not listed either.  Elements are counted by the packed exchange, 4 bytes each.
    """
    double = 2 * (100 + percent)
    sets = told.select(F.xxhash64("a", "cls").alias("cls"), F.transform("elements", lambda e: F.xxhash64("a", e)).alias("sketch"))
    met = _shared_values(sets, told.agg(F.sum(F.size("elements"))).first()[0] or 0, _pack_sketches).withColumnRenamed("cls", "key")
    both = told.withColumn("key", F.xxhash64("a", "cls")).join(met, "key").withColumn("high", double * F.col("shared") - F.col("low"))
    both = stored(both.drop("key"), "shared")

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("a").agg(F.min("low").alias("all"), F.min(F.when(F.col("apart"), F.col("low"))).alias("loosest"))

    # without a member apart from the centre there is nothing to list
    both = both.join(least(both), "a").where(F.col("high") >= F.when(F.col("apart"), F.col("all")).otherwise(F.col("loosest"))).drop("all", "loosest")
    both = both.join(least(both), "a")
    left = lambda other: (F.size("elements") - F.greatest(F.lit(1), F.ceil((F.col("low") + F.col(other)) / double - F.lit(1e-9))) + 1).cast("int")
    both = both.withColumn("short", F.least("short", left("loosest"))).withColumn("places", F.least("places", F.when(F.col("apart"), left("all")).otherwise(left("loosest"))))
    return both.where(F.size("elements") - F.col("shared") < F.col("places")).select(*told.columns, "high")


def _of_use(lists: DataFrame, apart: str = "root") -> DataFrame:
    """Lists of several components (``apart``), with their most typical member, the centre; of lists with the same members one is kept."""
    marks = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    centre = F.min(F.struct((-F.col("typical")).alias("order"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))).alias("centre")
    several = lists.groupBy("list").agg(F.min(apart).alias("low"), F.max(apart).alias("high"), F.count("*").alias("size"), centre, *marks).where("low <> high")
    return lists.join(several.groupBy("size", "mark1", "mark2").agg(F.min(F.struct("list", "centre")).alias("m")).select("m.list", "m.centre.*"), "list")


def _own_text(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(batch.schema.get_field_index("cls")).to_pylist()
            for a, b, texts in _opened(batch.column(batch.schema.get_field_index("text"))):
                kept = [(c, t, s) for c, t, s in zip(classes[a:b], texts, shingle_sets([H.utf8(t) for t in texts], size), strict=True) if len(s) and set_class(s) == c]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c for c, _, _ in kept], pa.int64()),
                        pa.array([t for _, t, _ in kept], pa.string()),
                        pa.array([len(s) for _, _, s in kept], pa.int64()),
                        pa.array([_signed(s) for _, _, s in kept], pa.list_(pa.int64())),
                    ],
                    names=["cls", "text", "n", "sketch"],
                )

    return run


def _estimated(pairs: DataFrame, texts: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs whose union sketch allows a link: exactly where the sketches are the sets, else by the binomial bound."""
    one = texts.select(F.col("cls").alias("a"), F.col("sketch").alias("one")).dropDuplicates(["a"])
    two = texts.select(F.col("cls").alias("b"), F.col("sketch").alias("two")).dropDuplicates(["b"])
    joined = pairs.join(one, "a").join(two, "b")
    joined = joined.withColumn("union", F.array_sort(F.array_union("one", "two")))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    common = F.size(F.array_intersect("one", "two"))
    return joined.where(F.when(whole, common * 100 >= F.size("union") * percent).otherwise(_union_overlap() >= least)).select("a", "b")


def _union_overlap():
    """Of the SKETCH smallest values of the union, how many lie in both sketches."""
    return F.size(F.array_intersect(F.array_intersect(F.slice("union", 1, SKETCH), "one"), "two"))
