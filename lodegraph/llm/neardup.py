"""Near-duplicate groups by a signature-coordinate inverted join.

Every document's set of word shingles gets a MinHash signature. Documents of equal sets become one class.
Each class is posted under the coordinate-value pairs of its signature. Within a list the collisions of two
signatures are counted on one byte a coordinate, and pairs with fewer than MATCHES fall away:

* Lists of up to LIST postings are short. Each is one task's, which compares all its pairs; a pair that REPORTS
  earlier short lists of both have reported is skipped.
* A pair that no short list shows has all its MATCHES collisions in long lists. So a class that has fewer long
  lists than that is done; any other is posted in its rarest ones only, all but MATCHES - 1: two such classes
  share one of these (prefix filter). Text that many documents share makes long lists, but few documents
  have MATCHES of them. Such a list, sorted by the following coordinates, lies in ranges of any number; each
  posting first reports its best neighbours, which connects groups of near copies without all their pairs.
  Once these links are confirmed and joined, all pairs of the list that still lie between two components are
  compared in blocks of bounded size, by sketches and then on the full sets, within the block's task: what
  leaves it are the links that join components, not the pairs.

Pairs of short lists and neighbours fall away if their wider sketches agree too seldom; the others are confirmed
on the full sets, first the best ones of each document and then all those that still lie between two components.
Links join into components. Work within a long list is the square of the postings that lie outside of its
largest component, and these by that component; every comparison is a few vector operations in a task.

Nulls: a null text is empty; an empty set is linked with nothing. Documents that share a doc_id are one
node; a null doc_id is a node too, below all others. Each row keeps its place in the result; an empty table gives no
rows. Of a component the least doc_id stays, of its rows the one of the least text hash. Texts go in parts of bounded
bytes, so memory follows the longest one. Columns besides doc_id and text are ignored by near_duplicates() and kept
by one_of_each(), whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import buffers, lower_map, mix, words
from .common import Scratch, few_tasks, short_batches, shuffle_parts, side, slices, texts
from .graph import components

COORDINATES = 32
#: Collisions that a pair must have; at a similarity of 0.8 fewer occur once in some million pairs.
MATCHES = 14
#: Coordinates of the sketch that pairs are looked at with before their texts are, one byte each, and how many must agree.
SKETCH, SKETCH_MATCHES = 128, 78
LIST = 64
#: Postings before each that a long list compares it with at first, and how many of them it reports.
WINDOW, NEIGHBOURS = 256, 2
#: Postings of one block of a long list, about.
BLOCK = 1024
#: Lists that may report the same pair: a few of them could agree on their bytes by chance.
REPORTS = 4
SHINGLE = 4
SIMILARITY = 80  # percent
NO_ID = -(1 << 63)

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64)
_C = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SET = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>, small binary, wide binary"


def _is_word() -> np.ndarray:
    out = np.ones(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = False
    return out


def sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = buffers(column)
    row, _, _, h = words(data, off, _is_word(), lower_map())
    n = np.bincount(row, minlength=len(column))
    first = np.cumsum(n) - n
    made = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
    for j in range(shingle):
        made += h[j : j + len(made)] * _C[j]
    made = mix(made)
    out = []
    for f, k in zip(first.tolist(), n.tolist(), strict=True):
        if k >= shingle:
            out.append(np.unique(made[f : f + k - shingle + 1]))
        elif k:
            out.append(mix((h[f : f + k] * _C[:k]).sum(keepdims=True) + _C[32 + k % 32] * np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The first COORDINATES are posted, all make the sketch."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1 << 11):
        np.minimum(low, (_A[:, None] * s[None, at : at + (1 << 11)] + _B[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 1):
            made = sets(part.column(1), shingle)
            sig = np.zeros((len(made), SKETCH), np.uint32)
            key = np.zeros((2, len(made)), np.uint64)
            for i, s in enumerate(made):
                if len(s):
                    sig[i] = signature(s)
                    key[0, i], key[1, i] = mix(s ^ _C[40]).sum(), mix(s + _C[41]).sum()
            arrays = [part.column(0), pa.array([len(s) for s in made], pa.int64()), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64))]
            values = pa.array(np.ascontiguousarray(sig[:, :COORDINATES]).view(np.int32).ravel())
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) * COORDINATES + 1, COORDINATES), pa.int32()), values))
            wide = [r.tobytes() for r in (sig & 0xFF).astype(np.uint8)]
            arrays += [pa.array([r[:COORDINATES] for r in wide], pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SET.split(", ")])


def _bits(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(COORDINATES)) & 1).astype(bool)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(key, id, n, small, mask) of postings."""
    small = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COORDINATES)
    return (*(batch.column(i).to_numpy().copy() for i in range(3)), small, batch.column(4).to_numpy().copy())


def _record(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    rows = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["a", "b"])


def _near(rows: tuple[np.ndarray, ...], i: np.ndarray, d: int, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the postings i and those d before them, in the same list: (i, i - d, agreement by coordinate) with enough collisions."""
    key, ident, n, small, _ = rows
    i = i[key[i] == key[i - d]]
    j = i - d
    ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (ident[i] != ident[j])
    i, j = i[ok], j[ok]
    same = small[i] == small[j]
    ok = same.sum(1) >= matches
    return i[ok], j[ok], same[ok]


def _whole(percent: int, matches: int) -> object:
    """All pairs of the lists, which are short and come sorted by key. A pair that earlier short lists (mask) have reported is skipped."""

    def found(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, ident, _, _, mask = rows
        a, b = [ident[:0]], [ident[:0]]
        for d in range(1, len(key)):
            here = np.arange(d, len(key))
            if not (key[here] == key[here - d]).any():
                break
            i, j, same = _near(rows, here, d, percent, matches)
            ok = (same & _bits(mask[i] & mask[j]) & (np.arange(COORDINATES) < (key[i] >> 32)[:, None])).sum(1) < REPORTS
            a.append(ident[i[ok]])
            b.append(ident[j[ok]])
        return _record(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if b.num_rows:
                held.append(_columns(b))
                if sum(len(x[0]) for x in held) >= 1 << 15:
                    rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    at = int(np.searchsorted(rows[0], rows[0][-1]))  # the last list may go on
                    yield found(tuple(x[:at] for x in rows))
                    held = [tuple(x[at:] for x in rows)]
        if held:
            yield found(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _neighbours(percent: int, matches: int, window: int) -> object:
    """The best pairs of each posting with the `window` before it in its list. Lists of any length come sorted by key and following coordinates."""

    def found(rows: tuple[np.ndarray, ...], from_: int) -> pa.RecordBatch:
        key, ident = rows[:2]
        best = np.full((NEIGHBOURS, len(key)), -1, np.int64)  # hits << 32 | partner, the best first
        for d in range(1, window):
            here = np.arange(max(d, from_), len(key))
            if not (key[here] == key[here - d]).any():
                break
            i, j, same = _near(rows, here, d, percent, matches)
            now = (same.sum(1) << 32) | j
            for k in range(NEIGHBOURS):
                had = best[k, i]
                best[k, i], now = np.maximum(had, now), np.minimum(had, now)
        i = np.concatenate([np.flatnonzero(row >= 0) for row in best])
        j = np.concatenate([row[row >= 0] & 0xFFFFFFFF for row in best])
        return _record(ident[i], ident[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        done = 0  # rows at the front that have been compared
        for b in batches:
            if b.num_rows:
                held.append(_columns(b))
                if sum(len(x[0]) for x in held) - done >= 1 << 15:
                    rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    yield found(rows, done)
                    held = [tuple(x[1 - window :] for x in rows)]
                    done = len(held[0][0])
        if held:
            yield found(tuple(np.concatenate(x) for x in zip(*held, strict=True)), done)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, lo, hi), which come sorted."""
    held: list[pa.RecordBatch] = []
    of = None
    for b in batches:
        if not b.num_rows:
            continue
        key, lo, hi = (b.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        for f, e in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            now = (key[f], lo[f], hi[f])
            if of is not None and now != of:
                yield pa.Table.from_batches(held)
                held = []
            of = now
            held.append(b.slice(f, e - f))
    if held:
        yield pa.Table.from_batches(held)


def _across(percent: int, matches: int) -> object:
    """What is left to compare of each group (key, lo, hi): its documents that may be linked across components, each once, with their partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            key, lo, hi = (g.column(i)[0].as_py() for i in range(3))
            block, rep, root, n, mask = (g.column(i).to_numpy() for i in (3, 4, 5, 6, 9))
            small, wide = (np.frombuffer(b"".join(g.column(i).to_pylist()), np.uint8).reshape(len(rep), -1) for i in (7, 8))
            x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            if not len(x) or not len(y):
                continue
            hits = np.zeros((len(x), len(y)), np.uint8)
            for p, q in zip(small[x].T, small[y].T, strict=True):
                hits += p[:, None] == q[None, :]
            i, j = np.nonzero(hits >= matches)
            i, j = x[i], y[j]
            ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if lo == hi:
                ok &= i < j
            i, j = i[ok], j[ok]
            most = np.zeros(len(i), np.int64)
            for at in range(0, len(i), 1 << 16):  # agreement of the sketches, -1: in earlier lists
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                before = (small[p] == small[q])[:, : key >> 32] & _bits(mask[p] & mask[q])[:, : key >> 32]
                most[at : at + (1 << 16)] = np.where(before.sum(1) < REPORTS, (wide[p] == wide[q]).sum(1), -1)
            ok = most >= SKETCH_MATCHES
            order = np.lexsort((-most[ok], i[ok]))
            i, j = i[ok][order], j[ok][order]
            docs = np.unique(np.concatenate((i, j)))
            if len(docs):
                size = np.bincount(np.searchsorted(docs, i), minlength=len(docs))
                partners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(rep[j]))
                same = [pa.array(np.full(len(docs), v), t) for v, t in ((key, pa.int64()), (lo, pa.int32()), (hi, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(rep[docs]), pa.array(root[docs]), partners], names=["key", "lo", "hi", "rep", "root", "partners"])

    return run


def _shingled(shingle: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets(part.column(1), shingle)], pa.binary())], names=["rep", "shingles"])

    return run


def _links(percent: int) -> object:
    """The links among the partners of each group, on full sets; none between documents that the group's links join already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            rep, root, partners = (g.column(i).to_pylist() for i in (3, 4, 5))
            of: dict[int, list[np.ndarray]] = {}
            for r, s in zip(rep, g.column(6).to_pylist(), strict=True):
                of.setdefault(r, []).append(np.frombuffer(s, np.uint64))
            join = dict(zip(rep, root, strict=True))  # to the root, and from root to root
            for r in root:
                join.setdefault(r, r)

            def top(r: int) -> int:
                while join[r] != r:
                    join[r] = join[join[r]]
                    r = join[r]
                return r

            a, b = [], []
            for r, others in {r: p for r, p in zip(rep, partners, strict=True) if p}.items():
                for o in others:
                    if top(r) != top(o) and any(_alike(x, y, percent) for x in of[r] for y in of[o]):
                        join[top(r)] = top(o)
                        a.append(r)
                        b.append(o)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _blocks(hot: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings of long lists that hold more than one component, once for each group of two blocks to compare.

    A list's largest component has blocks of its own, which are compared with the others' blocks only.
    """
    at = hot.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    size = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n_root"))
    lists = size.groupBy("key").agg(F.max_by("root", F.struct("n_root", "root")).alias("main"), F.max("n_root").alias("n_main"), F.sum("n_root").alias("n_all")).where("n_all > n_main")
    lists = lists.select(F.col("key").alias("list"), "main", F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"))
    block = F.expr("cast(if(root = main, others + pmod(xxhash64(rep), mains), pmod(xxhash64(rep), others)) as int)")
    placed = at.join(lists, F.col("key") == F.col("list")).withColumn("block", block)
    to = F.explode(F.expr("sequence(0, if(root = main, others, others + mains) - 1)"))
    placed = placed.select("key", "block", "rep", "root", "n", "small", "wide", "mask", to.alias("other"))
    return placed.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "root", "n", "small", "wide", "mask")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, sketch of a, sketch of b) that agree in enough coordinates, and in how many."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
        hits = (x == y).sum(1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits.astype(np.int32))], names=["a", "b", "hits"]).filter(pa.array(hits >= SKETCH_MATCHES))


def _confirm(percent: int, shingle: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                keep = []
                for x, y in zip(sets(part.column(2), shingle), sets(part.column(3), shingle), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bits of the filter that spares the shuffle most texts that no pair needs; its size doesn't depend on the input.
FILTER_BITS = 1 << 24
_BITMAP = 32768  # bits of one value of bitmap_construct_agg


def _marked(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among the needed ones: all of these and few others, as long as the filter isn't full."""
    h = F.expr(f"pmod(xxhash64(doc_id), {FILTER_BITS})")
    bits = needed.select(h.alias("h")).groupBy((F.col("h") / _BITMAP).cast("long").alias("word")).agg(F.bitmap_construct_agg((F.col("h") % _BITMAP)).alias("bits"))
    at = rows.withColumn("_h", h).withColumn("_word", (F.col("_h") / _BITMAP).cast("long"))
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((_h % {_BITMAP}) div 8 as int) + 1, 1)")), 16, 10).cast("long")
    found = at.join(F.broadcast(bits), at["_word"] == bits["word"]).where(byte.bitwiseAND(F.expr("shiftleft(1L, cast(_h % 8 as int))")) != 0)
    return found.select(*rows.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY, matches: int = MATCHES, list_size: int = LIST) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id of its group), kept."""
    short_batches(spark)
    scratch = Scratch(spark, "neardup")
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")

    made = scratch.write(rows.mapInArrow(lambda batches: _sets(batches, shingle), SET), "sets")
    full = made.where("n_shingles > 0")
    classes = scratch.write(few_tasks(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("small").alias("small"), F.first("wide").alias("wide"))), "classes")

    key = (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key")
    bit = F.expr("shiftleft(1L, at)")
    listed = classes.select("rep", F.posexplode("signature").alias("at", "value")).select(key, "rep", "at")
    heavy = scratch.write(few_tasks(listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > list_size)), "heavy")
    held = listed.join(side(heavy, heavy.count()), "key").groupBy("rep").agg(F.bit_or(bit).alias("long"), F.sort_array(F.collect_list(F.struct("size", "key", "at"))).alias("lists"))  # 32 lists at most
    held = scratch.write(few_tasks(held), "held")
    posted = classes.join(side(held.select("rep", "long")), "rep", "left").select("rep", F.col("n_shingles").alias("n"), "small", F.bitwise_not(F.coalesce("long", F.lit(0).cast("long"))).alias("mask"), F.posexplode("signature").alias("at", "value"))
    posted = posted.where(F.col("mask").bitwiseAND(bit) != 0).select(key, "rep", "n", "small", "mask")
    posted = posted.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "rep")
    first = held.where(F.size("lists") >= matches).select("rep", F.expr(f"slice(lists, 1, size(lists) - {matches - 1})").alias("lists"))
    first = first.select("rep", F.expr("aggregate(lists, 0L, (m, x) -> m | shiftleft(1L, x.at))").alias("mask"), F.explode("lists").alias("of"))
    hot = first.join(side(classes.select("rep", F.col("n_shingles").alias("n"), "small", "wide")), "rep").select(F.col("of.key").alias("key"), "rep", "n", "small", "wide", "mask", F.expr("substring(concat(small, small), of.at + 2, 8)").alias("sub"))
    hot = scratch.write(few_tasks(hot), "hot")
    ranged = hot.repartitionByRange(shuffle_parts(spark), "key", "sub").sortWithinPartitions("key", "sub", "rep")
    met = posted.mapInArrow(_whole(percent, matches), "a long, b long").union(ranged.select("key", "rep", "n", "small", "mask").mapInArrow(_neighbours(percent, matches, WINDOW), "a long, b long")).distinct()
    sketch = lambda x: side(classes.select(F.col("rep").alias(x), F.col("wide").alias(f"wide_{x}")))

    def sketched(some: DataFrame) -> DataFrame:
        return scratch.write(some.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "wide_a", "wide_b").mapInArrow(_sketched, "a long, b long, hits int"), "pairs")

    def linked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
        """The edges and the links among the pairs, without those inside a component."""
        needed = scratch.write(few_tasks(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "needed")
        held = _marked(rows, needed)
        if needed.count() > FILTER_BITS // 2:  # the filter lets too many texts through
            held = held.join(side(needed), "doc_id", "left_semi")
        held = scratch.write(held, "texts")
        left, right = (side(held.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))) for x in "ab")

        def confirmed(some: DataFrame) -> DataFrame:
            sides = some.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
            return sides.mapInArrow(_confirm(percent, shingle), "a long, b long").distinct()

        ends = pairs.select("a", "b", "hits", F.explode(F.array("a", "b")).alias("end"))
        best = ends.withColumn("rank", F.row_number().over(Window.partitionBy("end").orderBy(F.desc("hits"), "a", "b"))).where("rank <= 2")
        known = components(confirmed(best.select("a", "b").distinct()).union(edges), scratch)
        of = lambda x: known.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
        rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        more = scratch.write(few_tasks(confirmed(rest)), "rest")
        scratch.drop(held)
        return known.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)

    typed = scratch.write(few_tasks(full.select("doc_id", "n_shingles", "set_a", "set_b").join(side(classes.select("set_a", "set_b", "n_shingles", "rep")), ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "rep")), "members")
    shared = typed.select("doc_id", "rep").distinct()
    shared = shared.join(side(shared.groupBy("doc_id").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")), "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    edges = linked(sketched(met), shared)
    roots = components(edges, scratch)
    # what long lists hold across components: sketches first, then full sets, each document's once a group
    split = _blocks(hot, roots).repartition(shuffle_parts(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    near = scratch.write(split.mapInArrow(_across(percent, matches), "key long, lo int, hi int, rep long, root long, partners array<long>"), "across")
    needed = scratch.write(few_tasks(near.select(F.col("rep").alias("doc_id")).distinct()), "needed")
    shingled = _marked(rows, needed).mapInArrow(_shingled(shingle), "rep long, shingles binary")
    sides = near.join(side(shingled), "rep").select("key", "lo", "hi", "rep", "root", "partners", "shingles").repartition(shuffle_parts(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = sides.mapInArrow(_links(percent), "a long, b long")
    roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more), scratch)
    roots = roots.select(F.col("id").alias("rep"), "root")
    scratch.keep(made._scratch_path, typed._scratch_path, [p for p in scratch.paths if "/edges-" in p][-1])  # all that the result is read from
    grouped = typed.join(roots, "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    empty = made.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return grouped.union(empty).select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The documents of which one stays for each group, with all their columns; of rows that share a doc_id one stays."""
    kept = near_duplicates(spark, docs, shingle, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept_id")), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return stay.select(F.struct(*[stay[c] for c in stay.columns]).alias("_row"), F.row_number().over(first).alias("_n")).where("_n = 1").select("_row.*")
