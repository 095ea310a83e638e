"""Benchmark decontamination by suffix arrays over the training text.

The documents stream by in shards of whole documents. A shard's words become ids of the benchmark's
vocabulary (0: no such word), and its suffixes that begin with a benchmark word are sorted by prefix
doubling. Every benchmark suffix is looked up by binary search; the range of suffixes that share its
first `window` words are its occurrences. The longest verbatim match at each of these places comes from the suffix
array of the benchmark: binary search with hashes of prefixes, so that repetitive texts cost no more than others.
Nothing is shuffled: the benchmark goes to the shards, in blocks of bounded size. Blocks of PASS_BYTES together go to
the tasks at once; a larger benchmark takes several passes, each adding to the findings that the one before has
written with the documents.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, after A-Z are lower-cased.
A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
longest_match is the longest verbatim match that holds a whole window, the first of several in the document, and
longest_at the word where it begins (-1: none).
Nulls: a null text has no words, as an empty one; a null item_id is written "null". Repeated documents are
looked at one by one; repeated items count once by item_id. Empty tables give no rows, or no hits. A document of
any length is a shard of its own at most; a row and an item have to fit a task. Columns besides doc_id and text are
ignored by digest() and kept by clean(), whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import buffers, lower_map, mix, runs, spans
from .common import Scratch, short_batches, slices, texts

WINDOW = 10
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text of one broadcast block, the longest item excepted.
BLOCK_BYTES = 16 << 20
#: Bytes of benchmark text of the blocks that tasks hold at once, one block at least.
PASS_BYTES = 32 << 20
_FILTER_BITS = 20

DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long"


def _word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word."""
    data, off = buffers(column)
    row, start, end = runs(data, off, _word_bytes())
    return row, spans(data, start, end, lower_map())


@dataclass
class Index:
    """A block of the benchmark: its words, its distinct windows, and where these stand."""

    vocabulary: np.ndarray  # sorted hashes; the id of a word is its place, from 1
    text: np.ndarray  # ids of all items, 0 after each
    windows: np.ndarray  # (windows, window) ids, 0 beyond the end of short ones
    lengths: np.ndarray
    item_of: np.ndarray  # windows' items, each once, by window
    items: np.ndarray  # where a window's items begin in item_of
    order: np.ndarray  # the suffix array of text
    names: list[str]


def build_index(items: list[tuple[object, str | None]], window: int = WINDOW) -> Index:
    row, h = _words(pa.array([t or "" for _, t in items], pa.large_string()))
    vocabulary = np.unique(h)
    text = np.zeros(len(h) + len(items) + 1, np.int64)
    at = np.arange(len(h)) + row
    text[at] = np.searchsorted(vocabulary, h) + 1
    n = np.bincount(row, minlength=len(items))
    first = np.cumsum(n + 1) - (n + 1)
    names = ["null" if i is None else str(i) for i, _ in items]
    starts = [np.arange(f, f + max(1, k - window + 1)) for f, k in zip(first, n, strict=True) if k]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    item = np.repeat(np.flatnonzero(n), [max(1, k - window + 1) for k in n[n > 0]])
    length = np.minimum(n, window)[item]
    padded = np.concatenate((text, np.zeros(window, np.int64)))
    body = padded[start[:, None] + np.arange(window)] if len(start) else np.zeros((0, window), np.int64)
    body[np.arange(window) >= length[:, None]] = 0
    kinds, which = np.unique(body, axis=0, return_inverse=True)
    which = which.ravel()
    pairs = np.unique(np.stack((which, item), 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
    order = suffix_array(text, len(vocabulary), len(text))[0]
    return Index(vocabulary, text, kinds, (kinds > 0).sum(1), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(kinds) + 1)), order, names)


def suffix_array(seq: np.ndarray, n_words: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(starts of the suffixes that don't begin with 0 in order of their first `depth` words at least, their first keys, words and bits of a key)."""
    pos = np.flatnonzero(seq)
    pos_bits = max(1, len(seq).bit_length())
    bits = max(1, n_words.bit_length())
    k = max(1, (63 - pos_bits) // bits)
    padded = np.concatenate((seq, np.zeros(k + depth, seq.dtype)))
    key = np.zeros(len(pos), np.uint64)
    for j in range(k):
        key = (key << np.uint64(bits)) | padded[pos + j].astype(np.uint64)
    both = np.sort((key << np.uint64(pos_bits)) | pos.astype(np.uint64))
    key = both >> np.uint64(pos_bits)
    order = (both & np.uint64((1 << pos_bits) - 1)).astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    width = k
    while width < depth and not new.all():
        group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank = np.zeros(len(padded), np.int64)
        rank[order] = group + 1
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        second = rank[np.minimum(order[tied] + width, len(rank) - 1)]
        by = np.lexsort((second, group[tied])) if 3 * pos_bits > 63 else (np.sort((group[tied].astype(np.uint64) << np.uint64(2 * pos_bits)) | (second.astype(np.uint64) << np.uint64(pos_bits)) | np.arange(len(tied), dtype=np.uint64)) & np.uint64((1 << pos_bits) - 1)).astype(np.int64)
        order[tied] = order[tied][by]
        g, s = group[tied], second[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        new[tied] = fresh
        width *= 2
    return order, key, k, bits


def _bound(padded: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, what: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all windows in step: the first suffix that isn't before the window, or with upper that is after it."""
    lo, hi = lo.copy(), hi.copy()
    cols = np.arange(what.shape[1])
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        diff = padded[order[mid][:, None] + cols] - what[live]
        diff[cols >= length[live][:, None]] = 0
        first = (diff != 0).argmax(1)
        sign = np.sign(diff[np.arange(len(live)), first])
        right = sign <= 0 if upper else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
        live = live[lo[live] < hi[live]]
    return lo


class Shard:
    """Words of whole documents as ids of one benchmark block, and what of the block occurs in them."""

    def __init__(self, index: Index, row: np.ndarray, h: np.ndarray, n_docs: int) -> None:
        ids = np.zeros(len(h), np.int64)
        if len(index.vocabulary):
            mask = np.uint64((1 << _FILTER_BITS) - 1)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(index.vocabulary & mask).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(h & mask).astype(np.int64)])
            at = np.searchsorted(index.vocabulary, h[maybe])
            same = index.vocabulary[np.minimum(at, len(index.vocabulary) - 1)] == h[maybe]
            ids[maybe[same]] = at[same] + 1
        self.index, self.n_docs = index, n_docs
        self.n_words = np.bincount(row, minlength=n_docs)
        self.first = np.cumsum(self.n_words + 1) - (self.n_words + 1)
        self.seq = np.zeros(len(h) + n_docs + 1, np.int64)
        self.seq[np.arange(len(h)) + row] = ids

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in the shard) of every occurrence; the covered words."""
        x, window = self.index, self.index.windows.shape[1]
        order, key, k, bits = suffix_array(self.seq, len(x.vocabulary), window)
        padded = np.concatenate((self.seq, np.zeros(window + 1, np.int64)))
        head = np.zeros(len(x.windows), np.uint64)
        tail = np.zeros(len(x.windows), np.uint64)
        for j in range(k):
            word = x.windows[:, j].astype(np.uint64) if j < window else np.zeros(len(x.windows), np.uint64)
            free = j >= x.lengths
            head = (head << np.uint64(bits)) | word
            tail = (tail << np.uint64(bits)) | np.where(free, np.uint64((1 << bits) - 1), word)
        lo, hi = np.searchsorted(key, head, "left"), np.searchsorted(key, tail, "right")
        near = np.flatnonzero(lo < hi)
        if len(near):
            low = _bound(padded, order, lo[near], hi[near], x.windows[near], x.lengths[near], False)
            high = _bound(padded, order, low, hi[near], x.windows[near], x.lengths[near], True)
            n = high - low
        else:
            low = n = np.zeros(0, np.int64)
        which = np.repeat(near, n)
        at = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        cover = np.zeros(len(self.seq) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + x.lengths[which], -1)
        return which, at, np.cumsum(cover[:-1]) > 0

    def longest(self, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the longest verbatim match that holds a window, and the word where it begins (-1: none)."""
        x, window = self.index, self.index.windows.shape[1]
        here = np.unique(at)
        length = np.zeros(len(here), np.int64)
        np.maximum.at(length, np.searchsorted(here, at), x.lengths[which])
        mine, theirs = _prefix_hashes(self.seq, 1), _prefix_hashes(x.text, 2)  # the ends of documents and of items differ
        lo, hi = np.zeros(len(here), np.int64), np.full(len(here), len(x.order))
        live = np.arange(len(here)) if len(x.order) else np.zeros(0, np.int64)
        while len(live):  # of the suffixes that share most with a place, the search for it meets one at least
            mid = (lo[live] + hi[live]) // 2
            there = x.order[mid]
            same = _common(mine, theirs, here[live], there)
            length[live] = np.maximum(length[live], np.where(same >= window, same, 0))
            right = x.text[there + same] < self.seq[here[live] + same]
            lo[live[right]], hi[live[~right]] = mid[right] + 1, mid[~right]
            live = live[lo[live] < hi[live]]
        doc = np.searchsorted(self.first, here, "right") - 1
        best, where = np.zeros(self.n_docs, np.int64), np.full(self.n_docs, -1, np.int64)
        rank = np.lexsort((-here, length))
        best[doc[rank]], where[doc[rank]] = length[rank], (here - self.first[doc])[rank]
        return best, where


_BASE = 0x9E3779B97F4A7C15


def _prefix_hashes(seq: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes, and the powers; end takes the place of 0."""
    power = np.full(len(seq) + 1, np.uint64(_BASE), np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(len(seq) + 1, np.uint64)
    np.cumsum(mix(np.where(seq == 0, -end, seq).astype(np.uint64)) * power[:-1], out=total[1:])
    return total, power


def _common(mine: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray], here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Words that the places have in common, by halves. Both texts end in 0, so no match goes to an end."""
    out = np.zeros(len(here), np.int64)
    power = mine[1] if len(mine[1]) > len(theirs[1]) else theirs[1]
    step = 1 << max(1, min(len(mine[0]), len(theirs[0]))).bit_length()
    while step:
        a, b = here + out + step, there + out + step
        ok = np.flatnonzero((a < len(mine[0])) & (b < len(theirs[0])))
        i, j = here[ok], there[ok]
        x, y = mine[0][a[ok]] - mine[0][i], theirs[0][b[ok]] - theirs[0][j]
        low = np.minimum(i, j)
        out[ok[x * power[j - low] == y * power[i - low]]] += step
        step >>= 1
    return out


#: What one pass leaves to the next, in the last columns: covered words as starts and ends in turn, items, longest match.
STATE = "`_covered so far` array<long>, `_items so far` array<string>, `_longest so far` long, `_longest at` long"


def _scan(blocks: list, batches: Iterator[pa.RecordBatch], shard_words: int, later: bool) -> Iterator[tuple[pa.Table, dict[str, np.ndarray | list]]]:
    """The rows of each shard, with the findings for each row over all blocks; later: rows end in the columns of STATE."""
    held: list[pa.RecordBatch] = []
    rows: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    n_rows = n_words = 0

    def found() -> tuple[pa.Table, dict[str, np.ndarray | list]]:
        nonlocal n_rows, n_words
        row, h = np.concatenate(rows), np.concatenate(hashes)
        got = pa.Table.from_batches(held)
        names: list[set[str]] = [set() for _ in range(n_rows)]
        out = {"longest_match": np.zeros(n_rows, np.int64), "longest_at": np.full(n_rows, -1, np.int64)}
        n = np.bincount(row, minlength=n_rows)
        first = np.cumsum(n + 1) - (n + 1)
        covered = np.zeros(len(h) + n_rows + 1, bool)
        if later:
            spans_, items_, longest_, at_ = (got.column(got.num_columns + k).to_pylist() for k in range(-4, 0))
            got = got.select(range(got.num_columns - 4))
            names = [set(i) for i in items_]
            out = {"longest_match": np.array(longest_, np.int64), "longest_at": np.array(at_, np.int64)}
            for f, span in zip(first, spans_, strict=True):
                for s, e in zip(span[::2], span[1::2], strict=True):
                    covered[f + s : f + e] = True
        for b in blocks:
            index = b.value if hasattr(b, "value") else b
            s = Shard(index, row, h, n_rows)
            which, at, cover = s.matches()
            covered |= cover
            if len(which):
                doc = np.searchsorted(first, at, "right") - 1
                pair = np.unique(np.stack((doc, which), 1), axis=0)
                k = index.items[pair[:, 1] + 1] - index.items[pair[:, 1]]
                item = index.item_of[np.repeat(index.items[pair[:, 1]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                for d, i in np.unique(np.stack((np.repeat(pair[:, 0], k), item), 1), axis=0).tolist():
                    names[d].add(index.names[i])
                best, where = s.longest(which, at)
                more = best > out["longest_match"]
                out["longest_match"][more], out["longest_at"][more] = best[more], where[more]
        sums = np.concatenate(([0], np.cumsum(covered)))
        out |= {"n_words": n, "n_hit": sums[first + n] - sums[first], "items": names, "covered": covered, "first": first}
        for x in (held, rows, hashes):
            x.clear()
        n_rows = n_words = 0
        return got, out

    for b in batches:
        for part in slices(b, b.schema.get_field_index("text")):
            row, h = _words(part.column(part.schema.get_field_index("text")).cast(pa.large_string()).fill_null(""))
            held.append(part)
            rows.append(row + n_rows)
            hashes.append(h)
            n_rows, n_words = n_rows + part.num_rows, n_words + len(h)
            if n_words >= shard_words:
                yield found()
    if n_rows:
        yield found()


def _passes(spark: SparkSession, benchmark: DataFrame, window: int, block_bytes: int, pass_bytes: int) -> list[Callable[[], list]]:
    """Makers of the blocks of each pass, as broadcasts; the driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1

    def block(k: int) -> object:
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        return spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in part.collect()], window))

    each = max(1, pass_bytes // block_bytes)
    return [lambda at=at: [block(k) for k in range(at, min(n, at + each))] for at in range(0, n, each)]


def _kept(x: dict) -> list[pa.Array]:
    """The columns of STATE."""
    spans_ = []
    for f, n in zip(x["first"].tolist(), x["n_words"].tolist(), strict=True):
        c = np.concatenate(([False], x["covered"][f : f + n], [False]))
        spans_.append(np.flatnonzero(c[1:] != c[:-1]).tolist())
    return [pa.array(spans_, pa.list_(pa.int64())), pa.array([sorted(i) for i in x["items"]], pa.list_(pa.string())), pa.array(x["longest_match"]), pa.array(x["longest_at"])]


def _through(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, block_bytes: int, pass_bytes: int, give: Callable, schema: str) -> DataFrame:
    """give(rows, findings) of each shard, after all passes."""
    short_batches(spark)
    passes = _passes(spark, benchmark, window, block_bytes, pass_bytes)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    rows, scratch, blocks = docs, None, passes[0]()
    for k, more in enumerate(passes[1:]):
        scratch = scratch or Scratch(spark, "decontamination")

        def add(batches: Iterator[pa.RecordBatch], blocks: list = blocks, later: bool = k > 0) -> Iterator[pa.RecordBatch]:
            for got, x in _scan(blocks, batches, shard_words, later):
                table = pa.table([*got.columns, *_kept(x)], names=[*got.column_names, *"abcd"])
                yield from table.combine_chunks().to_batches()

        before, rows = rows, scratch.write(rows.mapInArrow(add, f"{fields}, {STATE}"), "pass")
        scratch.drop(before)
        for b in blocks:
            b.destroy()
        blocks = more()

    def run(batches: Iterator[pa.RecordBatch], later: bool = len(passes) > 1) -> Iterator[pa.RecordBatch]:
        for got, x in _scan(blocks, batches, shard_words, later):
            yield from give(got, x)

    return rows.mapInArrow(run, schema)


def digest(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row for each document: what of the benchmark is in it, and its longest verbatim match."""

    def give(rows: pa.Table, x: dict) -> Iterator[pa.RecordBatch]:
        sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in x["items"]]
        columns = [rows["doc_id"].combine_chunks(), pa.array(x["n_words"]), pa.array(x["n_hit"]), pa.array([len(i) for i in x["items"]], pa.int64()), pa.array(sha), pa.array(x["n_hit"] > 0), pa.array(x["longest_match"]), pa.array(x["longest_at"])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DIGEST.split(", ")])

    return _through(spark, texts(docs), benchmark, window, shard_words, block_bytes, pass_bytes, give, DIGEST)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns."""

    def give(rows: pa.Table, x: dict) -> Iterator[pa.RecordBatch]:
        yield from rows.filter(pa.array(x["n_hit"] == 0)).to_batches()

    return _through(spark, docs, benchmark, window, shard_words, block_bytes, pass_bytes, give, docs.schema)
