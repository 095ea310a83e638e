"""Re-Pair grammar compression of token ids, in rounds, and the file format of op 3.

A shard holds the ids of consecutive whole documents. Each round counts the adjacent id pairs of the shard,
takes the frequent ones as new nonterminals and replaces their occurrences; where two occurrences overlap
the more frequent pair wins, and in a run of one pair every second occurrence. Rounds repeat until no pair
is frequent, or until symbols fill 16 bits: a rule takes 8 bytes and each of its occurrences saves 2, so rarer pairs
don't pay. A shard stores its rules (two symbols each), the rounds' ends, the expansion length of every
rule and the final sequence, so any range of ids can be expanded without the rest.

Nulls: a null text is an empty one (its ids are the end id alone); rows with a null doc_id come first.
Repeated rows stay, in the order of doc_id and then of the text's hash. An empty table gives no rows. A shard ends with a
whole document, so memory follows the longest one. Columns besides doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, short_batches, shuffle_parts, texts
from .tokens import encoder

#: Ids of one shard, at least; the last document may go beyond.
SHARD_TOKENS = 1 << 19
#: A pair is frequent that occurs so often in its shard.
MIN_COUNT = 8
_HASH_BITS = 16

SHARD = "part int, shard int, before long, n_tokens long, base int, doc_ids binary, doc_null binary, doc_tokens binary, rules binary, round_ends binary, exp_lengths binary, sequence binary"


@dataclass
class Grammar:
    base: int  # terminals are below
    rules: np.ndarray  # (rules, 2)
    round_ends: np.ndarray  # rules made by the end of each round
    exp_lengths: np.ndarray
    sequence: np.ndarray


def _frequent(seq: np.ndarray, pos: np.ndarray, min_count: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (a << 32 | b) of the frequent pairs among those at pos, the most frequent first; their places and ranks."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    a, b = seq[pos], seq[pos + 1]
    h = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - _HASH_BITS)
    maybe = np.bincount(h, minlength=1 << _HASH_BITS)[h] >= min_count
    pos = pos[maybe]
    if not len(pos):
        return none
    key = (a[maybe].astype(np.uint64) << np.uint64(32)) | b[maybe]
    order = np.argsort(key)
    kinds = key[order]
    first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    kinds, count = kinds[first], np.diff(np.append(first, len(key)))
    best = np.lexsort((kinds, -count))[:most]
    best = best[count[best] >= min_count]
    if not len(best):
        return none
    place = np.full(len(kinds), -1, np.int32)
    place[best] = np.arange(len(best), dtype=np.int32)
    rank = np.empty(len(key), np.int32)
    rank[order] = np.repeat(place, count)
    return kinds[best], pos[rank >= 0], rank[rank >= 0]


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT, max_rules: int | None = None) -> Grammar:
    """Rules and sequence; 16-bit symbols are enough for the public vocabularies with the default number of rules.

    After the first round only pairs with a new symbol, and those that were frequent before and lost a place
    to another pair, can be frequent: the counts of all others have only fallen.
    """
    max_rules = max(0, (1 << 16) - base) if max_rules is None else max_rules
    none = np.iinfo(np.int32).max
    seq, rules, ends = ids.astype(np.uint32), [], []
    pos = np.arange(len(seq) - 1) if len(seq) > 1 else np.zeros(0, np.int64)
    made = 0
    while len(pos) and made < max_rules:
        kinds, at, own = _frequent(seq, pos, min_count, max_rules - made)
        if not len(kinds):
            break
        rank = np.full(len(seq) + 1, none, np.int32)  # of the pair at each place; the last entry also stands before the first
        rank[at] = own
        win = (own <= rank[at + 1]) & (own <= rank[at - 1])  # no overlapping occurrence ranks before it
        at, own = at[win], own[win]
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) != 1
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - run) % 2 == 0
        at, own = at[even], own[even]
        used, which = np.unique(own, return_inverse=True)
        keys = kinds[used]
        rules.append(np.stack(((keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)), 1))
        seq[at] = (base + made + which).astype(np.uint32)
        rank[at] = none
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        again = rank[:-1][keep] != none
        new = at - np.arange(len(at))
        again[new] = True
        again[new[new > 0] - 1] = True
        pos = np.flatnonzero(again[:-1])
        made += len(used)
        ends.append(made)
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    lengths = np.zeros(made, np.uint32)
    lo = 0
    for hi in ends:
        lengths[lo:hi] = _sizes(all_rules[lo:hi, 0], base, lengths) + _sizes(all_rules[lo:hi, 1], base, lengths)
        lo = hi
    return Grammar(base, all_rules, np.array(ends, np.int32), lengths, seq)


def _sizes(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.uint32)
    deep = symbols >= base
    out[deep] = lengths[symbols[deep].astype(np.int64) - base]
    return out


def _expand(g: Grammar, seq: np.ndarray) -> np.ndarray:
    """The last round's nonterminals first: their rules hold symbols of earlier rounds only."""
    for k in range(len(g.round_ends) - 1, -1, -1):
        lo = g.base + (int(g.round_ends[k - 1]) if k else 0)
        deep = np.flatnonzero(seq >= lo)
        if not len(deep):
            continue
        rule = seq[deep].astype(np.int64) - g.base
        grown = np.ones(len(seq), np.int64)
        grown[deep] = 2
        out = np.repeat(seq, grown)
        at = deep + np.arange(len(deep))
        out[at], out[at + 1] = g.rules[rule, 0], g.rules[rule, 1]
        seq = out
    return seq


def decode(g: Grammar) -> np.ndarray:
    return _expand(g, g.sequence)


def decode_range(g: Grammar, start: int, end: int) -> np.ndarray:
    """The ids from start to end (exclusive): expands no symbol outside."""
    if end <= start:
        return np.zeros(0, np.uint32)
    edges = np.concatenate(([0], np.cumsum(_sizes(g.sequence, g.base, g.exp_lengths).astype(np.int64))))
    lo = int(np.searchsorted(edges, start, "right")) - 1
    hi = int(np.searchsorted(edges, end, "left"))
    return _expand(g, g.sequence[lo:hi])[start - edges[lo] : end - edges[lo]]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document."""
    sizes = sizes + 1
    last = np.cumsum(sizes) - 1
    out = np.empty(len(ids) + len(sizes), np.uint32)
    mask = np.ones(len(out), bool)
    mask[last] = False
    out[mask], out[last] = ids, end_id
    return out, sizes


def _narrow(a: np.ndarray) -> bytes:
    """16 bits a symbol where they do, else 32; the first byte tells the width."""
    wide = len(a) and int(a.max()) >= 1 << 16
    return (b"\x04" if wide else b"\x02") + a.astype("<u4" if wide else "<u2").tobytes()


def _widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4" if b[0] == 4 else "<u2", offset=1).astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, scratch: Scratch, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Ranges of doc_id, each tokenised and compressed shard by shard as its rows stream by; written to the shared folder."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        base = enc.tokenizer.get_vocab_size(with_added_tokens=True)
        base = max(base, end_id + 1)
        part = TaskContext.get().partitionId()
        shard = before = held = 0
        ids, sizes, keys, nulls = [], [], [], []

        def row() -> pa.RecordBatch:
            nonlocal shard, before, held
            flat, n = np.concatenate(ids), np.concatenate(sizes)
            g = compress(flat, base)
            out = [part, shard, before, len(flat), base, np.concatenate(keys).astype("<i8").tobytes(), np.concatenate(nulls).astype(np.uint8).tobytes(), n.astype("<i8").tobytes(), _narrow(g.rules.ravel()), g.round_ends.astype("<i4").tobytes(), g.exp_lengths.astype("<u4").tobytes(), _narrow(g.sequence)]
            shard, before, held = shard + 1, before + len(flat), 0
            for x in (ids, sizes, keys, nulls):
                x.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            got, n = with_end(*enc.encode(b.column(1)), end_id)
            key = b.column(0)
            null = key.is_null().to_numpy(zero_copy_only=False)
            key = key.fill_null(0).to_numpy(zero_copy_only=False)
            at = doc = 0
            sums = np.cumsum(n)
            while doc < len(n):  # up to the document that fills the shard
                to = min(len(n), int(np.searchsorted(sums, at + shard_tokens - held, "left")) + 1)
                end = int(sums[to - 1])
                ids.append(got[at:end])
                sizes.append(n[doc:to])
                keys.append(key[doc:to])
                nulls.append(null[doc:to])
                held += end - at
                at, doc = end, to
                if held >= shard_tokens:
                    yield row()
        if held:
            yield row()

    rows = texts(docs).repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", F.xxhash64("text"))
    return scratch.write(rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, SHARD), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. The tokens of the ranges before
    come from one row a range, which is why they can be broadcast."""
    per_part = [(r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()]  # one row for each range
    starts, total = {}, 0
    for part, n in sorted(per_part):
        starts[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                g = grammar(r)
                flat = decode(g).astype("<u4")
                n = np.frombuffer(r["doc_tokens"], "<i8")
                end = np.cumsum(n)
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(end.tolist(), n.tolist(), strict=True)]
                ids = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["doc_null"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(end - n + r["before"] + starts[r["part"]]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def grammar(row: dict) -> Grammar:
    """The grammar of a row of the shard files."""
    return Grammar(row["base"], _widen(row["rules"]).reshape(-1, 2), np.frombuffer(row["round_ends"], "<i4"), np.frombuffer(row["exp_lengths"], "<u4"), _widen(row["sequence"]))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer_path, end_id, Scratch(spark, "repair")))
