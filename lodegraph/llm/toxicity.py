"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled training rows gives the lexicon (words and word beginnings that stand out in
toxic texts), the trees and the calibration; everything else looks at whole texts of all rows. Features are
lexicon densities, how near a word of the second person stands to a hit, capitals, punctuation, and
obfuscation: hits that show only once symbols inside words are dropped and digits are read as letters.

Rows with crc32(doc_id as text) mod 5 = 0 are held out and never learned from; a null doc_id counts as the
empty text, which is held out. Null texts are empty ones and get a score like any. Without both kinds of
label the score is the share of toxic rows among the labelled ones (0 without labels). Labels that repeat
for a doc_id count as toxic if one of them is; of several texts of a doc_id the least is learned from, and all are scored one
by one. A score of one half is toxic. An empty table gives no rows. Rows go in parts of bounded bytes, so memory follows
the longest text (about a hundred times its size); columns besides doc_id and text are ignored or kept, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import buffers, lower_map, runs, spans
from .common import Scratch, short_batches, slices, texts

#: Labelled rows that the classifier is fitted on, at most: those of the lowest hashes of doc_id.
SAMPLE = 20_000
#: Entries of the lexicon, at most.
LEXICON = 3000
#: Toxic texts of the sample that a candidate stands in, at least; standard errors that its log odds lie above 0.
MIN_TOXIC, MIN_Z = 6, 5.0
PREFIXES = (4, 5, 6)
FOLDS = 4

# Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself yourselves u ur du dich dir dein deine deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split()
# Digits and symbols read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_KINDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 8, dtype=np.uint64)
FEATURES = ("density", "hits", "weight_density", "best_weight", "kinds", "hidden_hits", "hidden_density", "nearness", "second_person", "capitals", "shouted", "punctuation", "exclaims", "digits", "inner_symbols", "word_length", "words")


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = out[128:] = True
    return out


def _leet_map() -> np.ndarray:
    """Letters lower-cased, what stands for letters as letters, white space as a space, other ASCII as 0."""
    out = lower_map()
    out[:128] = np.where(_letters()[:128], out[:128], 0)
    out[[9, 10, 11, 12, 13, 32]] = 32
    for k, v in LEET.items():
        out[ord(k)] = ord(v)
    return out


def _clear_map() -> np.ndarray:
    out = _leet_map()
    out[[ord(k) for k in LEET]] = 0
    return out


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places among the words, keys) of whole words and of the beginnings of longer ones."""
    low = lower_map()
    out = [(np.arange(len(start)), spans(data, start, end, low) ^ _KINDS[0])]
    for k in PREFIXES:
        at = np.flatnonzero(end - start > k)
        out.append((at, spans(data, start[at], start[at] + k, low) ^ _KINDS[k]))
    return out


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 for others; a bit table sorts most keys out first."""
    out = np.full(len(keys), -1, np.int64)
    if not len(table) or not len(keys):
        return out
    seen = np.zeros(1 << 18, bool)
    seen[(table & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, keys[maybe]), len(table) - 1)
    out[maybe] = np.where(table[at] == keys[maybe], at, -1)
    return out


@dataclass
class Lexicon:
    keys: np.ndarray  # sorted
    weights: np.ndarray  # log odds

    def hits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best weight of each word, 0 without a hit; the entry it comes from."""
        weight, entry = np.zeros(len(start), np.float32), np.full(len(start), -1, np.int64)
        for at, keys in _keys(data, start, end):
            found = _lookup(self.keys, keys)
            at, found = at[found >= 0], found[found >= 0]
            more = self.weights[found] > weight[at]
            weight[at[more]], entry[at[more]] = self.weights[found[more]], found[more]
        return weight, entry


_PRONOUNS = np.sort(spans(*(lambda raw, off: (raw, off[:-1], off[1:], lower_map()))(*buffers(pa.array(SECOND_PERSON)))))


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    n = len(column)
    data, off = buffers(column)
    row, start, end = runs(data, off, _letters())
    n_words = np.bincount(row, minlength=n)
    safe = np.maximum(n_words, 1)
    weight, entry = lexicon.hits(data, start, end)
    hit = weight > 0
    count = lambda mask, rows: np.bincount(rows[mask], minlength=n)
    hits = count(hit, row)
    best = np.zeros(n, np.float32)
    np.maximum.at(best, row[hit], weight[hit])
    kinds = np.unique(np.stack((row[hit], entry[hit]), 1), axis=0)[:, 0]
    me = _lookup(_PRONOUNS, spans(data, start, end, lower_map())) >= 0
    gap = np.full(n, np.inf)
    if hit.any() and me.any():
        at, you = np.flatnonzero(hit), np.flatnonzero(me)
        right = np.searchsorted(you, at)
        for k in (np.minimum(right, len(you) - 1), np.maximum(right - 1, 0)):
            near = np.where(row[you[k]] == row[at], np.abs(you[k] - at), np.inf)
            np.minimum.at(gap, row[at], near)
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    is_upper, is_letter = (data >= 65) & (data < 91), _letters()[data]
    is_mark = ((data >= 33) & (data < 48)) | ((data >= 58) & (data < 65)) | ((data >= 91) & (data < 97)) | ((data >= 123) & (data < 127))
    upper, letter, mark = count(is_upper, doc), count(is_letter, doc), count(is_mark, doc)
    ups = np.concatenate(([0], np.cumsum(is_upper)))
    shouted = count((ups[end] - ups[start] == end - start) & (end - start > 1), row)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = (is_mark | ((data >= 48) & (data < 58)))[1:-1] & is_letter[:-2] & is_letter[2:] & (doc[:-2] == doc[2:])
    hidden = np.zeros(n, np.int64)
    for byte_map in (_leet_map(), _clear_map()):
        read = byte_map[data]
        stay = read > 0
        places = np.concatenate(([0], np.cumsum(stay)))
        r, s, e = runs(read[stay], places[off], np.arange(256) != 32)
        hidden = np.maximum(hidden, count(lexicon.hits(read[stay], s, e)[0] > 0, r) - hits)
    length = np.maximum(size, 1)
    return np.stack([hits / safe, np.log1p(hits), np.bincount(row[hit], weight[hit], n) / safe, best, np.log1p(np.bincount(kinds, minlength=n)), np.log1p(hidden), hidden / safe, 1 / (1 + gap), count(me, row) / safe, upper / np.maximum(letter, 1), shouted / safe, mark / length, count((data == 33) | (data == 63), doc) / length, count((data >= 48) & (data < 58), doc) / length, count(inner, doc) / safe, letter / safe, np.log1p(n_words)], 1).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees of equal depth over binned features; node k has the children 2k + 1 and 2k + 2."""

    edges: list[np.ndarray]
    depth: int
    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value of leaves

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut, value in self.splits:
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 2.0) -> Trees:
    model = Trees([np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])], depth)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model.base = float(np.log(share / (1 - share)))
    b = model.binned(x).astype(np.int64)
    margin = np.full(len(y), model.base)
    n_inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(n_inner, np.int64), np.full(n_inner, bins, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            gain = np.zeros((width, x.shape[1], bins))
            for j in range(x.shape[1]):
                where = local * bins + b[:, j]
                gs, hs = (np.bincount(where, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                ok = (hs > 1) & (ht - hs > 1)
                gain[:, j] = np.where(ok, gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth), 0)
            flat = gain.reshape(width, -1)
            top = flat.argmax(1)
            some = flat[np.arange(width), top] > 1e-6
            feature[first : first + width] = np.where(some, top // bins, 0)
            cut[first : first + width] = np.where(some, top % bins, bins)
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - n_inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smooth)
        margin += value[leaf]
        model.splits.append((feature, cut, value))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (score, share of toxic) of the steps, increasing."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, number, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.share)
        m = self.trees.margin(features(column, self.lexicon))
        return np.clip(0.998 * np.interp(m, *self.steps) + 0.002 / (1 + np.exp(-m)), 0, 1)  # the margin orders within a step


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon_size: int = LEXICON) -> Model:
    short_batches(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    train = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = scratch.write(texts(docs).join(F.broadcast(train), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.float32)), None, None, float(bool(n_toxic)))

    def counted(only: np.ndarray | None) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for whole in batches for x in slices(whole, 0)):
                data, off = buffers(b.column(0))
                row, start, end = runs(data, off, _letters())
                found = []
                for at, keys in _keys(data, start, end):
                    if only is not None:
                        good = _lookup(only, keys) >= 0
                        at, keys = at[good], keys[good]
                    pair = np.unique(np.stack((row[at].astype(np.uint64), keys)), axis=1)
                    found.append(pair[1])
                key, number = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(number.astype(np.int64))], names=["key", "n"])

        return run

    def numbers(some: DataFrame, only: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
        got = some.select("text").mapInArrow(counted(only), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
        key, number = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
        order = np.argsort(key)
        return key[order], number[order]

    key, toxic = numbers(rows.where("toxic > 0"), None, MIN_TOXIC)  # bounded by the sample: each stands in so many of its texts
    seen, number = numbers(rows.where("toxic <= 0"), key, 1)
    clean = np.zeros(len(key), np.int64)
    clean[np.searchsorted(key, seen)] = number
    odds = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (n_clean - clean + 0.5))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (n_toxic - toxic + 0.5) + 1 / (clean + 0.5) + 1 / (n_clean - clean + 0.5))
    # words that stand in most toxic texts only because these are long aren't evidence: their odds must be high as well
    good = np.flatnonzero((odds / error >= MIN_Z * 0.6) & (odds >= np.log(8)))
    good = np.sort(good[np.argsort(-(odds * np.sqrt(toxic))[good], kind="stable")[:lexicon_size]])
    lexicon = Lexicon(key[good], odds[good].astype(np.float32))

    names = [f"f{i}" for i in range(len(FEATURES))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 0)):
            x = features(b.column(0), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array((b.column(1).to_numpy() > 0).astype(np.int32)), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["toxic", *names])

    got = rows.mapInArrow(measured, f"toxic int, {', '.join(f'{c} float' for c in names)}").toArrow()  # `sample` rows at most
    x, y = np.stack([got[c].to_numpy() for c in names], 1), got["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    fold = np.arange(len(y)) % FOLDS
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        part = fold != k
        raw[~part] = boost(x[part], y[part]).margin(x[~part]) if 0 < y[part].sum() < part.sum() else 0.0
    return Model(lexicon, boost(x, y), isotonic(raw, y), n_toxic / (n_toxic + n_clean))


SCORED = "doc_id long, score double"


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(spark, docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)))], names=["doc_id", "score"])

    made = texts(docs).mapInArrow(run, SCORED)
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def acceptable(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half, with all their columns."""
    model = fit(spark, docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, whole.schema.get_field_index("text"))):
            text = b.column(b.schema.get_field_index("text")).cast(pa.string()).fill_null("")
            yield b.filter(pa.array(model.score(text) < 0.5))

    return docs.mapInArrow(run, docs.schema)
