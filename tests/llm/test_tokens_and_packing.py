"""Ops 3 and 8 against whole-text encoding and direct recomputation."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodegraph.llm import packing, repair
from lodegraph.llm.common import Scratch
from lodegraph.llm.tokens import Encoder

ODD = ["", " ", "  a b", "a  b \n c", " <|endoftext|> x<|endoftext|>y ", "a  b　c\n\n d", "x\ty z\r\n", "É é ́a", "can't.foo,bar!!x's? 'S a|b<c>d", "x" * 700 + " y", "a.\n\n\t b", "Σ ΑΣ ΣΑ", "12 345,6 .7", "no-space" * 50, "日本語 テキスト。", "end "]
SCHEMA = "doc_id long, text string, lang string, n_tokens string, piece int"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_encode_like_whole_texts(name):
    e = Encoder(public_tokenizers.path(name))
    assert e.kind != "whole"
    for _ in range(2):  # new, then kept
        ids, sizes = e.encode(pa.array(ODD))
        want = [x.ids for x in e.tokenizer.encode_batch(ODD, add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([rng.integers(0, [3, 50, 1000, 2][seed], 5000), np.full(301, 1)]).astype(np.uint32)
    g = repair.compress(ids, 1000, min_count=4, max_rules=5000)
    assert np.array_equal(repair.decode(g), ids)
    if seed != 2:
        assert len(g.sequence) < 0.8 * len(ids)
    for s, e in [(0, 1), (17, 400), (4990, 5301), (5, 5), (0, len(ids))]:
        assert np.array_equal(repair.decode_range(g, s, e), ids[s:e])


def rows(texts):
    return [(i, t, "en", "clash", 7) for i, t in enumerate(texts)]


def test_token_files(spark):
    data = [*rows([*ODD, None]), (3, "again", None, None, None), (None, "no id", None, None, None)]
    made = repair.write_shards(spark.createDataFrame(data, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), 2, Scratch(spark, "t"), shard_tokens=64)
    assert made.count() > 3
    got = {}
    for r in repair.read_shards(made).collect():
        got.setdefault(r["doc_id"], []).append(r)
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for doc in sorted(got, key=lambda x: (x is not None, x)):
        want = {}
        for i, t, *_ in data:
            if i == doc:
                ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
                want[zlib.crc32(np.array(ids, "<u4").tobytes())] = len(ids)
        assert {r["ids_crc32"]: r["n_tokens"] for r in got[doc]} == want
        for r in sorted(got[doc], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
    assert sum(map(len, got.values())) == len(data)


def test_token_files_of_nothing(spark):
    assert repair.token_files(spark, spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert packing.packed(spark, spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def sequential_best_fit(lengths, capacity):
    """One piece at a time, the longest first, into the smallest gap that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_rounds_fill_as_best_fit_does(spark, seed):
    """Ranges are kept apart, so pieces take gaps of other ranges as well."""
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 65, 400), rng.integers(1, 20, 400), rng.integers(1, 64, 400), rng.integers(13, 33, 400), np.full(90, 21)][seed].tolist()
    made = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(lengths)], packing.PIECE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.pack(spark, Scratch(spark, "test").write(made, "made"), 64).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(filled) == sequential_best_fit(lengths, 64)


@pytest.mark.parametrize("seed", range(20))
def test_carried_places_are_those_of_one_sweep(seed):
    """Ranges swept apart and then joined give the pairs of one sweep over everything."""
    rng = np.random.default_rng(seed)
    kinds = rng.integers(0, 2, 60).tolist()  # 0: a place waits, 1: a piece
    cuts = [0, *sorted(rng.integers(0, 61, 5).tolist()), 60]
    stack, want = [], {}
    for i, k in enumerate(kinds):
        if not k:
            stack.append(i)
        elif stack:
            want[i] = stack.pop()
    got, alone, waits, sums = {}, {}, {}, []
    for part, (f, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
        stack, left = [], []
        for i in range(f, e):
            if not kinds[i]:
                stack.append(i)
            elif stack:
                got[i] = stack.pop()
            else:
                left.append(i)
        alone[part], waits[part] = left, stack
        sums.append((part, len(left), len(stack)))
    plan, count = packing.carried(sums)
    for of, first, end, part, rank in plan:
        for place in range(first, end):
            got[alone[part][rank + end - 1 - place]] = waits[of][place]
    assert got == want
    assert sum(count.values()) == sum(e - f for _, f, e, _, _ in plan)


def test_packing(spark):
    data = [*rows([*ODD, None, "many words here " * 900]), (3, "again", None, None, None), (3, "again", None, None, None), (None, "no id", None, None, None)]
    got = packing.packed(spark, spark.createDataFrame(data, SCHEMA), public_tokenizers.path("byte_bpe_50k.json"), capacity=64).collect()
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want, have, filled = [], [], {}
    for i, t, *_ in data:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for j, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want.append((i, j, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    for r in got:
        have.append((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    key = lambda r: (r[0] is not None, *[x or 0 for x in r])
    assert sorted(have, key=key) == sorted(want, key=key)
    assert all(n == 64 for _, j, _, n, _ in want if j)
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(filled) == sequential_best_fit([n for *_, n, _ in want], 64)
