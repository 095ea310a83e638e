"""Op 2 against all pairs of full sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodegraph.llm import common, neardup
from lodegraph.llm.common import Scratch
from lodegraph.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, kept string, n_shingles int"


def shingles(text, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k=4, percent=80):
    s = [shingles(t, k) for _, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(docs[i][0]), find(docs[j][0])))
                root[b] = a
    return sorted((d, len(x), find(d) if x else d, d == (find(d) if x else d)) for (d, _), x in zip(docs, s, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 40, 120]))] for _ in range(25)]
    texts = [None, "", " \n ", "One", "one", "a b c", "A  B\tc", "a b c d", "\x0bA b C d\x0c", "é b c d"]
    for w in base:
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 1, 6])):
            x = list(w)
            for _ in range(rng.randrange(1 + len(x) // 25)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            texts.append(" ".join(x[rng.randrange(2) :]))
    core = [rng.choice(vocab) for _ in range(150)]  # one large group of near copies that pass a long list
    for _ in range(80):
        x = list(core)
        for _ in range(3 - seed):
            x[rng.randrange(len(x))] = rng.choice(vocab)
        texts.append(" ".join(x))
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_like_all_pairs(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in docs], SCHEMA)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark, frame, list_size=[256, 40][seed]).collect())
    assert got == brute(docs)


def test_shared_and_missing_ids(spark):
    docs = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "p q r s t u"), (9, "p q r s t u"), (9, "p q r s t u"), (None, "n o p q"), (7, "n o p q"), (8, None)]
    frame = spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in docs], SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark, frame).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (5, 3, 1, False), (5, 3, 1, False), (9, 3, 1, False), (9, 3, 1, False), (None, 1, None, True), (7, 1, None, False), (8, 0, 8, True)], key=str)
    stay = neardup.one_of_each(spark, frame, 4)
    assert stay.columns == frame.columns
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == sorted([1, None, 8], key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(spark, none).collect() == []
    assert neardup.one_of_each(spark, none).collect() == []


def test_long_lists_stream_in_parts():
    """A list that goes on over many batches links all its members, whatever the batch size."""
    n = 90_000
    small = np.tile(np.arange(32, dtype=np.uint8), (n, 1))
    key = np.full(n, 5 << 32)
    run = neardup._neighbours(80, 14, 16)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 1000]), pa.array(np.arange(i, min(n, i + 1000))), pa.array(np.full(1000, 50)), pa.array([r.tobytes() for r in small[i : i + 1000]], pa.binary()), pa.array(np.full(1000, -1))], names=["key", "rep", "n", "small", "mask"]) for i in range(0, n, 1000)]
    got = pa.Table.from_batches(list(run(iter(batches))))
    assert set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) >= {(i - 1, i) for i in range(1, n)}
    assert got.num_rows <= 2 * n


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


def _near(rng, words, changes):
    x = list(words)
    for i in rng.sample(range(len(x)), changes):
        x[i] = f"n{rng.randrange(10**9)}"
    return x


def _same_as_brute(spark, docs, **limits):
    frame = spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in docs], SCHEMA)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark, frame, **limits).collect())
    want = brute(docs, percent=limits.get("percent", 80))
    assert got == want
    return len({r[2] for r in want})


def test_long_lists_of_templates(spark, monkeypatch):
    """Documents that are less alike than wanted, with true pairs among them, in lists far longer than list_size."""
    monkeypatch.setattr(neardup, "BLOCK", 16)  # a list is several blocks
    rng = random.Random(5)
    core = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    docs = [" ".join(_near(rng, core, 3)) for _ in range(200)]
    docs += [" ".join(_near(rng, docs[i].split(), 4)) for i in range(0, 200, 10)]
    rng.shuffle(docs)
    n = _same_as_brute(spark, list(enumerate(docs)), list_size=64)
    assert 20 < n < len(docs)  # neither one group nor none


def test_short_lists_are_whole(spark):
    """Two near copies meet even if there are more partitions than postings of a list."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        docs = [(i, " ".join([*words, *[f"{i}v{k}" for k in range(40)]])) for i in (1, 2)]  # 0.59 alike, so orders differ
        assert _same_as_brute(spark, docs, percent=50, matches=8) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_lists_at_production_parameters(spark):
    """Most of each text is shared by more than LIST documents, so all its lists that matter are long; some pairs are alike."""
    rng = random.Random(8)
    core = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    docs = [" ".join([*core, *[f"u{i}x{k}" for k in range(60)]]) for i in range(300)]  # 0.54 alike
    docs += [" ".join(_near(rng, docs[i].split(), 3)) for i in range(0, 300, 6)]
    rng.shuffle(docs)
    assert _same_as_brute(spark, list(enumerate(docs))) == 300


def test_frequent_coordinates_dont_hide_rare_ones(spark):
    """Two documents that share rare text, and a frequent passage with many others, are found in their short lists."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(30)]
    docs = [" ".join([*passage, *[f"u{i}x{k}" for k in range(100)]]) for i in range(320)]
    docs += [" ".join(_near(rng, docs[i].split(), 2)) for i in range(0, 320, 40)]
    assert _same_as_brute(spark, list(enumerate(docs))) == 320


def test_posted_pairs_are_skipped_after_short_lists_only():
    """404 signatures share three coordinates; a pair with 18 collisions in all meets in lists of three postings."""
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 256, (404, 32)).astype(np.uint8)
    sig[:, :3] = 7
    sig[1, 3:18] = sig[0, 3:18]
    mask = np.full(404, ~7)  # the first three lists are long
    rows = [(3 << 32, i, 50, sig[i].tobytes(), int(mask[i])) for i in (0, 1, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["key", "rep", "n", "small", "mask"])
    got = pa.Table.from_batches(list(neardup._whole(80, 14)(iter([batch]))))
    assert got.to_pylist() == [{"a": 0, "b": 1}]


def test_nothing_that_grows_is_broadcast_by_file_size(spark, monkeypatch):
    """Small files may hold many rows: what has more than FEW is broadcast only after a shuffle has measured it."""
    rng = random.Random(4)
    core = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    docs = [" ".join([*core, *[f"u{i}x{k}" for k in range(60)]]) for i in range(100)]
    docs += [" ".join(_near(rng, docs[i].split(), 3)) for i in range(0, 100, 5)]
    monkeypatch.setattr(common, "FEW", 0, raising=False)
    plans, write = [], Scratch.write

    def planned(df):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        for i, x in enumerate(lines):
            if "BroadcastExchange" in x:
                below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
                if not any("- Exchange " in y for y in lines[i + 1 : below]):
                    plans.append((name, lines[i + 1 : below]))

    def recorded(self, df, at):
        nonlocal name
        name = at
        planned(df)
        return write(self, df, at)

    name = ""
    monkeypatch.setattr(Scratch, "write", recorded)
    frame = spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in enumerate(docs)], SCHEMA)
    out = neardup.near_duplicates(spark, frame)
    name = "result"
    planned(out)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect())
    assert got == brute(list(enumerate(docs)))
    assert plans == []
