"""Op 6 against a search of every window at every place."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from lodegraph.llm import decontamination as d

SCHEMA = "doc_id long, text string, lang string, n_words string, contaminated int"


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(str(i) if i is not None else "null", tuple(w[s : s + window])) for s in range(max(1, len(w) - window + 1)) if w]
    out = {}
    for doc, t in docs:
        w = words(t)
        hit, found = set(), set()
        for name, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(name)
        out.setdefault((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)), 0)
    return out


def longest(w, items, window):
    """Of the verbatim matches that hold a whole window."""
    best = 0
    for _, t in items:
        x = words(t)
        for s in range(len(w)):
            for p in range(len(x)):
                n = 0
                while s + n < len(w) and p + n < len(x) and w[s + n] == x[p + n]:
                    n += 1
                if n >= min(window, len(x)):
                    best = max(best, n)
    return best


@pytest.mark.parametrize(("seed", "block_bytes", "pass_bytes"), [(0, 1 << 20, 1 << 20), (1, 60, 1), (2, 200, 500)])
def test_like_brute_force(spark, seed, block_bytes, pass_bytes):
    rng = random.Random(seed)
    vocab = [*"abcde", "Xé", "7", "straße", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, say(rng.choice([2, 3, 5, 9]))) for i in range(12)]
    items += [(3, items[0][1]), (None, items[1][1]), (99, None), (98, ""), (97, "...")]
    docs = [(i, say(rng.randrange(60))) for i in range(40)]
    docs += [(40, items[2][1]), (41, docs[3][1]), (41, docs[3][1]), (42, None), (43, ""), (44, items[3][1].upper() + " z " + items[3][1]), (None, items[4][1]), (45, "zz " * 3000 + items[5][1])]
    frame = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = d.digest(spark, frame, bench, window=4, shard_words=100, block_bytes=block_bytes, pass_bytes=pass_bytes).collect()
    assert len(rows) == len(docs)
    assert {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == set(brute(docs, items, 4))
    for r in rows:
        if r["contaminated"] and r["doc_id"] is not None and r["doc_id"] < 45:
            w = words(dict(docs)[r["doc_id"]])
            assert r["longest_match"] == longest(w, items, 4)
            there = w[r["longest_at"] : r["longest_at"] + r["longest_match"]]
            assert any(there == words(t)[p : p + len(there)] for _, t in items for p in range(len(words(t))))
    kept = d.clean(spark, frame, bench, window=4, shard_words=100, block_bytes=block_bytes, pass_bytes=pass_bytes)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k[0] for k, in zip([(i,) for i, t in docs if not any(b[5] for b in brute([(i, t)], items, 4))]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.digest(spark, none, bench).collect() == []
    (row,) = d.digest(spark, spark.createDataFrame([(1, "a b c", "en", "", 0)], SCHEMA), bench).collect()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (3, 0, False)


@pytest.mark.parametrize("unit", ["again", "one two", "a b c d e f g h i j k l m"])
def test_repetition_costs_no_square(spark, unit):
    """20,000 repeated words of an item in a document of as many; all pairs of places would be 400 million."""
    text = " ".join([unit] * (20_000 // len(unit.split())))
    docs = spark.createDataFrame([(1, text), (2, f"{text} x {text}"), (3, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (8, unit)], "item_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in d.digest(spark, docs, bench).collect()}
    assert time.perf_counter() - began < 60
    n = len(text.split())
    assert (got[1]["n_hit"], got[1]["longest_match"], got[1]["longest_at"]) == (n, n, 0)
    assert (got[2]["n_hit"], got[2]["longest_match"], got[2]["longest_at"]) == (2 * n, n, 0)
    assert (got[3]["n_hit"], got[3]["longest_at"]) == (0, -1)
