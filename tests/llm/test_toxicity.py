"""Op 5: parts by hand, held-out accuracy on invented texts, and odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from lodegraph.llm import toxicity
from lodegraph.llm.bytewords import lower_map, spans

DOCS = "doc_id long, text string, lang string, score string, toxic int"
LABELS = "doc_id long, quality int, toxic int"


def lexicon(*words):
    raw = [w.encode() for w in words]
    keys = np.array([spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), lower_map())[0] for w in raw]) ^ toxicity._KINDS[0]
    order = np.argsort(keys)
    return toxicity.Lexicon(keys[order], np.full(len(words), 2.0, np.float32))


def test_features():
    texts = ["You MORON, moron! fine", "m.o.r.o.n and m0ron here", "", "nothing bad", "é" * 5, "you " * 3 + "x " * 9 + "moron"]
    x = {n: v for n, v in zip(toxicity.FEATURES, toxicity.features(pa.array(texts), lexicon("moron")).T, strict=True)}
    assert np.allclose(np.expm1(x["hits"]), [2, 0, 0, 0, 0, 1], atol=1e-5)
    assert x["hidden_hits"][1] > 0 and not x["hidden_hits"][[0, 2, 3, 4]].any()
    assert np.allclose(x["nearness"], [0.5, 0, 0, 0, 0, 1 / 11]) and x["best_weight"][0] == 2
    assert x["capitals"][0] > 0.3 and x["exclaims"][0] > 0 and np.isfinite(np.stack(list(x.values()))).all()


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    m = toxicity.boost(x[:2000], y[:2000]).margin(x[2000:])
    assert ((m > 0) == (y[2000:] > 0)).mean() > 0.97
    at, share = toxicity.isotonic(m, y[2000:])
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all() and 0 <= share.min() and share.max() <= 1


def corpus(n):
    rng = random.Random(5)
    good, bad = [f"word{i}" for i in range(300)], ["zounds", "knave", "varlet"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "en", "clash", 9))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(600)
    docs += [(10_000, None, None, None, None), (10_001, "", "en", "", 0), (None, "knave varlet zounds", "en", "", 0), (3, docs[3][1], "en", "", 0), (10_002, "knave " * 20000, "en", "", 0)]
    labels += [(3, 1, labels[3][2]), (None, 1, 1), (20_000, 1, 1), (5, 0, None)]
    rows = toxicity.score(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    truth = {d: t for d, _, t in labels if t is not None}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    got = {r["doc_id"]: r["predicted"] for r in rows}
    assert got[None] == 1 and got[10_002] == 1 and got[10_000] == got[10_001] == 0
    kept = toxicity.acceptable(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if not r["predicted"])


def test_labels_never_leak_from_held_out_rows(spark):
    docs, labels = corpus(200)
    turned = [(d, q, 1 - t) if zlib.crc32(str(d).encode()) % 5 == 0 else (d, q, t) for d, q, t in labels]
    frame = spark.createDataFrame(docs, DOCS)
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(spark, frame, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


def test_few_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert {r["score"] for r in toxicity.score(spark, docs, one).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(spark, docs, one.limit(0)).collect()} == {0.0}
    assert toxicity.score(spark, docs.limit(0), one).collect() == []
