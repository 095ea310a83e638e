"""Each stage of the pipeline on its predecessor's rows, against a plain recomputation."""

from __future__ import annotations

import re

import corpus_pipeline as p
from lodegraph.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in got} == set(rows)
            break
        assert out.dtypes == docs.dtypes and out.columns == COLUMNS
        kept = {r["doc_id"]: r for r in got}
        assert len(kept) == len(got) and set(kept) <= set(rows)
        if name == "toxicity":
            label = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
            clean = [d for d in rows if label.get(d) == 0]
            assert sum(d in kept for d in clean) >= 0.95 * len(clean)
        if name == "near_dedup":
            sets = {d: shingles(r["text"]) for d, r in rows.items()}
            near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
            todo, want = set(rows), set()
            while todo:
                group, new = set(), {min(todo)}
                while new:
                    group |= new
                    new = {d for d in todo - group if any(near(sets[d], sets[g]) for g in new)}
                want.add(min(group))
                todo -= group
            assert set(kept) == want
        if name == "decontamination":
            wins = {tuple(w[i : i + 10]) for r in table(spark, sf_dir, "benchmark").collect() for w in [words(r["text"])] if w for i in range(max(1, len(w) - 9))}
            sizes = {len(w) for w in wins}
            assert set(kept) == {d for d, r in rows.items() for w in [words(r["text"])] if not any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))}
        if name == "pii":
            assert set(kept) == set(rows)
            assert not [1 for r in got if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r["text"] or "")]
        else:
            assert all(kept[d]["text"] == rows[d]["text"] for d in kept)
        docs, rows = spark.createDataFrame(got, docs.schema), kept


def test_stages_of_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        if name != "packing":
            assert out.columns == COLUMNS


def test_packing_broadcasts_no_pieces(spark, sf_dir):
    """The pieces' files are small, but there is a row for each piece of the corpus."""
    out = p.pack_sequences(spark, table(spark, sf_dir, "documents"), sf_dir)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in table(spark, sf_dir, "documents").collect()}
