"""What the tables between steps cost the file system."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from lodegraph.llm import packing
from lodegraph.llm.common import Scratch, few_tasks
from lodegraph.llm.graph import components


def files(df):
    return [p.name for p in Path(df._scratch_path.removeprefix("file:")).iterdir()]


@pytest.fixture
def many_parts(spark):
    """As many shuffle partitions as a large table has, none of them joined."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def written(monkeypatch):
    """(name, files) of each table when it is written."""
    out, write = [], Scratch.write

    def counted(self, df, name):
        made = write(self, df, name)
        out.append((name, sum(x.endswith(".parquet") for x in files(made))))
        return made

    monkeypatch.setattr(Scratch, "write", counted)
    return out


def test_tables_have_no_checksum_files(spark):
    """The local file system starts processes for each, whose memory counts twice while they start."""
    made = Scratch(spark, "t").write(spark.range(0, 100, 1, 8), "numbers")
    assert sorted(r["id"] for r in made.collect()) == list(range(100))
    assert not [x for x in files(made) if x.endswith(".crc")]


def test_rounds_write_few_files(spark, many_parts, written):
    """Ranges that one task sweeps stay apart: every piece has a place of its own, in as many sequences as with a task each."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 40, 1500).tolist()
    made = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(lengths)], packing.PIECE)
    got = packing.pack(spark, Scratch(spark, "t").write(made, "made"), 64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(filled) <= -(-sum(lengths) // 64) + 1
    most = spark.sparkContext.defaultParallelism
    assert {"swept", "pairs", "gaps"} <= {name for name, _ in written}
    assert not [x for x in written if x[0] in ("swept", "pairs", "gaps") and x[1] > most]


def test_components_write_few_files(spark, many_parts, written):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10 != 9], "a long, b long")
    got = {r["id"]: r["root"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: i - i % 10 for i in range(300) if i % 10}
    assert written and not [x for x in written if x[1] > spark.sparkContext.defaultParallelism]


def test_few_tasks_keep_partitions_whole(spark, many_parts):
    rows = spark.range(1000).repartition(64, "id")
    assert rows.rdd.getNumPartitions() == 64
    assert few_tasks(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in few_tasks(rows).collect()) == list(range(1000))
