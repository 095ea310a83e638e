"""Every registered query against its SQL, and the contract module without the optional parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from lodegraph.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(r[n] for n in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toArrow(), con.execute(catalog.SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"r17_mro_shadow"}  # compared below


def test_contract_without_the_optional_parts(tmp_path):
    for f in ("__spark_entry__.py", "lodegraph"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{f}") else shutil.copy)(f"{ROOT}/{f}", tmp_path / f)
    shutil.rmtree(tmp_path / "lodegraph/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))]


def test_whole_edge_sets(con, spark, sf_dir):
    """No edge or node is left out: the same sets by a plain walk over the tables."""
    rows_of = lambda name: {tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()}
    parts = {f"p{k}" for (k,) in con.execute("SELECT p_partkey FROM part").fetchall()}
    called = {f"p{k}" for (k,) in con.execute("SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()}
    assert {r[0] for r in rows_of("j5_absent_edge_all")} == parts - called
    supplied = con.execute("SELECT s_suppkey, s_nationkey FROM supplier").fetchall()
    assert {r[:2] for r in rows_of("r22_import_distance_edges")} == {(f"s{s}", f"n{n}") for s, n in supplied}


def test_mro_shadows_like_a_plain_walk(con, spark, sf_dir):
    """Every class's bases are half and a third of its key. A class precedes its bases, a base that several share comes after all of them."""
    keys = [k for (k,) in con.execute("SELECT s_suppkey FROM supplier").fetchall()]
    bases = {k: list(dict.fromkeys((k // 2, k // 3))) for k in keys if k > 2}

    def line(k):
        done = []

        def visit(x):
            if x not in done:
                for b in reversed(bases.get(x, [])):
                    visit(b)
                done.append(x)

        visit(k)
        return done[::-1]

    leaf = lambda k, m: {3: "m3(T,Map<K,V>)" if k % 2 else "m3(A,Map<B,C>)", 4: "m4()"}.get(m, f"m{m}")
    own = {k: {leaf(k, m) for m in range(5) if (k + m) % 3 and not (m == 2 and k % 5 == 0)} for k in keys}
    want = set()
    for k in bases:
        for name in {n for a in line(k) for n in own.get(a, ())}:
            first, *later = [a for a in line(k) if name in own.get(a, ())]
            want |= {(f"c{first}.{name}", f"c{a}.{name}") for a in later if a not in line(first)}
    got = {(r["member"], r["overridden"]) for r in catalog.QUERIES["r17_mro_shadow"](spark, sf_dir).collect()}
    assert got == want
