"""Whitening against exact rational arithmetic and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm.whiten import BELOW, SHIFT, STEP, from_residues, gram, op13, primes, whiten

D = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, component string, n int"


def exact(vectors):
    """(x, n, S, V) with V's entries as fractions."""
    x = [[math.floor(1024 * c) + SHIFT for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    return x, y, n, s, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


def check(got, vectors, key=lambda r: r.vec_id, tol=1e-7):
    x, y, n, s, v = exact(vectors)
    values, basis = np.linalg.eigh(np.array(v, float))
    values, basis = values[::-1], basis[:, ::-1]
    rows = {(key(r), r.component): r for r in got}
    assert len(rows) == len(got) == n * min(8, len(s))
    for i, r in enumerate(y):
        for c in range(min(8, len(s))):
            g = rows[i, c + 1]
            assert g.n == n and int(g.deviation_exact) == sum(a * a for a in r) and g.deviation in (None, int(g.deviation_exact))
            assert g.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) and g.identity_error < 1e-6
            want = float(np.dot(np.array(r, float) / n, basis[:, c]) / math.sqrt(values[c]))
            assert abs(g.whitened) == pytest.approx(abs(want), rel=tol, abs=tol)


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**40), 10**40))
def test_remainders_give_back_the_integer(x):
    ps = primes(2 * 10**40)
    assert len(set(ps)) == len(ps) and from_residues([x % p for p in ps], ps) == x


def test_products_of_residues_are_exact():
    p = primes(1)[0]
    assert BELOW**2 * STEP <= 1 << 53
    x = np.random.default_rng(1).integers(-(1 << 61), 1 << 61, (5000, 3))
    x[:2000] = -1  # the largest residues
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) % p for j in range(3)] for i in range(3)]
    assert gram(x, p).tolist() == want


def test_a_table(spark):
    vectors = spark.read.parquet(f"{D}/embeddings.parquet")
    rows = sorted(vectors.collect(), key=lambda r: r.vec_id)
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = op13(vectors.repartition(7))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(got.collect(), [list(r.embedding) for r in rows], lambda r: at[r.vec_id])


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(5)
    vectors = (r.standard_normal((60, 3)) * [5e14, 1e13, 3e14]).tolist()
    got = op13(spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(vectors)], SCHEMA)).collect()
    check(got, vectors, tol=1e-3)
    assert any(g.deviation is None for g in got)


def test_rows_left_out_and_columns_that_clash(spark):
    r = np.random.default_rng(2)
    good = r.standard_normal((40, 2)).tolist()
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [None, None]]
    rows = [(i, v, "c", 1) for i, v in enumerate(good)] + [(100 + i, v, "c", 1) for i, v in enumerate(bad)]
    check(op13(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), good)


def test_lengths_apart_and_no_variance(spark):
    r = np.random.default_rng(3)
    rows = [(i, v, "", 0) for i, v in enumerate(r.standard_normal((30, 10)).tolist())] + [(100 + i, [2.0, float(i)], "", 0) for i in range(5)] + [(None, [0.5], "", 0)]
    got = op13(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(g.n, g.vec_id is None) for g in got} == {(30, False), (5, False), (1, True)}
    assert sorted((g.component, g.whitened, g.explained) for g in got if g.n == 5 and g.component == 2) == [(2, 0.0, 0.0)] * 5
    assert [(g.component, g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in got if g.n == 1] == [(1, 1, 0, 0.0, 0.0, 0.0)]
    assert max(g.identity_error for g in got) < 1e-9 and len([g for g in got if g.n == 30]) == 240


def test_repeated_rows_count_each(spark):
    v = np.random.default_rng(4).standard_normal((10, 4)).tolist()
    rows = [(1, v[i % 10], "", 0) for i in range(30)]
    got = op13(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 120 and {g.n for g in got} == {30}
    assert sum(g.whitened**2 for g in got) == pytest.approx(120)


def test_no_vectors(spark):
    assert whiten(spark.createDataFrame([(1, None, "", 0)], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).agg(F.count("*")).first()[0] == 0
