"""Whitening against a dense eigendecomposition of exact integers."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sablewatch.llm import whiten as w

SCHEMA = "vec_id bigint, embedding array<float>, component int, n string"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], 3, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def integers(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)


def check(got, vectors, ids, k):
    x = integers(vectors)
    n, d = x.shape
    total = x.sum(0)
    exact = n * x - total
    off = (exact / n).astype(float)
    cov = np.array([[float(Fraction(int((exact[:, i] * exact[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c, rows in by.items():
        rows.sort(key=lambda r: r.vec_id)
        assert [r.vec_id for r in rows] == sorted(ids)
        assert {r.n for r in rows} == {n}
        assert [r.deviation for r in rows] == [int((exact[i] ** 2).sum()) for i in np.argsort(ids)]
        assert abs(rows[0].explained - values[c - 1] / values.sum()) < 1e-12
        assert rows[0].identity_error < 1e-10
        want = off[np.argsort(ids)] @ basis[:, c - 1] / math.sqrt(values[c - 1])
        have = np.array([r.whitened for r in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
    white = np.array([[r.whitened for r in by[c]] for c in sorted(by)])
    assert np.abs(white @ white.T / n - np.eye(k)).max() < 1e-10


def test_rows_by_hand(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 12)) * np.linspace(0.2, 2, 12)).astype(np.float32)
    ids = [int(i) for i in rng.permutation(400)]
    check(w.whiten(table(spark, vectors, ids).repartition(7)).collect(), vectors, ids, 8)


def test_fewer_dimensions_copies_and_one_direction(spark):
    rng = np.random.default_rng(4)
    vectors = np.vstack([rng.standard_normal((30, 3)), np.ones((40, 3))]).astype(np.float32)
    check(w.whiten(table(spark, vectors)).collect(), vectors, list(range(70)), 3)
    line = [[float(i), 2.0 * i, 5.0] for i in range(20)]
    check(w.whiten(table(spark, line)).collect(), line, list(range(20)), 1)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0], [0.25, -1.0], [3.0, 0.125]]
    bad = [None, [], [nan, 1.0], [1.0, inf], [None, 1.0], [1.0], [1.0, 2.0, 3.0], [3e38, 1.0]]
    got = w.whiten(table(spark, good + bad)).collect()
    check(got, good, [0, 1, 2], 2)
    null = w.whiten(table(spark, good + good, [None, 1, 2, 1, 2, None])).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in null if r.component == 1) == sorted([(False, 1), (False, 2)] * 2 + [(True, None)] * 2)
    for none in (good[:1], good[:1] * 5, bad[:5]):
        assert w.whiten(table(spark, none)).collect() == []
    empty = w.whiten(table(spark, good).where(F.lit(False)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**40, 1.0], [2.0**41, 0.5], [-(2.0**39), 0.25]]
    got = w.whiten(table(spark, vectors)).collect()
    x = integers(vectors)
    exact = [int(v) for v in ((3 * x - x.sum(0)) ** 2).sum(1)]
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id) if r.component == 1] == [None if v >= 1 << 63 else v for v in exact]


def scatter(x):
    return (x - x.mean(0)).T @ (x - x.mean(0))


def test_updates_and_merges():
    rng = np.random.default_rng(8)
    cases = [
        rng.standard_normal((300, 20)) * 50 + 1e5, rng.standard_normal((80, 2)) @ rng.standard_normal((2, 9)), np.repeat(np.eye(5), 30, 0) * 9,
        np.ones((9, 4)), rng.integers(0, 2, (200, 6)).astype(float), rng.standard_normal((100, 4)) * [1e-4, 1, 1e3, 1e6],
    ]
    for x in cases:
        parts = []
        for rows in np.array_split(x, 4):
            own = w.Spectrum.of(x.shape[1])
            for r in rows:
                own.row(r)
            parts.append(own)
        first = parts[0]
        for other in parts[1:]:
            first.merge(w.Spectrum.read(*other.record()))
        want, size = scatter(x), max(np.abs(scatter(x)).max(), 1)
        assert first.n == len(x) and np.allclose(first.mean, x.mean(0), rtol=1e-12, atol=1e-9)
        assert np.abs(first.vectors.T @ first.vectors - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(first.vectors * first.values @ first.vectors.T - want).max() < 1e-11 * size
        assert (np.diff(first.values) >= 0).all()


def test_spectra_merge_in_a_tree(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, (60, 4)) / 64
    own = table(spark, x).select(F.col("embedding").cast("array<double>").alias("embedding")).repartition(7)
    got = w.spectrum(own, 4, fan_in=2)
    want = scatter(integers(x).astype(float))
    assert got.n == 60 and np.abs(got.vectors * got.values @ got.vectors.T - want).max() < 1e-10 * want.max()
