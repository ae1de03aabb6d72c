"""Whitening against numpy's dense eigensolver and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from netlumen.llm import feast, whitening

VEC = "vec_id long, embedding array<float>, label int"


def expected(rows, k=32):
    good = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in good])
    n, sums = len(x), x.sum(axis=0)
    dev = [sum(int(e) ** 2 for e in r) for r in (n * x.astype(object) - sums)]
    y = x - sums / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in good], n, dev, y @ u / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("n, d, spread", [(500, 64, 0.0), (300, 40, 0.2), (50, 3, 0.0)])
def test_whitening_is_exact(spark, n, d, spread):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, d)) * np.exp(-spread * np.arange(d)) + 3
    rows = [(i, [float(np.float32(c)) for c in r], 1) for i, r in enumerate(v)]
    rows += [(9000, None, 1), (9001, [None] * d, 1), (9002, [math.nan] + [1.0] * (d - 1), 1), (9003, [math.inf] * d, 1),
             (9004, [], 1), (9005, [1.0], 1), (None, rows[0][1], 2), rows[1], rows[1]]
    usable = [r for r in rows if r[1] and len(r[1]) == d]
    ids, count, dev, white, share = expected(usable)
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "'x' AS N", "1 AS `Component`", "2 AS `a.b`").repartition(4)
    model = whitening.fit(df)
    got = whitening.components(df, model).toPandas()
    k = min(32, d)
    assert len(got) == k * len(ids) and set(got.n) == {count} and model.identity_error < 1e-9
    wide = {}
    for r in got.itertuples(index=False):
        wide.setdefault((None if math.isnan(r.vec_id) else int(r.vec_id), r.component), []).append(r)
    for c in range(k):
        one = [wide[(i, c + 1)][0] for i in ids]
        mine, theirs = np.array([r.whitened for r in one]), white[:, c]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert math.isclose(one[0].explained, share[c], rel_tol=1e-10)
        assert [r.deviation for r in one] == dev
    assert len(wide[(1, 1)]) == 3                            # repeated rows stay
    w = np.array([[r.whitened for r in got[got.component == c + 1].sort_values("vec_id").itertuples()] for c in range(k)])
    assert np.abs(np.cov(w, bias=True) - np.eye(k)).max() < 1e-9


def test_contours_find_clustered_and_repeated_eigenvalues():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    e = np.concatenate([[9.0, 9.0, 9.0, 9 - 1e-9], np.linspace(1, 1.001, 40), [1e-9] * 8, np.zeros(8)])
    m = q @ np.diag(e) @ q.T
    m = (m + m.T) / 2
    for shift in (9.5, 8.0, 0.9995, 0.5, -0.5):
        assert feast.count_above(m, shift) == (e > shift).sum()
    found = [feast.solve(m, *p) for p in feast.intervals(m, 32, 8)]
    values = np.sort(np.concatenate([v for v, _ in found]))[::-1]
    assert len(values) >= 32 and np.abs(values[:32] - np.sort(e)[::-1][:32]).max() < 1e-12
    for v, x in found:
        assert np.abs(m @ x - x * v).max() < 1e-12 and np.abs(x.T @ x - np.eye(len(v))).max() < 1e-10


def test_tables_without_components(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)] * 5, [(1, [], 0)]):
        df = spark.createDataFrame(rows, VEC)
        assert whitening.components(df, whitening.fit(df)).collect() == []


def test_large_entries(spark):
    rows = [(i, [float(i), 1e30, 0.0], 0) for i in range(5)] + [(10 + i, [float(i * i), float(i), 2.0], 0) for i in range(9)]
    df = spark.createDataFrame(rows, VEC)
    model = whitening.fit(df)
    assert model.n == 9 and len(model.values) == 2          # the constant entry has no component
    far = np.array([[OFFSET + (1 << 40)], [OFFSET - (1 << 40)]]) if (OFFSET := whitening.OFFSET) else None
    assert whitening.deviations(far, 2, far.sum(axis=0)).to_pylist() == [None, None]
