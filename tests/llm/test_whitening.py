import numpy as np
import pytest

from tessera.llm import whitening as w
from tessera.llm.common import documents
from tests.llm.conftest import SF

NAMES = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(vectors, wanted=16):
    """(x, n, S, variances, components) with numpy over all rows."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1][:wanted], v[:, ::-1][:, :wanted], e.sum()


def compare(rows, ids, vectors, tolerance=1e-7):
    x, n, s, e, v, trace = brute(vectors)
    by = {(r[0], r.component): r for r in rows}
    m = len(e)
    assert len(by) == len(rows) == len(ids) * m
    got = np.array([[by[i, k + 1].whitened for k in range(m)] for i in ids])
    want = ((x * n - s) / n) @ v / np.sqrt(e)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < tolerance
    for i, row in zip(ids, x):
        r = by[i, 1]
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))
    assert all(abs(by[ids[0], k + 1].explained / (e[k] / trace) - 1) < 1e-10 for k in range(m))
    assert max(r.identity_error for r in rows) < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_query_matches_brute_force(spark):
    df = w.op13_whitening(spark, SF)
    assert df.columns == ["vec_id", *NAMES] and [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    good = [(r.vec_id, r.embedding) for r in documents(spark, SF, "embeddings").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    compare(df.collect(), [i for i, _ in good], [v for _, v in good])


class Local(w.Fit):
    """A fit over rows in memory, in three blocks."""

    def __init__(self, x):
        self.x, self.dim, self.n, self.passes = x, x.shape[1], len(x), 0
        self.centre = w.Centre(len(x), [int(s) for s in x.sum(axis=0)])

    def _added(self, of, kind):
        self.passes += 1
        return sum(of(x) for x in np.array_split(self.x, 3)).tolist()


def residual(x, values, parts):
    c = x - x.mean(axis=0)
    return np.abs(c.T @ (c @ parts) / len(x) - parts * values).max() / values[0]


@pytest.mark.parametrize("decay", [1.0, 0.9, 0.5])
def test_spectra(decay):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    x = np.round(rng.standard_normal((3000, 40)) * 1e6 * decay ** np.arange(40) @ q).astype(np.int64)
    values, parts = w.components(Local(x), 16)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:16] ** 2 / len(x)
    assert np.allclose(values, want, rtol=1e-9, atol=0) and np.abs(parts.T @ parts - np.eye(16)).max() < 1e-12 and residual(x, values, parts) < 1e-12


def test_few_steps_where_values_fall_fast():
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((2000, 300)) * np.where(np.arange(300) < 20, 1e6 * 0.7 ** np.arange(300), 1.0)).astype(np.int64)
    fit = Local(x)
    values, parts = w.components(fit, 8)
    assert fit.passes < 100 and residual(x, values, parts) < 1e-12
    assert np.allclose(values, np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:8] ** 2 / len(x), rtol=1e-9)


def test_equal_variances_and_missing_ranks():
    corners = np.array([[a, b, c, 0, 0, 7] for a in (-5, 5) for b in (-5, 5) for c in (-2, 2)], dtype=np.int64)
    values, parts = w.components(Local(corners), 16)
    assert np.allclose(values, [25, 25, 4]) and np.abs(parts.T @ parts - np.eye(3)).max() < 1e-12 and residual(corners, values, parts) < 1e-12
    assert w.components(Local(corners[:1]), 16)[0].size == 0
    line = np.outer(np.arange(10), [1, 2, 3]).astype(np.int64)
    assert np.allclose(w.components(Local(line), 16)[0], [8.25 * 14])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(7)
    some = [[float(c) for c in v] for v in rng.standard_normal((60, 3))]
    rows = [(i, v, "x", 1.0) for i, v in enumerate(some)] + [
        (100, None, "x", 1.0), (101, [], "x", 1.0), (102, [1.0, None, 2.0], "x", 1.0), (103, [nan, 0.0, 0.0], "x", 1.0), (104, [0.0, -inf, 0.0], "x", 1.0), (105, [1e300, 0.0, 0.0], "x", 1.0),
        (0, some[0], "x", 1.0), (None, some[1], "x", 1.0), (200, [1.0, 2.0], "x", 1.0), (201, [2.0, 1.0], "x", 1.0), (202, [5.0], "x", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, whitened double")
    got = w.whitening(df).collect()
    count = {}
    for r in got:
        count[r.vec_id] = count.get(r.vec_id, 0) + 1
    assert count == {**{i: 3 for i in range(1, 60)}, 0: 6, None: 3, 200: 1, 201: 1}
    own = {(r.vec_id, r.component): r for r in got}
    assert all(own[None, k].whitened == own[1, k].whitened and own[1, k].n == 60 for k in (1, 2, 3)) and own[200, 1].n == 2
    assert abs(abs(own[200, 1].whitened) - 1) < 1e-12 and own[200, 1].whitened == -own[201, 1].whitened
    nothing = w.whitening(df.limit(0))
    assert nothing.columns == ["vec_id", *NAMES] and nothing.count() == 0


def test_deviations_are_exact_or_null():
    c = w.Centre(3, [3_000_001, 5])
    assert c.deviations(np.array([[1_000_000, 2], [10**9, -(10**9)], [1 << 50, 0]])) == [(3 * 10**6 - 3_000_001) ** 2 + 1, (3 * 10**9 - 3_000_001) ** 2 + (3 * 10**9 + 5) ** 2 if (3 * 10**9 - 3_000_001) ** 2 + (3 * 10**9 + 5) ** 2 < 1 << 63 else None, None]
