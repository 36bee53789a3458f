"""The solver against LAPACK, the operator against a brute-force fit."""

import math

import numpy as np
import pytest

from panelkit.llm import whitening
from panelkit.llm.queries import QUERIES
from panelkit.llm.whitening import bidiagonal, carried_back, fold, solve, squared_values

RNG = np.random.default_rng(5)
WILKINSON = np.linalg.cholesky(np.diag(np.abs(np.arange(-10, 11)) + 3.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T
CASES = {
    "random": RNG.normal(size=(200, 48)),
    "graded": RNG.normal(size=(200, 40)) * 10.0 ** -np.arange(40),
    "graded upwards": RNG.normal(size=(200, 40)) * 10.0 ** (np.arange(40) / 2 - 20),
    "identity": np.eye(30),
    "equal values": np.linalg.qr(RNG.normal(size=(100, 30)))[0],
    "close values": np.linalg.qr(RNG.normal(size=(100, 30)))[0] * np.r_[1 + 1e-9 * np.arange(4), np.full(26, 0.5)],
    "pairs": WILKINSON,
    "dependent columns": RNG.normal(size=(100, 8)) @ RNG.normal(size=(8, 20)),
    "one column": np.ones((5, 1)),
    "huge": RNG.normal(size=(60, 10)) * 1e150,
    "tiny": RNG.normal(size=(60, 10)) * 1e-150,
}


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    a = CASES[name]
    values, v = solve(np.linalg.qr(a, mode="r"))
    scale = np.abs(a).max()
    want = np.linalg.svd(a / scale, compute_uv=False) ** 2
    got = values / scale / scale
    assert np.allclose(got[: len(v)], want[: len(v)], rtol=1e-12, atol=0)
    assert np.allclose(got, want, rtol=0, atol=1e-13 * want[0])
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-10)
    b = a / scale
    for value, row in zip(got, v, strict=False):
        assert np.linalg.norm(b.T @ (b @ row) - value * row) <= 1e-12 * want[0]


def test_graded_values_keep_their_digits():
    """The small singular values of a graded bidiagonal matrix have full relative accuracy, which squaring would lose."""
    d, e = 10.0 ** -np.arange(12.0), 0.5 * 10.0 ** -np.arange(11.0) * 1e-3
    got = np.sqrt(squared_values(d, e))
    # the exact determinant: product of the diagonal
    assert math.isclose(np.prod(got * 10.0 ** np.arange(12.0)), 1.0, rel_tol=1e-13)
    assert math.isclose(got[-1], 1e-11, rel_tol=1e-5)


def test_bidiagonal_form():
    r = np.linalg.qr(RNG.normal(size=(50, 12)), mode="r")
    d, e, right = bidiagonal(r)
    b = np.diag(d) + np.diag(e, 1)
    v = np.array([carried_back(z, right) for z in np.eye(12)]).T
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-13)
    assert np.allclose(v @ (b.T @ b) @ v.T, r.T @ r, atol=1e-12)


def test_blocks_fold_to_the_same_triangle():
    a = RNG.normal(size=(500, 9))
    r = None
    for i in range(0, 500, 37):
        r = fold(r, a[i : i + 37])
    assert np.allclose(r.T @ r, a.T @ a)


def brute(rows, k=4):
    used = [(i, np.floor(256 * np.asarray(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in used}:
        mine = [(i, x) for i, x in used if len(x) == dim]
        fit = np.unique(np.stack([x for _, x in mine]), axis=0) if dim else np.zeros((1, 0), np.int64)
        n, s = len(fit), fit.sum(axis=0)
        c = (fit - s / n).T @ (fit - s / n) / n
        e, v = np.linalg.eigh(c) if dim else (np.zeros(0), np.zeros((0, 0)))
        order = [j for j in np.argsort(-e)[:k] if e[j] > 1e-12 * max(e.max(), 1e-300)]
        for i, x in mine:
            dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
            for place, j in enumerate(order):
                out.setdefault((i, place + 1), []).append((n, dev, float((x - s / n) @ v[:, j] / math.sqrt(e[j])), float(e[j] / np.trace(c))))
    return out


def check(frame, rows):
    want, got = brute(rows), {}
    for r in whitening.whitened(frame).collect():
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained, r.identity_error))
    assert set(got) == set(want)
    for place in {c for _, c in want}:
        signs = {}  # of each fit
        for key in (k for k in want if k[1] == place):
            a, b = sorted(got[key], key=lambda t: abs(t[2])), sorted(want[key], key=lambda t: abs(t[2]))
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                assert x[:2] == y[:2] and math.isclose(x[3], y[3], rel_tol=1e-9) and 0 <= x[4] <= 1e-9
                assert math.isclose(abs(x[2]), abs(y[2]), rel_tol=1e-7, abs_tol=1e-7)
                if abs(y[2]) > 1e-3:
                    turned = math.copysign(1.0, x[2] * y[2])
                    assert signs.setdefault(y[0], turned) == turned


def make(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(parts)


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dim) * (1 + np.arange(dim))).astype(np.float32).tolist()) for i in range(n)]


def test_whitened(spark):
    rows = vectors(300, 8) + [(900 + i, v) for i, v in vectors(40, 8)]  # copies fit once and are all returned
    check(make(spark, rows, 5), rows)


def test_odd_rows(spark):
    nan = float("nan")
    rows = vectors(30, 5) + [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [nan] * 5), (103, [math.inf] * 5), (104, []), (105, [0.0] * 5), (105, [0.0] * 5), (None, [1.0] * 5)]
    rows[4] = (4, [0.0, 1.0, -0.0, 2.0, 0.5])
    check(make(spark, [r for r in rows]), [r for r in rows])


def test_lengths_have_their_own_fits(spark):
    rows = vectors(40, 3) + [(100 + i, v) for i, v in vectors(50, 6, 2)] + [(300 + i, v) for i, v in vectors(4, 2, 3)]
    check(make(spark, rows), rows)


def test_no_spread(spark):
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        assert whitening.whitened(make(spark, rows, 1)).count() == 0
    assert whitening.whitened(make(spark, [], 1)).count() == 0


def test_fewer_rows_than_components(spark):
    rows = vectors(3, 10)
    check(make(spark, rows), rows)  # two directions


def test_large_numbers_are_exact(spark):
    rows = [(i, [1e6 * i * i, -3e6 * i, 7.0]) for i in range(60)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(make(spark, rows)).where("component = 1").collect()}
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((60 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert got == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}
    assert whitening.whitened(make(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0])])).count() > 0  # beyond 64 bits: cut, no crash


def test_many_tasks_fold_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FOLD", 2)
    rows = vectors(400, 4)
    check(make(spark, rows, 8), rows)


def test_registered_query(spark, table_dir):
    rows = vectors(60, 6)
    d = table_dir(embeddings=make(spark, rows))
    assert QUERIES["op12_whitening"](spark, d).count() == 240
