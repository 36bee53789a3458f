"""Whitening of vectors by a bidiagonal qd solver.

Nothing squares the data before its singular values are known:

1. blockwise QR: each task folds its centred rows, a block at a time, into one upper triangle; triangles are folded again,
   ``FOLD`` at a time, until one is left. A triangle has as many rows as a vector has components, whatever the table;
2. Householder reflections from both sides bring the triangle to a bidiagonal matrix;
3. differential qd with shifts (dqds) finds its singular values to high relative accuracy, the smallest first;
4. for each wanted value a twisted factorisation of the shifted tridiagonal gives the vector; vectors of close values are
   made orthogonal to one another; the reflections carry them back to whitening directions.

The fit list is each distinct vector once. Sums and deviations are exact integers, everything else is double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import arrow_rows, written
from panelkit.llm.hardneg import integer_vectors

#: Triangles folded in one task of a round.
FOLD = 16
COMPONENTS = 4
#: Directions with less variance than this part of the largest are none: the data do not spread there.
LEAST_PART = 1e-14
#: Values of joined solutions (numbers) that are broadcast at most; beyond that the join is shuffled.
BROADCAST_NUMBERS = 4_000_000
_EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------------------------------------------- bidiagonal form
def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit ``v`` and value ``a`` such that x - 2 v (v.x) = (a, 0, ..., 0)."""
    size = float(np.linalg.norm(x))
    if size == 0.0 or len(x) == 1:
        return np.zeros(len(x)), float(x[0])
    a = -size if x[0] > 0 else size
    v = x.copy()
    v[0] -= a
    return v / np.linalg.norm(v), a


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, upper diagonal and right reflectors of a square matrix: r = U B V' with V the product of reflectors,
    the k-th acting on the components after k."""
    m = r.astype(np.float64).copy()
    n = len(m)
    diagonal, upper, right = np.zeros(n), np.zeros(max(0, n - 1)), []
    for k in range(n):
        v, diagonal[k] = _reflector(m[k:, k])
        m[k:, k + 1 :] -= 2 * np.outer(v, v @ m[k:, k + 1 :])
        if k + 1 < n:
            w, upper[k] = _reflector(m[k, k + 1 :])
            m[k + 1 :, k + 1 :] -= 2 * np.outer(m[k + 1 :, k + 1 :] @ w, w)
            right.append(w)
    return diagonal, upper, right


def carried_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """V z."""
    out = z.copy()
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        out[k + 1 :] -= 2 * w * (w @ out[k + 1 :])
    return out


# ---------------------------------------------------------------------------------------------------- singular values
def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds transform: the new arrays, the last difference, and whether all differences before it are positive."""
    n = len(q)
    nq, ne, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
    fine = True
    for i in range(n - 1):
        fine = fine and d >= 0.0
        nq[i] = d + e[i]
        if nq[i] == 0.0:
            ne[i], d = 0.0, q[i + 1] - shift
            continue
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - shift
    nq[-1] = d
    return nq, ne, d, fine


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of all singular values of a bidiagonal matrix, falling, by dqds. A shift that would pass the smallest
    value is taken back; a step without shift always succeeds, so the loop ends."""
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    todo = [(list((np.asarray(diagonal) / scale) ** 2), list((np.asarray(upper) / scale) ** 2), 0.0)]
    found: list[float] = []
    tiny = _EPS * _EPS
    while todo:
        q, e, base = todo.pop()
        guess = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * (base + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                if cut == n - 2:
                    found.append(base + q[-1])
                    q, e = q[:-1], e[:-1]
                else:
                    todo.append((q[: cut + 1], e[:cut], base))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                guess = 0.0
                continue
            if q[0] < q[-1]:  # graded upwards: turned round it converges at its end
                q, e = q[::-1], e[::-1]
            shift, tries = guess, 0
            while True:
                nq, ne, d, fine = _step(q, e, shift)
                if fine and d >= 0.0:
                    break
                tries += 1
                late = shift + d  # the last difference alone failed: this is below the smallest value
                shift = 0.0 if tries > 3 else late * (1 - 4 * _EPS) if fine and 0.0 < late < shift else shift / 4
            q, e, base = nq, ne, base + shift
            # the smaller value of the last two rows, a little below: mostly a safe shift near the smallest value
            a, b, c = q[-2], e[-1], q[-1]
            half = (a + b + c) / 2
            guess = max(0.0, (a * c) / (half + np.sqrt(max(0.0, half * half - a * c)))) * (1 - 1e-3) if half > 0 else 0.0
            if b > 0.1 * c:
                guess *= 0.5
    return np.sort(np.array(found))[::-1] * scale * scale


# ---------------------------------------------------------------------------------------------------- vectors
def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, near: list[np.ndarray]) -> np.ndarray:
    """Unit vector z with B'B z = value z: the stationary and the progressive factorisation of B'B - value meet at the row
    where what is left is least. ``near`` holds the vectors of close values; z is made orthogonal to them."""
    n = len(diagonal)
    top = float(max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0)))
    a = np.where(np.abs(diagonal) < _EPS * top, _EPS * top, diagonal)
    big, low = a * a, (upper / a[:-1] if n > 1 else np.zeros(0))
    least = _EPS * _EPS * top * top
    safe = lambda x: x if abs(x) > least else (least if x >= 0 else -least)
    s, p = np.zeros(n), np.zeros(n)
    down, up = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):
        plus = safe(s[i] + big[i])
        down[i] = low[i] * big[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = big[-1] - value
    for i in range(n - 2, -1, -1):
        minus = safe(big[i] * low[i] * low[i] + p[i + 1])
        t = big[i] / minus
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    left = np.abs(s + p + value)
    for k in np.argsort(left, kind="stable"):
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = np.abs(z).max()
        if not np.isfinite(size):
            continue
        z /= size
        z /= np.linalg.norm(z)
        for _ in range(2):
            for v in near:
                z -= v * (v @ z)
        size = float(np.linalg.norm(z))
        if size > 0.1:  # else this twist repeats a neighbour; another one starts elsewhere
            return z / size
    z = np.random.default_rng(n).normal(size=n)  # equal values: any direction of what is left will do
    for _ in range(2):
        for v in near:
            z -= v * (v @ z)
    return z / np.linalg.norm(z)


def solve(r: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values of ``r`` (falling) and, row by row, the right vectors of the first ``k`` that are
    not zero."""
    diagonal, upper, right = bidiagonal(r)
    values = squared_values(diagonal, upper)
    held: list[np.ndarray] = []
    for i, value in enumerate(values[:k]):
        if value <= LEAST_PART * values[0]:
            break
        # vectors of values closer than this lose digits of their angle
        near = [held[j] for j in range(i) if values[j] - value <= 1e-3 * values[0]]
        held.append(twisted(diagonal, upper, float(value), near))
    return values, np.array([carried_back(z, right) for z in held]).reshape(len(held), len(r))


# ---------------------------------------------------------------------------------------------------- blockwise QR
def fold(triangle: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: type = np.int64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), dim)


def _triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's triangle of each length: rows hold x, the sums S and the number n of their fit list."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            mean = np.array([float(v) for v in part.column("sums")[0].as_py()]) / part.column("n")[0].as_py()
            held[dim] = fold(held.get(dim), _matrix(part.column("x"), dim, np.float64) - mean)
    from pyspark import TaskContext

    for dim, r in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["dim", "part", "r"])


def _folded(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    r = None
    for i in range(table.num_rows):
        r = fold(r, np.array(table.column("r")[i].as_py(), np.float64).reshape(-1, dim))
    return pa.table({"dim": pa.array([dim], pa.int32()), "part": table.column("fold")[:1], "r": pa.array([r.ravel()], pa.list_(pa.float64()))})


def _solved(table: pa.Table) -> pa.Table:
    dim, n = table.column("dim")[0].as_py(), table.column("n")[0].as_py()
    r = np.array(table.column("r")[0].as_py(), np.float64).reshape(-1, dim)
    r = np.vstack([r, np.zeros((max(0, dim - len(r)), dim))])  # fewer rows than components
    values, directions = solve(r)
    e = values[: len(directions)] / n
    whitening = directions / np.sqrt(e)[:, None]
    total = float(np.sum(r * r)) / n
    return pa.table({"dim": pa.array([dim], pa.int32()), "explained": pa.array([e / total if total else e], pa.list_(pa.float64())), "whitening": pa.array([whitening.ravel()], pa.list_(pa.float64()))})


# ---------------------------------------------------------------------------------------------------- the operator
def _projected(part: pa.RecordBatch, dim: int) -> np.ndarray:
    """Whitened values (row, component)."""
    mean = np.array([float(v) for v in part.column("sums")[0].as_py()]) / part.column("n")[0].as_py()
    w = np.array(part.column("whitening")[0].as_py(), np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))
    return (_matrix(part.column("x"), dim, np.float64) - mean) @ w.T


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened values and of their products in a batch: at most COMPONENTS^2 rows a length."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        rows = []
        for dim in np.unique(dims).tolist():
            w = _projected(batch.filter(pa.array(dims == dim)), dim)
            products, sums = w.T @ w, w.sum(axis=0)
            rows += [(dim, i, j, products[i, j], sums[i]) for i in range(len(sums)) for j in range(len(sums))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["dim", "i", "j", "product", "total"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over components of (n x - S)^2, exact; null where it passes 64 bits."""
    top = 2 * n * int(max(1, np.abs(x.astype(np.float64)).max(initial=1.0) + 1)) + max((abs(s) for s in sums), default=0)
    if top * top * max(1, len(sums)) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        v = sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True))
        out.append(v if v < 1 << 63 else None)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            n, sums = part.column("n")[0].as_py(), [int(v) for v in part.column("sums")[0].as_py()]
            white = _projected(part, dim)
            k = white.shape[1]
            if not k:
                continue
            deviation = _deviations(_matrix(part.column("x"), dim), n, sums)
            explained = part.column("explained")[0].as_py()
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array([n] * (m * k), pa.int64()),
                pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                pa.array(white.ravel(), pa.float64()),
                pa.array(explained * m, pa.float64()),
                pa.array(part.column("identity_error").to_pylist()[:1] * (m * k), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row of ``embeddings`` and
    each component up to the fourth.

    Rows with a null vector, or a null or non-finite component, are dropped; labels and other columns are ignored. Equal
    vectors enter the fit once and each of their rows is returned, repeated rows too; null ids stay null. Vectors of
    different lengths have fits of their own. A fit has as many components as directions in which its vectors spread, so
    a single vector, equal vectors and empty vectors have no rows. ``deviation`` is null where it passes 64 bits. An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 4096)
    rows = integer_vectors(vectors).select("vec_id", "x", F.size("x").alias("dim"))
    fit = written(rows.groupBy("dim", "x").agg(F.lit(1).alias("one")).select("dim", "x"), "fit-list")
    sums = fit.select("dim", F.posexplode("x").alias("place", "v")).groupBy("dim", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = written(sums.groupBy("dim").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda p: p["s"]).alias("sums")), "fit-sums")

    def bounded(table: DataFrame) -> DataFrame:
        """One row a length: broadcast while its numbers are few."""
        numbers = table.agg(F.coalesce(F.sum("dim"), F.lit(0)).alias("n")).first()["n"] * (2 + COMPONENTS)
        return F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table

    triangles = written(fit.join(bounded(sums), "dim").mapInArrow(_triangles, "dim int, part long, r array<double>"), "triangles")
    most = triangles.groupBy("dim").count().agg(F.max("count").alias("m")).first()["m"] or 0
    while most > 1:
        ranked = triangles.withColumn("fold", F.floor(F.col("part") / FOLD))
        triangles = written(ranked.groupBy("dim", "fold").applyInArrow(_folded, "dim int, part long, r array<double>"), "triangles")
        most = triangles.groupBy("dim").count().agg(F.max("count").alias("m")).first()["m"] or 0
    solutions = written(triangles.join(sums, "dim").groupBy("dim").applyInArrow(_solved, "dim int, explained array<double>, whitening array<double>"), "whitening").join(sums, "dim")
    moments = fit.join(bounded(solutions), "dim").mapInArrow(_moments, "dim int, i int, j int, product double, total double")
    moments = moments.groupBy("dim", "i", "j").agg(F.sum("product").alias("product"), F.sum("total").alias("total"))
    means = moments.where("i = j").select("dim", F.col("i").alias("j"), F.col("total").alias("other"))
    gap = F.abs(F.col("product") / F.col("n") - F.col("total") / F.col("n") * F.col("other") / F.col("n") - (F.col("i") == F.col("j")).cast("double"))
    error = moments.join(means, ["dim", "j"]).join(sums.select("dim", "n"), "dim").groupBy("dim").agg(F.max(gap).alias("identity_error"))
    solutions = written(solutions.join(error, "dim"), "whitening")
    return rows.join(bounded(solutions), "dim").mapInArrow(_rows, _OUT)
