"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from panelkit.llm import hardneg
from panelkit.llm.hardneg import Mining, bounds, emitted, pack, scores, unpack
from panelkit.llm.queries import QUERIES


def brute(rows):
    """Rows of the contract for unique ids."""
    used = []
    for vec, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if vec is not None and vec % 7 == 0 else label
        used.append((vec, [math.floor(256 * float(np.float32(c))) for c in v], label))
    out = []
    for vec, v, label in used:
        if vec is None or vec % 50:
            continue
        near = [(-sum(a * b for a, b in zip(v, w, strict=True)), other is None, other or 0, other, k) for other, w, k in used if other != vec and len(w) == len(v)]
        near.sort(key=lambda t: t[:3])
        for ps, _, _, pos, _ in [t for t in near if t[4] == label][:5]:
            hits = [t for t in near if t[4] != label and 50 * -ps <= 100 * -t[0] <= 95 * -ps][:3]
            out += [(vec, pos, rank + 1, t[3], -ps, -t[0]) for rank, t in enumerate(hits)]
    return sorted(out, key=str)


def make(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)


def run(frame):
    return sorted((tuple(r) for r in hardneg.hard_negatives(frame).collect()), key=str)


def vectors(n, dim=6, seed=3, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim) * 2
    return [(i, (rng.normal(size=dim) + centre).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_mined(spark):
    rows = vectors(600)
    want = brute(rows)
    assert len(want) > 100
    assert run(make(spark, rows)) == want


def test_small_blocks_and_stretches(spark, monkeypatch):
    rows = vectors(500, dim=4)
    monkeypatch.setattr(hardneg, "BLOCK_NUMBERS", 1)  # 64 rows a block
    monkeypatch.setattr(hardneg, "STRETCH", 2)
    assert run(make(spark, rows)) == brute(rows)


def test_ties(spark):
    """Few values: most scores are equal and ids decide."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(0, 2)) for _ in range(2)], rng.randint(0, 2)) for i in range(300)]
    assert run(make(spark, rows)) == brute(rows)


def test_one_vector_holds_a_third(spark):
    rows = [(i, [1.0, 0.9] if i % 3 else [0.1 * (i % 11), 1.0], 1 if i % 2 else 2) for i in range(300)]
    assert run(make(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    nan = float("nan")
    rows = vectors(160, dim=3)
    rows += [(200, None, 1), (250, [1.0, None, 2.0], 1), (300, [nan, 1.0, 1.0], 1), (350, [1.0, 1.0, 1.0], None), (None, [2.0, 2.0, 2.0], 1), (400, [], 1), (401, [], 2), (450, [5.0], 3), (-50, [1.0, 2.0, 1.5], 2), (-7, [1.0, 2.0, 1.0], 9)]
    assert run(make(spark, rows)) == brute(rows)


def test_zero_and_negative_scores(spark):
    rows = [(50, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 2.0], 2), (4, [-0.7, 0.0], 2), (0, [0.0, -1.0], 2)]
    want = brute(rows)
    assert any(r[4] == 0 for r in want)
    assert run(make(spark, rows)) == want


def test_repeated_rows_count_once(spark):
    rows = vectors(200)
    assert run(make(spark, rows + rows[::3])) == brute(rows)


def test_one_id_with_two_vectors(spark):
    rows = [(50, [1.0], 1), (50, [2.0], 1), (1, [3.0], 1), (2, [2.0], 2)]
    got = run(make(spark, rows))
    assert {r[0] for r in got} == {50} and len(got) >= 2


def test_empty_and_anchorless_tables(spark):
    assert run(make(spark, [], 1)) == []
    assert run(make(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert run(make(spark, [(50, [1.0], 1), (2, [1.0], 2)])) == []


def test_extra_columns(spark):
    rows = vectors(120)
    frame = spark.createDataFrame([(i, v, k, 1, "x", 2.0) for i, v, k in rows], "vec_id long, embedding array<float>, label int, row int, block string, x double")
    assert run(frame) == brute(rows)


def test_long_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i * 25, (rng.normal(size=20_000) + 1).astype(np.float32).tolist(), i % 2) for i in range(12)]
    assert run(make(spark, rows)) == brute(rows)


@given(a=st.tuples(st.integers(0, 2**40), st.integers(-(2**63), 2**63 - 1), st.booleans(), st.integers(0, 2**40)), b=st.tuples(st.integers(0, 2**40), st.integers(-(2**63), 2**63 - 1), st.booleans(), st.integers(0, 2**40)))
def test_keys_sort_like_their_fields(a, b):
    def order(t):
        return (t[0], -t[1], t[2], t[3])

    assert unpack(pack(*a)) == a
    assert (pack(*a) < pack(*b)) == (order(a) < order(b))


@given(st.integers(-1000, 1000), st.integers(-1000, 1000))
def test_bounds(ps, ns):
    low, high = bounds(ps, Mining())
    assert (low <= ns <= high) == (50 * ps <= 100 * ns <= 95 * ps)


def test_the_iterator_holds_windows_only():
    """A generator of any length runs through; only windows are kept."""

    def pairs():
        yield pack(1, 10**6, False, 7), (50, 7, 1, 1)
        for i in range(200_000):
            yield pack(1, 10**6 - 1 - i, True, i), (50, i, 1, 1)

    got = list(emitted(pairs(), Mining()))
    assert [r[3] for r in got] == [49_999, 50_000, 50_001]


@pytest.mark.parametrize("size", [100, 1 << 24, 1 << 28, 1 << 45])
def test_scores_are_exact(size):
    rng = np.random.default_rng(0)
    a, x = rng.integers(-size, size, (3, 5)), rng.integers(-size, size, (7, 5))
    want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(p) * int(q) for p, q in zip(r, c, strict=True)))) for c in x] for r in a]
    got = scores(a, x)
    assert [[int(v) for v in r] for r in got] == want


def test_registered_query(spark, table_dir):
    rows = vectors(200)
    d = table_dir(embeddings=make(spark, rows))
    assert sorted((tuple(r) for r in QUERIES["op13_hard_negatives"](spark, d).collect()), key=str) == brute(rows)
