"""SimHash against a direct computation and all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelkit.llm import simhash
from panelkit.llm.graph import connected_components
from panelkit.llm.queries import QUERIES


def direct(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, radius):
    """Smallest index reachable, by all pairs."""
    prints = np.array(prints, np.uint64)
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint(monkeypatch):
    rng = random.Random(0)
    texts = [None, "", " \t\x0b", "One", "one TWO", "a b c", "É é x \x1c y"] + [" ".join(rng.choice(["a", "Bc", "d\n", "é"]) for _ in range(n)) for n in range(40)]
    want = [direct(t) for t in texts]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == want
    monkeypatch.setattr(simhash, "_HASHES", 5)
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == want


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_comparison(radius, monkeypatch):
    monkeypatch.setattr(simhash, "_CELLS", 50)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    prints = np.array([b ^ sum(np.uint64(1) << np.uint64(x) for x in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(60)], np.uint64)
    end = np.repeat([150, 151, 290, 360], [150, 1, 139, 70])
    got = {(int(a), int(b)) for i, j in simhash.near(prints, end, radius) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(360) for j in range(i + 1, end[i]) if int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert got == want and want


@pytest.mark.parametrize("block", [4096, 7])
def test_components_of_fingerprints(spark, block):
    """Blocks of a small size deal buckets over a grid; nothing is lost."""
    rng = random.Random(block)
    prints = []
    for _ in range(8):
        p = rng.getrandbits(64)
        for _ in range(30):
            prints.append(p)
            p ^= 1 << rng.randrange(64) if rng.random() < 0.7 else rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)
    prints += [0, 1, 2**64 - 1, 2**63]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    root = {r.node % 2**64: r.root % 2**64 for r in simhash.fingerprint_components(df, 3, block).collect()}
    want = groups(prints, 3)
    same = {}
    for p, g in zip(prints, want, strict=True):
        assert same.setdefault(g, root.get(p, p)) == root.get(p, p)
    assert len(set(same.values())) == len(set(want))


def check(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [direct(t) for _, t in rows]
    roots = groups(prints, 3)
    want = sorted(((i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


ROWS = [(9, "the cat sat on the mat"), (4, "The CAT sat  on the mat"), (7, None), (6, ""), (None, "the cat sat on the mat"), (4, "The CAT sat  on the mat"), (None, "alone words here"), (3, "w " * 9000), (2, "one")]


def test_simhash_groups(spark, docs):
    df = docs(ROWS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(-1)).withColumn("root", F.lit(2))
    check(simhash.simhash_groups(df).collect(), ROWS)
    assert simhash.simhash_groups(docs([])).count() == 0


def test_keep_one_each(spark, docs):
    df = docs(ROWS).withColumn("fp", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3))
    kept = simhash.keep_one_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 2, 3, 4, 6]
    assert simhash.keep_one_each(docs([])).count() == 0


def test_query_on_a_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op3_simhash"](spark, d).collect(), rows)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 199), (199, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 160)} | {200: 199}
