"""Vector links against brute force in double precision."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import embeddings
from panelkit.llm.hnsw import Graph
from panelkit.llm.queries import QUERIES


def brute(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs of a label."""
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        unit[i] = np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = {}
    for i in unit:
        groups.setdefault((rows[i][2], len(unit[i])), []).append(i)
    for members in groups.values():
        m = np.stack([unit[i] for i in members])
        for a, i in enumerate(members):
            for b in np.flatnonzero(m @ m[a] >= threshold):
                if b != a:
                    links[i] += 1
                    x, y = find(i), find(members[b])
                    root[max(x, y)] = min(x, y)
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(vec, least.get(find(i), vec))
    return [(vec, links[i], least.get(find(i)), vec == least.get(find(i))) for i, (vec, _, _) in enumerate(rows)]


def vectors(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i % 4 == 1:
            v = np.asarray(out[i - 1]) + rng.normal(size=dim) * 0.05
        elif i % 10 == 7:
            v = np.asarray(out[i // 2])
        out.append(v.astype(np.float32).tolist())
    return out


def make(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumn("node", F.lit("clash")).withColumn("n_links", F.lit(-1)).withColumn("shard", F.lit(1.5))


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1), (905, [None] + [1.0] * 15, 1), (906, [1.0] * 3, 1), (907, [2.0] * 3, 1), (908, [1.0] * 16, None), (909, [1.0] * 16, None), (None, [5.0] * 16, 2), (None, [1.0, 9.0] * 8, 4)]


@pytest.mark.parametrize("numbers", [2_000_000, 800])
def test_links(spark, numbers, monkeypatch):
    """One shard a label, and many."""
    monkeypatch.setattr(embeddings, "SHARD_NUMBERS", numbers)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(400, 1))] + ODD
    rows += [rows[5], rows[5], (77, rows[8][1], rows[8][2]), (-3, [1.0] * 16, 2)] + [(2000 + i, [1.0] * 15 + [0.9], 1) for i in range(60)]
    got = sorted(map(tuple, embeddings.linked_vectors(make(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty(spark):
    assert embeddings.linked_vectors(make(spark, [])).count() == 0
    assert [tuple(r) for r in embeddings.linked_vectors(make(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]


def shard(v, seed=0):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return {"unit": unit, "graph": Graph.build(unit.astype(np.float32)), "copies": np.random.default_rng(seed).integers(1, 4, len(v))}


def test_dense_clouds_are_exact():
    """Beams widen past a cloud; a cloud above the bound on pairs is counted by brute force."""
    rng = np.random.default_rng(3)
    v = np.concatenate([np.ones((150, 8)) + rng.normal(size=(150, 8)) * 0.02, rng.normal(size=(200, 8))])
    s, t = shard(v), shard(v[::2] * 2, 1)
    for b in (None, t):
        both = np.concatenate([s["unit"], [] if b is None else b["unit"]]) if b is not None else s["unit"]
        copies = np.concatenate([s["copies"], b["copies"]]) if b is not None else s["copies"]
        adj = both @ both.T >= 0.98
        if b is None:
            np.fill_diagonal(adj, False)
        else:
            adj[: len(v), : len(v)] = adj[len(v) :, len(v) :] = False
        for most in (10**9, 50):
            links, _, label, seen = embeddings.link_shards(s, b, most=most)
            assert ("brute" in seen) == (most == 50)
            assert links.tolist() == (adj * copies).sum(axis=1).tolist()
            i, j = np.nonzero(adj)
            assert (label[i] == label[j]).all()


def test_only_audited_queries_are_searched_where_blocks_are_cheaper(monkeypatch):
    """Vectors without near neighbours need wide beams; the beams are tried on the audit, then blocks compare all."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(4000, 200))
    v[1::40] = v[0::40] + rng.normal(size=v[1::40].shape) * 0.1
    v = v[rng.permutation(4000)]
    s, t = shard(v[:2500]), shard(v[2500:], 1)
    searched, search = [], Graph.search
    monkeypatch.setattr(Graph, "search", lambda graph, queries, beam: searched.append(len(queries)) or search(graph, queries, beam))
    for a, b in ((s, None), (s, t)):
        searched.clear()
        both = a["unit"] if b is None else np.concatenate([a["unit"], b["unit"]])
        copies = a["copies"] if b is None else np.concatenate([a["copies"], b["copies"]])
        adj = both @ both.T >= 0.98
        if b is None:
            np.fill_diagonal(adj, False)
        else:
            adj[:2500, :2500] = adj[2500:, 2500:] = False
        links, _, label, seen = embeddings.link_shards(a, b)
        assert adj.any() and links.tolist() == (adj * copies).sum(axis=1).tolist()
        assert (label[np.nonzero(adj)[0]] == label[np.nonzero(adj)[1]]).all()
        assert seen["recall"] == 1 and sum(searched) == embeddings.AUDIT


def test_pairs_near_the_threshold_are_settled_in_double_precision():
    """Cosines a hair above and below the threshold, far closer than single precision can tell."""
    cosines = 0.98 + np.array([-1e-3, -1e-10, 1e-10, 1e-3])
    a = np.stack([cosines, np.sqrt(1 - cosines**2)], axis=1)
    b = np.array([[1.0, 0.0]])
    found = [(i, j) for r, c in embeddings._true_links(a, b, 0.98, False) for i, j in zip(r.tolist(), c.tolist(), strict=True)]
    assert found == [(2, 0), (3, 0)]


def test_graph_recall():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph.build(v)
    ids, _ = graph.search(v, 32)
    assert (ids == np.arange(3000)[:, None]).any(axis=1).mean() > 0.97  # every vector is indexed and reached
    sims = v @ v.T
    np.fill_diagonal(sims, -1)
    assert (ids == sims.argmax(axis=1)[:, None]).any(axis=1).mean() > 0.9


def test_recall_on_a_table(spark, table_dir):
    """The given vectors with jittered copies of some, at production parameters."""
    rng = np.random.default_rng(9)
    base = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if r.embedding is not None]
    rows = base + [(10**6 + k * 10**5 + i, (np.asarray(v) + rng.normal(size=len(v)) * 0.015).tolist(), label) for k in range(3) for i, v, label in base[::9]]
    d = table_dir(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = {r[0]: r for r in brute(rows)}
    got = {r.vec_id: tuple(r) for r in QUERIES["op7_embedding_dedup"](spark, d).collect()}
    true, found = sum(r[1] for r in want.values()), sum(r[1] for r in got.values())
    assert true > 1000 and 0.99 * true <= found <= true
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200, 0.0], 1), (2, [1e-200, 1e-200, 0.0], 1), (3, [0.0, 0.0, 1e300], 1), (4, [1.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.linked_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}
