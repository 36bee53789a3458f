"""Near-duplicate vectors through navigable small-world graphs, one for each shard.

Equal vectors of a label collapse first. The distinct vectors of a label (and length) are dealt by hash into shards of
bounded size; a task builds each shard's graph and stores it in the shared folder. Every vector then queries every shard
of its label: one task for each pair of shards searches both ways. Audited queries alone are searched first, by beams that
start narrow and widen until

* no query's beam is filled with links alone, and
* an audit by brute force (``AUDIT`` queries of the pair, drawn by hash) finds at least ``LEAST_RECALL`` of the true
  links and ``LEAST_NEAREST`` of the nearest neighbours (``LEAST_NEAREST_FEW`` where it sees few links);

then all queries are searched at that beam. Where blocks of products cost less than the beam that the audit asks for
(``BLOCKS_FOR_BEAM``), the two shards are compared in blocks, once for both ways and exactly. A beam that links still fill at
``SETTLE_BEAM`` is widened to the whole shard, which is brute force, so the loop ends. Pairs found are verified by cosine in
double precision.
A pair of shards with more than ``MOST_PAIRS`` links (a dense cloud) is counted by brute force in blocks instead, which
holds no pairs. Tasks return each vector's number of links and the stars of local components, never pairs; Spark adds the
numbers up and unites the components.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import arrow_rows, col, written
from panelkit.llm.graph import connected_components
from panelkit.llm.hnsw import Graph
from panelkit.llm.simhash import _unite

THRESHOLD = 0.98
#: Numbers (vectors times length) that a shard holds at most, about 8 MB.
SHARD_NUMBERS = 2_000_000
FIRST_BEAM = 24
#: A query whose beam is still filled with links at this width is widened to the whole shard.
SETTLE_BEAM = 4 * FIRST_BEAM
AUDIT, LEAST_RECALL, LEAST_NEAREST = 256, 0.99, 0.8
#: With fewer true links than this in the audit, that part of the nearest neighbours must be found instead.
FEW_LINKS, LEAST_NEAREST_FEW = 30, 0.95
#: In the time that a search takes for each place of its beam, blocks compare a query with some so many vectors (one core:
#: 31,250 vectors of length 64 searched 31,250 in 7 s at a beam of 24, compared both ways in 4.7 s).
BLOCKS_FOR_BEAM = 2000
MOST_PAIRS = 5_000_000
#: Float32 similarities this far below the threshold are still verified.
_SLACK = 1e-4


def _true_links(a: np.ndarray, b: np.ndarray, threshold: float, skip: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row of a, row of b) with cosine at least ``threshold``, by blocks; with ``skip`` only row a < row b.
    Products are taken in single precision, those near the threshold again in double."""
    low_a, low_b = a.astype(np.float32), b.astype(np.float32)
    step = max(1, (1 << 23) // max(1, len(b)))
    for i in range(0, len(a), step):
        first = i if skip else 0
        s = (low_a[i : i + step] @ low_b[first:].T).ravel()
        place = np.flatnonzero(s >= np.float32(threshold - _SLACK))
        keep = s[place] >= np.float32(threshold + _SLACK)
        r, c = np.divmod(place, max(1, len(b) - first))
        r, c = r + i, c + first
        near = np.flatnonzero(~keep)
        for k in range(0, len(near), 1 << 16):
            part = near[k : k + (1 << 16)]
            keep[part] = np.einsum("ij,ij->i", a[r[part]], b[c[part]]) >= threshold
        if skip:
            keep &= r < c
        yield r[keep], c[keep]


def _audited_beam(graph: Graph, unit: np.ndarray, queries: np.ndarray, low: np.ndarray, threshold: float, own: bool) -> dict:
    """The narrowest beam that passes the audit and what the audit saw; ``blocks`` is 1 where blocks are cheaper than that
    beam. Only the audited queries are searched."""
    n, total = len(unit), len(queries)
    rng = np.random.default_rng(total)
    audit = np.sort(rng.choice(total, min(AUDIT, total), replace=False))
    sims = queries[audit] @ unit.T
    if own:
        sims[np.arange(len(audit)), audit] = -np.inf
    true_r, true_c = np.nonzero(sims >= threshold)
    nearest = sims.argmax(axis=1)
    beam = min(FIRST_BEAM, n)
    while True:
        ids, s = graph.search(low[audit], beam)
        ok = (ids >= 0) & (s >= threshold - _SLACK)
        r, k = np.nonzero(ok)
        nodes = ids[r, k].astype(np.int64)
        right = np.einsum("ij,ij->i", queries[audit[r]], unit[nodes]) >= threshold
        settled = (ok.sum(axis=1) < beam)[true_r]  # links of filled beams are still to come
        want = true_r[settled] * n + true_c[settled]
        recall = float(np.isin(want, (r * n + nodes)[right]).mean()) if len(want) else 1.0
        found = float((ids == nearest[:, None]).any(axis=1).mean()) if total else 1.0
        seen = {"beam": beam, "recall": recall, "nearest": found, "first_full": 0, "blocks": 0}
        nearest_asked = LEAST_NEAREST if len(want) >= FEW_LINKS else LEAST_NEAREST_FEW
        if beam >= n or (recall >= LEAST_RECALL and found >= nearest_asked):
            return seen
        beam = min(2 * beam, n)
        if n <= BLOCKS_FOR_BEAM * beam:
            return {"beam": n, "recall": 1.0, "nearest": 1.0, "first_full": 0, "blocks": 1}


def _found_links(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, own: bool, most: int) -> tuple[np.ndarray, np.ndarray, dict] | None:
    """Verified links (query row, node) of all ``queries`` (unit vectors in double), at the beam that passes the audit or
    in blocks (with ``own`` each link once); None when there are more than ``most``."""
    n, total = len(unit), len(queries)
    low = queries.astype(np.float32)
    seen = _audited_beam(graph, unit, queries, low, threshold, own)
    held_r: list[np.ndarray] = []
    held_c: list[np.ndarray] = []
    if seen["blocks"]:
        count = 0
        for r, c in _true_links(queries, unit, threshold, own):
            held_r.append(r)
            held_c.append(c)
            count += len(r)
            if count > most:
                return None
        return np.concatenate(held_r), np.concatenate(held_c), seen
    todo, beam = np.arange(total), seen["beam"]
    while True:
        full_rows = []
        links_r, links_c = [], []
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            ids, s = graph.search(low[part], beam)
            ok = (ids >= 0) & (s >= threshold - _SLACK)
            r, k = np.nonzero(ok)
            rows, nodes = part[r], ids[r, k]
            right = np.einsum("ij,ij->i", queries[rows], unit[nodes]) >= threshold
            if own:
                right &= rows != nodes
            links_r.append(rows[right])
            links_c.append(nodes[right].astype(np.int64))
            full_rows.append(part[ok.sum(axis=1) >= beam])
        r, c, full = np.concatenate(links_r), np.concatenate(links_c), np.concatenate(full_rows)
        held_r.append(r)
        held_c.append(c)
        if sum(map(len, held_r)) > most:
            return None
        if len(todo) == total:
            seen["first_full"] = len(full)
        if not len(full) or beam >= n:
            break
        if beam >= SETTLE_BEAM:  # the last widening: queries inside a cloud see the whole shard, by blocks
            for i, j in _true_links(queries[full], unit, threshold, False):
                rows, nodes = full[i], j.astype(np.int64)
                keep = rows != nodes if own else slice(None)
                held_r.append(rows[keep])
                held_c.append(nodes[keep])
                if sum(map(len, held_r)) > most:
                    return None
            break
        todo, beam = full, min(2 * beam, n)
    r, c = np.concatenate(held_r), np.concatenate(held_c)
    code = np.unique(r * n + c)  # a widened query found its first links again
    return code // n, code % n, seen


def link_shards(a: dict, b: dict | None, threshold: float = THRESHOLD, most: int = MOST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Links between two shards (or inside ``a``): per vector of a and then b the copies linked to it, the label of its
    local component (an index), and what the audits saw."""
    own = b is None
    other = a if own else b
    na, nb = len(a["unit"]), 0 if own else len(b["unit"])
    weight = np.concatenate([a["copies"], [] if own else b["copies"]]).astype(np.int64)
    links, label = np.zeros(na + nb, np.int64), np.arange(na + nb)
    shift = 0 if own else na

    def take(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        _unite(label, i, j)

    seen = {}
    one = _found_links(a["graph"], a["unit"], other["unit"], threshold, own, most)  # b's vectors query a
    none = np.zeros(0, np.int64)
    if one is None or own:
        two = one
    elif one[2]["blocks"]:
        two = (none, none, one[2])  # blocks compare both ways
    else:
        two = _found_links(b["graph"], b["unit"], a["unit"], threshold, False, most)
    if one is None or two is None:
        for i, j in _true_links(a["unit"], other["unit"], threshold, own):
            take(i, j + shift)
        return links, weight, label, {"brute": 1.0}
    r, c, seen = one
    if own:
        i, j = np.minimum(r, c), np.maximum(r, c)
    else:
        i, j = np.concatenate([c, two[0]]), np.concatenate([r, two[1]])
        seen = {k: min(seen[k], two[2][k]) for k in seen}
    size = max(na, len(other["unit"]))
    code = np.unique(i * size + j)
    take(code // size, code % size + shift)
    return links, weight, label, seen


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size: the largest component is taken out before squares can over- or underflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _build(table: pa.Table) -> pa.Table:
    vectors = np.array(table.column("embedding").to_pylist(), np.float64)
    unit = _unit(vectors)
    graph = Graph.build(unit.astype(np.float32))
    with np.errstate(over="ignore", under="ignore"):
        narrow = vectors.astype(np.float32)  # half the bytes where no digit is lost
    if (narrow == vectors).all():
        vectors = narrow
    data = pickle.dumps({"node": table.column("node").to_numpy(), "copies": table.column("copies").to_numpy(), "vectors": vectors, "layers": graph.layers, "start": graph.start}, protocol=5)
    keys = [table.column(k)[:1] for k in ("label", "dim", "shard", "shards")]
    return pa.Table.from_arrays([*keys, pa.array([data], pa.binary())], names=["label", "dim", "shard", "shards", "data"])


def _load(data: bytes) -> dict:
    shard = pickle.loads(data)
    shard["unit"] = _unit(shard.pop("vectors").astype(np.float64))
    shard["graph"] = Graph(shard["unit"].astype(np.float32), shard["layers"], shard["start"])
    return shard


def _search(table: pa.Table, threshold: float) -> pa.Table:
    shards = [_load(d) for d in table.column("data").to_pylist()]
    a, b = shards[0], shards[1] if len(shards) > 1 else None
    links, _, label, seen = link_shards(a, b, threshold)
    nodes = np.concatenate([s["node"] for s in shards])
    use = np.flatnonzero(links)
    return pa.table({"node": pa.array(nodes[use], pa.int64()), "links": pa.array(links[use], pa.int64()), "star": pa.array(nodes[label[use]], pa.int64()), "recall": pa.array([seen.get("recall", 1.0)] * len(use), pa.float64())})


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows that may link: label given, every component finite, not zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where(F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors are compared when labels are equal and not null and lengths agree. Null, empty and zero vectors and those
    with a null or non-finite component link with nothing and are their own component. Repeated rows are vectors of
    their own, linked with one another. Null ids name no component unless it has no other id (then null; such rows are
    kept). An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 10_000)
    every = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("embedding"), col(label_col).cast("string").alias("label"))
    usable = _usable(every).withColumn("dim", F.size("embedding")).withColumn("node", F.xxhash64("label", "embedding"))
    distinct = usable.groupBy("label", "dim", "node", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    distinct = written(distinct, "vectors")
    sizes = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "dim", F.ceil(F.col("n") * F.col("dim") / SHARD_NUMBERS).cast("int").alias("shards"))
    dealt = distinct.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.col("node"), F.col("shards")).cast("int"))
    keys = "label string, dim int, shard int, shards int"
    graphs = written(dealt.select("label", "dim", "shard", "shards", "node", "copies", "embedding").groupBy("label", "dim", "shard").applyInArrow(_build, f"{keys}, data binary"), "graphs")

    def search(table: pa.Table) -> pa.Table:
        return _search(table, threshold)

    others = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    cells = graphs.select("label", "dim", "shard", "data", others.alias("other")).select("label", "dim", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "data")
    found = written(cells.groupBy("label", "dim", "i", "j").applyInArrow(search, "node long, links long, star long, recall double"), "links")

    roots = connected_components(found.select(F.col("node").alias("a"), F.col("star").alias("b")), "vector-components")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.select("node", "copies", "least").join(degree, "node", "left").join(roots, "node", "left").select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    named = written(named, "vector-roots")
    # written, so that the join shuffles both sides for itself and can split a large component
    least = written(named.groupBy("root").agg(F.min("least").alias("component")), "vector-component-ids")
    named = named.join(least, "root").select("node", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component")

    rows = every.select("vec_id", F.when(F.col("label").isNotNull(), F.xxhash64("label", "embedding")).alias("node"))
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = rows.join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
