"""A hierarchical navigable small-world graph in numpy: many searches advance in step.

Levels are drawn as usual; nodes are inserted from the highest level down, in batches, each batch searching the graph
built so far and its own members. Neighbours are chosen by the diversity rule (a candidate that is closer to a chosen
neighbour than to the node is passed over), reverse links are pruned by the same rule.
"""

from __future__ import annotations

import numpy as np

LINKS = 12
BUILD_BEAM = 40
_VISITED = 1 << 25


def _select(vecs: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """The diverse nearest ``most`` candidates of each base vector, padded with -1; candidates < 0 are none."""
    order = np.argsort(-np.where(cand < 0, -np.inf, sims), axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = cand.shape
    out = np.full((rows, most), -1, np.int32)
    for a in range(0, rows, 2048):
        c, s = cand[a : a + 2048], sims[a : a + 2048]
        v = vecs[np.maximum(c, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        valid = c >= 0
        valid[:, 1:] &= c[:, 1:] != c[:, :-1]
        kept = np.zeros(c.shape, bool)
        for k in range(width):
            near = np.where(kept, between[:, k], -np.inf).max(axis=1) if k else np.full(len(c), -np.inf)
            kept[:, k] = valid[:, k] & (near < s[:, k]) & (kept.sum(axis=1) < most)
        for k in range(width):  # fill up with the nearest that were passed over
            kept[:, k] |= valid[:, k] & (kept.sum(axis=1) < most)
        r, k = np.nonzero(kept)
        place = (np.cumsum(kept, axis=1) - 1)[r, k]
        out[a + r, place] = c[r, k]
    return out


def beam_search(vecs: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for each query and their similarities (ids -1 where fewer were reached)."""
    n, total = len(vecs), len(queries)
    out_i, out_s = np.full((total, beam), -1, np.int32), np.full((total, beam), -np.inf, np.float32)
    chunk = max(1, _VISITED // max(n, 1))
    step = min(step, beam)
    for a in range(0, total, chunk):
        q = queries[a : a + chunk]
        rows = len(q)
        ids, sims = out_i[a : a + rows], out_s[a : a + rows]
        done = np.zeros((rows, beam), bool)
        seen = np.zeros((rows, n), bool)
        start = entry[a : a + rows]
        ids[:, 0], sims[:, 0] = start, np.einsum("ij,ij->i", vecs[start], q)
        seen[np.arange(rows), start] = True
        act = np.arange(rows)
        while True:
            open_ = np.where(done[act] | (ids[act] < 0), -np.inf, sims[act])
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(act), 1))
            live = np.take_along_axis(open_, pick, 1) > -np.inf
            go = live.any(axis=1)
            act, pick, live = act[go], pick[go], live[go]
            if not len(act):
                break
            done[act[:, None], pick] |= live
            nodes = ids[act[:, None], pick]
            nb = links[nodes]
            nb[~live] = -1
            nb = np.sort(nb.reshape(len(act), -1), axis=1)
            new = nb >= 0
            new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            new &= ~seen[act[:, None], nb]
            r, k = np.nonzero(new)
            found = nb[r, k]
            seen[act[r], found] = True
            s = np.full(nb.shape, -np.inf, np.float32)
            s[r, k] = np.einsum("ij,ij->i", vecs[found], q[act[r]])
            all_s = np.concatenate([sims[act], s], axis=1)
            all_i = np.concatenate([ids[act], np.where(new, nb, -1)], axis=1)
            all_d = np.concatenate([done[act], np.zeros(nb.shape, bool)], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[act], sims[act], done[act] = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1), np.take_along_axis(all_d, top, 1)
    return out_i, out_s


class Graph:
    """``vecs`` (unit length, float32) with link tables of every layer, the lowest first."""

    def __init__(self, vecs: np.ndarray, layers: list[np.ndarray], start: int):
        self.vecs, self.layers, self.start = vecs, layers, start

    @classmethod
    def build(cls, vecs: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 11) -> Graph:
        n = len(vecs)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 8)
        order = np.argsort(-level, kind="stable")
        graph = cls(vecs, [], int(order[0]))
        for at in range(int(level.max()), -1, -1):
            graph._add_layer(order[: int((level >= at).sum())], int((level > at).sum()), links if at else 2 * links, links, beam)
        return graph

    def _add_layer(self, nodes: np.ndarray, above: int, room: int, links: int, beam: int) -> None:
        """``nodes`` in order of insertion; the first ``above`` also stand in the layers above."""
        table = np.full((len(self.vecs), room), -1, np.int32)
        done = min(len(nodes), 2 * room)
        self._link(table, nodes[:done], np.tile(nodes[:done].astype(np.int32), (done, 1)), room, links)
        while done < len(nodes):
            batch = nodes[done : done + min(1024, done)]
            entry = np.full(len(batch), self.start)
            lower = np.arange(done, done + len(batch)) >= above
            if lower.any() and self.layers:
                entry[lower] = self._descend(self.vecs[batch[lower]])
            cand, _ = beam_search(self.vecs, table, self.vecs[batch], entry, beam)
            own = self.vecs[batch] @ self.vecs[batch].T
            k = min(len(batch) - 1, links)
            if k:
                own[np.arange(len(batch)), np.arange(len(batch))] = -np.inf
                cand = np.concatenate([cand, batch[np.argpartition(-own, k - 1, axis=1)[:, :k]].astype(np.int32)], axis=1)
            self._link(table, batch, cand, room, links)
            done += len(batch)
        self.layers.insert(0, table)

    def _link(self, table: np.ndarray, nodes: np.ndarray, cand: np.ndarray, room: int, links: int) -> None:
        """Link ``nodes`` to the best of their candidates, both ways."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        sims = np.einsum("ijk,ik->ij", self.vecs[np.maximum(cand, 0)], self.vecs[nodes])
        chosen = _select(self.vecs, self.vecs[nodes], cand, sims, links)
        table[nodes, :links] = chosen
        r, k = np.nonzero(chosen >= 0)
        to, by = chosen[r, k], nodes[r].astype(np.int32)
        s = np.einsum("ij,ij->i", self.vecs[to], self.vecs[by])
        order = np.lexsort((-s, to))
        to, by = to[order], by[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        fits = place < room  # of very many new links a node looks at the nearest
        ends, slot = np.unique(to[fits], return_inverse=True)
        new = np.full((len(ends), room), -1, np.int32)
        new[slot, place[fits]] = by[fits]
        both = np.concatenate([table[ends], new], axis=1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sims = np.einsum("ijk,ik->ij", self.vecs[np.maximum(both, 0)], self.vecs[ends])
        table[ends] = _select(self.vecs, self.vecs[ends], both, sims, room)

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        entry = np.full(len(queries), self.start)
        for table in reversed(self.layers):
            entry = beam_search(self.vecs, table, queries, entry, 4)[0:2]
            entry = entry[0][np.arange(len(queries)), entry[1].argmax(axis=1)]
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the beam at the lowest layer."""
        upper = Graph(self.vecs, self.layers[1:], self.start)
        return beam_search(self.vecs, self.layers[0], queries, upper._descend(queries), min(beam, len(self.vecs)))
