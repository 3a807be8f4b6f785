"""Hierarchical navigable small-world graphs over one shard of unit vectors, worked on in batches of queries."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

#: Links of a node in upper layers; twice as many in the lowest.
DEGREE = 12
BEAM = 48
#: Recall that an audit asks for where there are no links: of neighbours much farther off, which are harder to find.
SOUND = 0.9
_QUERIES, _SCAN = 256, 4096


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all queries at once: ids and similarities of each query's beam, best first; -1 where it is not full.

    ``links`` [n, degree] holds neighbours (-1: none), ``entry`` [queries, k]
    where to begin. In each step every query expands the best nodes of its
    beam that are not expanded yet, until there are none.
    """
    q, n = len(queries), len(vectors)
    beam = min(beam, n)
    wide = max(4, beam // 16)
    seen = np.zeros((q, n), bool)
    ids, sims = np.full((q, beam), -1), np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)

    def add(rows: np.ndarray, new: np.ndarray) -> None:
        """Offer nodes new [rows, k] to the beams of the rows."""
        new = np.sort(new, axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        fresh &= ~seen[rows[:, None], np.maximum(new, 0)]
        r, c = np.nonzero(fresh)
        seen[rows[r], new[r, c]] = True
        sim = np.full(new.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("ij,ij->i", queries[rows[r]], vectors[new[r, c]])
        all_ids = np.concatenate([ids[rows], np.where(fresh, new, -1)], 1)
        all_sims = np.concatenate([sims[rows], sim], 1)
        all_done = np.concatenate([done[rows], ~fresh], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_sims, all_done))

    add(np.arange(q), entry)
    while True:
        rows = np.flatnonzero(~done.all(1))
        if not len(rows):
            return ids, sims
        first = np.argsort(done[rows], axis=1, kind="stable")[:, :wide]
        todo = ~np.take_along_axis(done[rows], first, 1)
        nodes = np.where(todo, np.take_along_axis(ids[rows], first, 1), -1)
        done[rows[:, None], first] = True
        near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1)
        add(rows, near.reshape(len(rows), -1))


def diverse(vectors: np.ndarray, base: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """For each vector of ``base`` choose ``degree`` of its candidates [base, k] (-1: none): nearest first, those that are
    nearer to it than to any chosen one; what is passed over fills the rest."""
    there = candidates >= 0
    v = vectors[np.maximum(candidates, 0)]
    sim = np.where(there, np.einsum("bd,bkd->bk", base, v), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * degree]
    candidates, sim, v = np.take_along_axis(candidates, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    between = np.einsum("bkd,bjd->bkj", v, v)
    kept = np.zeros(sim.shape, bool)
    for k in range(sim.shape[1]):
        blocked = ((between[:, k] >= sim[:, k, None]) & kept).any(1)
        kept[:, k] = ~blocked & (candidates[:, k] >= 0) & (kept.sum(1) < degree)
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(candidates, order, 1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of one shard's graph: layer 0 has all nodes, each upper one about a DEGREE-th of the layer below."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(DEGREE)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        top = max(1, int(level.max(initial=0)))
        self.counts = [int((level >= k).sum()) for k in range(top + 1)]  # nodes of layer k: the first in the order
        while len(self.counts) > 1 and self.counts[-1] < 4:
            self.counts.pop()
        self.links = [np.full((n, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k in range(len(self.counts))]
        at = 0
        while at < n:  # insert in batches that double
            end = min(n, at + max(32, min(at, 512)))
            self._insert(self.order[at:end], at)
            at = end

    def _entries(self, queries: np.ndarray, inserted: int, down_to: int) -> np.ndarray:
        top = len(self.counts) - 1
        first = self.order[: min(self.counts[top], max(inserted, 1), 64)]
        entry = np.tile(first, (len(queries), 1))
        for k in range(top, down_to, -1):
            if min(self.counts[k], inserted):
                entry = beam_search(self.vectors, self.links[k], queries, entry, 12)[0]
        return entry

    def _insert(self, batch: np.ndarray, inserted: int) -> None:
        own = self.vectors[batch]
        for k in range(len(self.counts) - 1, -1, -1):
            new = batch[: max(0, min(len(batch), self.counts[k] - inserted))]
            if not len(new):
                continue
            base = self.vectors[new]
            fellows = np.tile(new, (len(new), 1))
            near = np.argsort(-(base @ own[: len(new)].T), axis=1)[:, : 2 * DEGREE + 1]  # of the batch itself
            fellows = np.take_along_axis(fellows, near, 1)
            fellows = np.where(fellows == new[:, None], -1, fellows)
            found = beam_search(self.vectors, self.links[k], base, self._entries(base, inserted, k), BEAM)[0] if inserted else np.empty((len(new), 0), int)
            degree = DEGREE
            chosen = diverse(self.vectors, base, np.concatenate([found, fellows], 1), degree)
            self.links[k][new, :degree] = chosen
            self._back_links(k, new, chosen)

    def _back_links(self, k: int, new: np.ndarray, chosen: np.ndarray) -> None:
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = self.links[k].shape[1]
        for lo in range(0, len(nodes), 512):
            part, c = nodes[lo : lo + 512], np.minimum(count[lo : lo + 512], 64)
            more = np.full((len(part), int(c.max())), -1)
            r = np.repeat(np.arange(len(part)), c)
            j = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
            more[r, j] = source[np.repeat(first[lo : lo + 512], c) + j]
            both = np.sort(np.concatenate([self.links[k][part], more], 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            self.links[k][part] = diverse(self.vectors, self.vectors[part], both, width)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = queries.astype(np.float32)
        return beam_search(self.vectors, self.links[0], q, self._entries(q, len(self.vectors), 0), beam)

    def within(self, queries: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of cosine >= threshold or a little less (single precision), in runs: the caller verifies
        them and holds no more than a run. A query whose whole beam is that near gets a beam four times as wide, up to
        the shard. A beam of all nodes scans them."""
        n = len(self.vectors)
        for lo in range(0, len(queries), _QUERIES):
            todo = np.arange(lo, min(len(queries), lo + _QUERIES))
            wide = beam
            while len(todo):
                if wide >= n:
                    for at in range(0, n, _SCAN):
                        near = queries[todo].astype(np.float32) @ self.vectors[at : at + _SCAN].T
                        r, c = np.nonzero(near >= threshold - 1e-3)
                        yield todo[r], c + at
                    break
                ids, sims = self.search(queries[todo], wide)
                full = sims[:, -1] >= threshold - 1e-3
                r, c = np.nonzero((sims >= threshold - 1e-3) & ~full[:, None])
                yield todo[r], ids[r, c].astype(np.int64)
                todo, wide = todo[full], wide * 4

    def audited_beam(self, queries: np.ndarray, threshold: float, recall: float, own: bool = False, audits: int = 512) -> tuple[int, int, int]:
        """The least beam (BEAM, doubled as often as needed) whose answers to a sample of ``queries`` hold ``recall`` of the
        links that a scan finds, and SOUND of the nearest vectors of queries without a link; the links of the sample, and how many of them that beam finds.

        ``own``: the queries are the shard's vectors, and none is its own link or neighbour.
        """
        n = len(self.vectors)
        at = np.unique(np.linspace(0, len(queries) - 1, min(len(queries), audits)).astype(int))
        sims = queries[at] @ self.vectors.T.astype(np.float64)
        if own:
            sims[np.arange(len(at)), at] = -np.inf
        nearest, there = sims.argmax(1), (sims.max(1) > -np.inf) & (sims.max(1) < threshold)
        true = sims >= threshold
        beam = BEAM
        while beam < n:
            ids, _ = self.search(queries[at], beam)
            got = np.zeros(true.shape, bool)
            for q, t in self.within(queries[at], threshold, beam):
                got[q, t] = True
            held, first = int((true & got).sum()), (ids == nearest[:, None]).any(1)[there]
            if held >= recall * true.sum() and first.sum() >= SOUND * len(first):
                return beam, int(true.sum()), held
            beam *= 2
        return n, int(true.sum()), int(true.sum())

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, counts=self.counts, **{f"links{k}": x for k, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes, vectors: np.ndarray) -> Graph:
        self = object.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            self.vectors, self.order, self.counts = vectors.astype(np.float32), z["order"], z["counts"].tolist()
            self.links = [z[f"links{k}"] for k in range(len(self.counts))]
        return self
