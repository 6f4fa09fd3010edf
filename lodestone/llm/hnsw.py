"""A hierarchical navigable small-world graph in numpy: inserts and searches go in batches, all queries in lockstep."""

from __future__ import annotations

import numpy as np

M, M0, EF_BUILD, BATCH = 12, 24, 48, 256


class Graph:
    """Graph over the rows of unit (float32, one vector a row), similarity is the dot product."""

    def __init__(self, unit: np.ndarray, seed: int = 0):
        self.unit = np.ascontiguousarray(unit, dtype=np.float32)
        n = len(unit)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum(8, np.floor(-np.log(1 - draws) / np.log(M))).astype(np.int32)
        self.links = [np.full((n, M0 if k == 0 else M), -1, dtype=np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.inside = np.zeros(n, dtype=bool)
        done = 0
        while done < n:
            size = min(max(32, done), BATCH, n - done)
            self._insert(np.arange(done, done + size))
            done += size

    def _entries(self, count: int) -> tuple[np.ndarray, int]:
        """Nodes of the highest filled level."""
        known = np.nonzero(self.inside)[0]
        top = int(self.level[known].max())
        return known[self.level[known] == top][:count], top

    def beam(self, queries: np.ndarray, starts: np.ndarray, level: int, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of ef places a query, best first; -1 and -inf where fewer were reached."""
        q, links = len(queries), self.links[level]
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, len(self.unit) + 1), dtype=bool)  # the last column takes the gaps
        seen[:, -1] = True
        ids = np.full((q, max(ef, starts.shape[1])), -1, dtype=np.int64)
        ids[:, : starts.shape[1]] = starts
        sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", self.unit[ids], queries), -np.inf)
        seen[rows, ids] = True
        order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        ids, sims = ids[rows, order], sims[rows, order]
        opened = np.zeros(ids.shape, dtype=bool)
        live = np.arange(q)
        while len(live):
            r = np.arange(len(live))[:, None]
            free = ~opened[live] & (ids[live] >= 0)
            first = np.argsort(~free, axis=1, kind="stable")[:, :width]  # the beam is sorted: the best unopened ones
            use = free[r, first]
            opened[live[:, None], first] |= use
            near = links[np.where(use, ids[live[:, None], first], 0)].astype(np.int64)
            near[~use] = -1
            near = near.reshape(len(live), -1)
            near[seen[live[:, None], near]] = -1
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[live[:, None], near] = True
            s = np.where(near >= 0, np.einsum("qkd,qd->qk", self.unit[near], queries[live]), -np.inf)
            all_ids, all_sims = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], s], axis=1)
            all_open = np.concatenate([opened[live], np.zeros(near.shape, dtype=bool)], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, : ids.shape[1]]
            ids[live], sims[live], opened[live] = all_ids[r, order], all_sims[r, order], all_open[r, order]
            live = live[(~opened[live] & (ids[live] >= 0)).any(axis=1)]
        return ids, sims

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to ef nodes a query on the ground level."""
        if not self.inside.any():
            return np.full((len(queries), 1), -1), np.full((len(queries), 1), -np.inf)
        entries, top = self._entries(8)
        starts = np.tile(entries, (len(queries), 1))
        for level in range(top, 0, -1):
            starts = self.beam(queries, starts, level, 8)[0]
        return self.beam(queries, starts, 0, ef)

    def _diverse(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's candidates (best first): those nearer to the node than to one kept; then the rest."""
        own_rows = np.arange(len(own))[:, None]
        vectors = self.unit[ids]
        between = np.einsum("qid,qjd->qij", vectors, vectors)
        kept = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            closest = np.where(kept, between[:, j], -np.inf).max(axis=1)
            kept[:, j] = (ids[:, j] >= 0) & (closest < sims[:, j]) & (kept.sum(axis=1) < most)
        order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :most]
        return ids[own_rows, order]

    def _insert(self, new: np.ndarray) -> None:
        queries = self.unit[new]
        mutual = queries @ queries.T
        np.fill_diagonal(mutual, -np.inf)
        any_inside = self.inside.any()
        starts, top = self._entries(8) if any_inside else (np.zeros(0, dtype=int), -1)
        starts = np.tile(starts, (len(new), 1))
        for level in range(len(self.links) - 1, -1, -1):
            at = np.nonzero(self.level[new] >= level)[0]
            ids, sims = np.full((len(new), 1), -1, dtype=np.int64), np.full((len(new), 1), -np.inf)
            if any_inside and level <= top:
                ids, sims = self.beam(queries, starts, level, EF_BUILD if level == 0 else 16)
                starts = ids[:, :8]
            if not len(at):
                continue
            peers = np.where(self.level[new][None, :] >= level, mutual[at], -np.inf)
            take = min(16, peers.shape[1])
            order = np.argpartition(-peers, take - 1, axis=1)[:, :take]
            peer_sims = np.take_along_axis(peers, order, axis=1)
            ids = np.concatenate([ids[at], np.where(np.isfinite(peer_sims), new[order], -1)], axis=1)
            sims = np.concatenate([sims[at], peer_sims], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            chosen = self._diverse(new[at], ids, sims, M)
            self.links[level][new[at], : chosen.shape[1]] = chosen
            self._link_back(level, np.repeat(new[at], chosen.shape[1]), chosen.ravel())
        self.inside[new] = True

    def _link_back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        """Add source to target's links; a full list keeps the diverse ones."""
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        links = self.links[level]
        room = links.shape[1]
        for width in (room, 4 * room, max(4 * room, int(count.max(initial=0)))):  # few nodes get many at a time
            at = np.nonzero((count <= width) & (count > 0))[0]
            count_here, who = count[at], nodes[at]
            count[at] = 0
            if not len(at):
                continue
            fresh = np.full((len(at), int(count_here.max())), -1, dtype=np.int64)
            r = np.repeat(np.arange(len(at)), count_here)
            c = np.arange(len(r)) - np.repeat(np.cumsum(count_here) - count_here, count_here)
            fresh[r, c] = source[np.repeat(first[at], count_here) + c]
            ids = np.concatenate([links[who].astype(np.int64), fresh], axis=1)
            ids = np.sort(ids, axis=1)[:, ::-1]
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", self.unit[ids], self.unit[who]), -np.inf)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * room]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            kept = self._diverse(who, ids, sims, room)
            links[who] = -1
            links[who[:, None], np.arange(kept.shape[1])] = kept
