"""A robust-pruned flat graph over the vectors of one shard, in numpy.

Vectors are unit vectors; distance is Euclidean, so the nearest is that of the largest cosine. A
graph row built here holds up to DEGREE neighbours, padded with the number of vectors; rows of a
united graph may be longer. All steps take a batch of vectors at a time.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a vector, length of the search list, slack of the pruning rule, entry points of a shard.
DEGREE, BEAM, ALPHA, MEDOIDS = 32, 64, 1.2, 128
BATCH = 256
#: A range search goes on through neighbours whose cosine is less than the range's by so much.
SLACK = 0.06


class ShardGraph:
    """Vectors (n, d), and for each its neighbours (n, DEGREE)."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None) -> None:
        n, d = vectors.shape
        self.n = n
        self.x = np.vstack([vectors.astype(np.float32), np.zeros((1, d), np.float32)])  # the last stands for no neighbour
        self.adj = np.full((n, DEGREE), n, np.int32) if neighbours is None else neighbours
        self.starts = self._medoids()

    def _medoids(self) -> np.ndarray:
        """The vectors nearest to the means of a few rough clusters, and to the mean of all."""
        x, rng = self.x[: self.n], np.random.default_rng(1)
        centre = x[rng.choice(self.n, min(MEDOIDS - 1, self.n), replace=False)]
        for _ in range(2):
            own = np.argmax(x @ centre.T, axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, own, x)
            centre = np.where((total != 0).any(axis=1)[:, None], total, centre)
            centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-30)[:, None]
        near = np.argmax(x @ np.vstack([x.mean(axis=0), centre]).T, axis=0)
        return np.array(list(dict.fromkeys(near.tolist())), np.int32)

    def build(self) -> np.ndarray:
        """Insert all vectors in batches that double; returns the neighbours."""
        rng = np.random.default_rng(2)
        rest = np.setdiff1d(np.arange(self.n, dtype=np.int32), self.starts)
        rng.shuffle(rest)
        # the entry points see each other; all others come by search
        m = len(self.starts)
        self._link(self.starts, np.tile(self.starts, (m, 1)))
        done = 0
        while done < len(rest):
            batch = rest[done : done + min(BATCH, m + done)]
            found, _, _ = self.beam(batch, own=False)
            self._link(batch, found)
            done += len(batch)
        return self.adj

    def _link(self, rows: np.ndarray, candidates: np.ndarray) -> None:
        """Give ``rows`` pruned neighbours, and these the way back."""
        for k in range(0, len(rows), BATCH):
            part = rows[k : k + BATCH]
            self.adj[part] = self._pruned(part, candidates[k : k + BATCH])
        back = self.adj[rows]
        to, of = back.ravel(), np.repeat(rows, DEGREE)
        keep = to < self.n
        to, of = to[keep], of[keep]
        near = np.einsum("ij,ij->i", self.x[to], self.x[of])
        order = np.lexsort((-near, to))
        to, of = to[order], of[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        count = np.diff(first, append=len(to))
        place = np.arange(len(to)) - np.repeat(first, count)
        keep = place < DEGREE  # of many new ones the nearest
        target = to[first]
        new = np.full((len(target), DEGREE), self.n, np.int32)
        new[np.repeat(np.arange(len(target)), count)[keep], place[keep]] = of[keep]
        for k in range(0, len(target), BATCH):
            part = target[k : k + BATCH]
            both = np.hstack([self.adj[part], new[k : k + BATCH]])
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = self.n
            both.sort(axis=1)
            over = (both < self.n).sum(axis=1) > DEGREE
            self.adj[part[~over]] = both[~over, :DEGREE]
            if over.any():
                self.adj[part[over]] = self._pruned(part[over], both[over])

    def _pruned(self, rows: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The robust-prune rule: the nearest candidate stays, and all go that are nearer to it by ALPHA than to the row."""
        c = np.where(candidates == rows[:, None], self.n, candidates)
        x = self.x[c]
        far = np.where(c < self.n, 2 - 2 * np.matmul(x, self.x[rows][:, :, None])[:, :, 0], np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        c, far, x = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(x, order[:, :, None], 1)
        between = ALPHA**2 * (2 - 2 * np.matmul(x, x.transpose(0, 2, 1)))
        alive, out, at = c < self.n, np.full((len(rows), DEGREE), self.n, np.int32), np.arange(len(rows))
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = np.argmax(alive, axis=1)
            out[some, k] = c[at, pick][some]
            alive &= between[at, pick] > far
            alive[at, pick] = False
        return out

    def beam(self, rows: np.ndarray, own: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy search for each of ``rows``, from the entry points and with ``own`` from the row's own neighbours.

        Returns the BEAM nearest found, their cosines (-inf: none), and who was seen by whom.
        """
        m, n = len(rows), self.n
        q, at = self.x[rows], np.arange(m)
        begin = np.tile(self.starts, (m, 1))
        if own:
            begin = np.hstack([begin, rows[:, None], self.adj[rows]])
        begin.sort(axis=1)
        begin[:, 1:][begin[:, 1:] == begin[:, :-1]] = n
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        width = max(BEAM, begin.shape[1])
        ids, near = np.full((m, width), n, np.int32), np.full((m, width), -np.inf, np.float32)
        ids[:, : begin.shape[1]] = begin
        near[:, : begin.shape[1]] = np.where(begin < n, np.matmul(self.x[begin], q[:, :, None])[:, :, 0], -np.inf)
        seen[at[:, None], begin] = True
        if width > BEAM:
            top = np.argpartition(-near, BEAM - 1, axis=1)[:, :BEAM]
            ids, near = np.take_along_axis(ids, top, 1), np.take_along_axis(near, top, 1)
        done = near == -np.inf
        while at.size:
            open_ = np.where(done[at], -np.inf, near[at])
            pick = np.argmax(open_, axis=1)
            go = open_[np.arange(len(at)), pick] > -np.inf
            at, pick = at[go], pick[go]
            if not at.size:
                break
            nb = self.adj[ids[at, pick]]
            done[at, pick] = True
            fresh = ~seen[at[:, None], nb]
            seen[at[:, None], nb] = True
            s = np.where(fresh, np.matmul(self.x[nb], q[at][:, :, None])[:, :, 0], -np.inf)
            all_ids, all_near, all_done = np.hstack([ids[at], nb]), np.hstack([near[at], s]), np.hstack([done[at], ~fresh])
            top = np.argpartition(-all_near, BEAM - 1, axis=1)[:, :BEAM]
            ids[at], near[at], done[at] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_done))
        return ids, near, seen

    def within(self, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``rows``, vector) found with a cosine of ``least`` or slightly less, the row itself left out.

        The greedy search's finds in range are expanded, and what that finds in range again, until none is new.
        """
        ids, near, seen = self.beam(rows)
        at, k = np.nonzero(near >= least - SLACK)
        v, s = ids[at, k], near[at, k]
        found = [(at, v, s)]
        while len(at):
            more = []
            for part in range(0, len(at), 1 << 14):
                who = np.repeat(at[part : part + (1 << 14)], self.adj.shape[1])
                nb = self.adj[v[part : part + (1 << 14)]].ravel()
                key = np.unique((who * (self.n + 1) + nb)[~seen[who, nb]])
                who, nb = key // (self.n + 1), key % (self.n + 1)
                seen[who, nb] = True
                s = np.einsum("ij,ij->i", self.x[nb], self.x[rows[who]])
                keep = s >= least - SLACK
                more.append((who[keep], nb[keep], s[keep]))
            at, v, s = (np.concatenate(x) for x in zip(*more, strict=True))
            found.append((at, v, s))
        at, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = (s >= least - 1e-3) & (v != rows[at])
        return at[keep], v[keep]
