"""A robust-pruned flat graph over unit vectors, and range-expanding greedy search; numpy only, for one block of vectors.

Points are inserted in growing batches. Each one searches the graph so far, keeps a pruned set of what it
has met (a candidate goes if a kept one is `alpha` times nearer to it than the point is), and links back.
"""

from __future__ import annotations

import numpy as np

DEGREE, ALPHA, BEAM, MEDOIDS = 20, 1.2, 24, 12
#: Distance up to which points count as one place: none of them stands for another, as rounding decides which is nearer.
TIED = 2e-3


def medoids(x: np.ndarray, most: int = MEDOIDS, seed: int = 5) -> np.ndarray:
    """Points nearest to the centres of a few clusters."""
    rng = np.random.default_rng(seed)
    k = min(most, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(4):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return np.unique((x @ c.T).argmax(axis=0))


def prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of each point's candidates (padded by -1): at most `degree` of them, padded by -1."""
    out = np.full((len(points), degree), -1, np.int32)
    for lo in range(0, len(points), 256):
        p, c = points[lo : lo + 256], cand[lo : lo + 256]
        c = np.sort(c, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        vec = x[c]
        sim = np.einsum("pcd,pd->pc", vec, x[p])
        sim[(c < 0) | (c == p[:, None])] = -np.inf
        far = np.sqrt(np.maximum(2 - 2 * sim, 0))
        row = np.arange(len(p))
        tied = far <= TIED
        for k in range(degree):
            if k == degree // 2:  # the other half leads away
                sim[tied] = -np.inf
            best = sim.argmax(axis=1)
            alive = np.isfinite(sim[row, best])
            if not alive.any():
                break
            out[lo : lo + 256][alive, k] = c[row, best][alive]
            near = np.sqrt(np.maximum(2 - 2 * np.einsum("pcd,pd->pc", vec, vec[row, best]), 0))
            sim[(alpha * near <= far) & ~tied] = -np.inf
            sim[row, best] = -np.inf
    return out


def search(x: np.ndarray, adj: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, reach: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search for each query from `starts`: best ids found, their similarities (both padded), and with `reach`
    a table of (query, point) for all points met from there on with at least that similarity: each such point is expanded too."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m), bool)
    seen[:, starts] = True
    ids = np.tile(starts.astype(np.int32), (n, 1))
    sim = q @ x[starts].T
    done = np.zeros(ids.shape, bool)
    hits = [np.stack(np.nonzero(sim >= reach), 1)] if reach is not None else []
    if hits:
        hits[0] = np.stack((hits[0][:, 0], starts[hits[0][:, 1]]), 1)
    row = np.arange(n)
    expanded = np.zeros((n, m), bool) if reach is not None else None
    while True:
        if ids.shape[1] > beam:
            top = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
            ids, sim, done = (np.take_along_axis(a, top, axis=1) for a in (ids, sim, done))
        open_sim = np.where(done, -np.inf, sim)
        best = open_sim.argmax(axis=1)
        live = np.flatnonzero(np.isfinite(open_sim[row, best]))
        if not len(live):
            break
        at = ids[live, best[live]]
        done[live, best[live]] = True
        if expanded is not None:
            expanded[live, at] = True
        nb = adj[at]
        fresh = (nb >= 0) & ~seen[live[:, None], nb]
        seen[live[:, None], np.where(nb >= 0, nb, at[:, None])] = True
        s = np.einsum("qrd,qd->qr", x[nb], q[live])
        s[~fresh] = -np.inf
        if reach is not None:
            a, b = np.nonzero(s >= reach)
            hits.append(np.stack((live[a], nb[a, b]), 1))
        wide = np.full((n, nb.shape[1]), -np.inf, sim.dtype)
        wide[live] = s
        wid = np.zeros((n, nb.shape[1]), np.int32)
        wid[live] = nb
        ids, sim, done = np.concatenate((ids, wid), 1), np.concatenate((sim, wide), 1), np.concatenate((done, ~np.isfinite(wide)), 1)
    if reach is None:
        return ids, sim, np.zeros((0, 2), np.int64)
    found = np.concatenate(hits)
    frontier = found
    while len(frontier):  # beyond the beam: everything in range is expanded
        frontier = frontier[~expanded[frontier[:, 0], frontier[:, 1]]]
        nexts = []
        for lo in range(0, len(frontier), 4096):
            f = frontier[lo : lo + 4096]
            expanded[f[:, 0], f[:, 1]] = True
            nb = adj[f[:, 1]]
            qi = np.repeat(f[:, 0], nb.shape[1])
            nb = nb.ravel()
            ok = (nb >= 0) & ~seen[qi, nb]
            code = np.unique(qi[ok].astype(np.int64) * m + nb[ok])
            qi, nb = code // m, code % m
            seen[qi, nb] = True
            s = np.einsum("nd,nd->n", q[qi], x[nb])
            k = s >= reach
            nexts.append(np.stack((qi[k], nb[k]), 1))
        frontier = np.concatenate(nexts) if nexts else np.zeros((0, 2), np.int64)
        found = np.concatenate((found, frontier))
    return ids, sim, found


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency (points x 2 * degree, padded by -1), and for points that follow another its place (else -1).

    A point within TIED of one in the graph follows it instead of being inserted: its only neighbour is that one.
    """
    n = len(x)
    adj, leader = np.full((n, 2 * degree), -1, np.int32), np.full(n, -1, np.int64)
    near_enough = 1 - TIED * TIED / 2
    order = np.random.default_rng(seed).permutation(n)
    at = min(n, 2 * degree)
    first = order[:at]
    sim = x[first] @ x[first].T >= near_enough
    for k in range(1, at):
        lead = first[:k][sim[k, :k] & (leader[first[:k]] < 0)]
        if len(lead):
            leader[first[k]] = lead[0]
    first = first[leader[first] < 0]
    adj[first, :degree] = prune(x, first, np.tile(first.astype(np.int32), (len(first), 1)), degree)
    size = (adj >= 0).sum(axis=1)
    while at < n:
        new = order[at : at + max(32, min(1024, at // 2))]
        at += len(new)
        in_graph = order[: at - len(new)]
        in_graph = in_graph[leader[in_graph] < 0]
        starts = in_graph[medoids(x[in_graph], 6)]
        for lo in range(0, len(new), 256):
            p = new[lo : lo + 256]
            ids, sim, _ = search(x, adj, starts, x[p], beam)
            best = sim.argmax(axis=1)
            close = sim[np.arange(len(p)), best] >= near_enough
            leader[p[close]] = ids[np.arange(len(p)), best][close]
            p, ids, sim = p[~close], ids[~close], sim[~close]
            if len(p):
                adj[p, :degree] = prune(x, p, np.where(np.isfinite(sim), ids, -1), degree)
        new = new[leader[new] < 0]
        size[new] = (adj[new] >= 0).sum(axis=1)
        src, k = np.nonzero(adj[new] >= 0)
        target, source = adj[new][src, k], new[src]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        u, begin, count = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(begin, count)
        full = size[u] + count > 2 * degree
        fits = ~np.repeat(full, count)
        adj[target[fits], size[target[fits]] + nth[fits]] = source[fits]
        size[u[~full]] += count[~full]
        for t, b, c in zip(u[full], begin[full], count[full]):
            cand = np.concatenate((adj[t], source[b : b + c]))[None]
            adj[t] = -1
            adj[t, :degree] = prune(x, np.array([t]), cand.astype(np.int32), degree)[0]
            size[t] = (adj[t] >= 0).sum()
    follow = np.flatnonzero(leader >= 0)
    adj[follow, 0] = leader[follow]
    return adj, leader


def followed(found: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """Pairs (query, point) with those of the points that follow the ones found; each pair once."""
    n = len(leader)
    follow = np.argsort(leader, kind="stable")
    follow = follow[leader[follow] >= 0]
    begin, end = np.searchsorted(leader[follow], found[:, 1]), np.searchsorted(leader[follow], found[:, 1], "right")
    count = end - begin
    a = np.repeat(found[:, 0], count)
    b = follow[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)]
    code = np.unique(np.concatenate((found[:, 0].astype(np.int64) * n + found[:, 1], a.astype(np.int64) * n + b)))
    return np.stack((code // n, code % n), 1)
