"""Local alignment with affine gaps, for one query against many targets at once (numpy)."""

from __future__ import annotations

import math

import numpy as np

ALPHABET = "ARNDCQEGHILKMFPSTWYV"
# BLOSUM62, lower triangle in the order of ALPHABET.
_TRIANGLE = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
OPEN, EXTEND = 11, 1
#: Score of a letter outside the alphabet; X, any residue, scores -1 against residues and itself.
OUTSIDE = -4
LAMBDA, K = 0.267, 0.041


def _matrix() -> np.ndarray:
    m = np.full((128, 128), OUTSIDE, np.int32)
    for a, row in zip(ALPHABET, _TRIANGLE.split("\n")[1:]):
        for b, s in zip(ALPHABET, map(int, row.split())):
            m[ord(a), ord(b)] = m[ord(b), ord(a)] = s
    x = [ord(c) for c in ALPHABET + "X"]
    m[ord("X"), x] = m[x, ord("X")] = -1
    return m


MATRIX = _matrix()


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8)


def score(a: str, b: str) -> int:
    return int(MATRIX[ord(a.upper()) & 127, ord(b.upper()) & 127])


class Targets:
    """Targets padded to one length; scores of a query against all of them are a sweep over their columns."""

    def __init__(self, seqs: list[str]):
        self.width = max(map(len, seqs), default=0)
        self.codes = np.zeros((len(seqs), self.width), np.uint8)
        for k, s in enumerate(seqs):
            self.codes[k, : len(s)] = _codes(s)

    def scores(self, query: str) -> np.ndarray:
        n, m = len(query), self.width
        if not n or not m or not len(self.codes):
            return np.zeros(len(self.codes), np.int64)
        by = MATRIX[_codes(query)]  # query x letters; letter 0 is padding
        by[:, 0] = -10_000
        steps = EXTEND * np.arange(m + 1)
        h = np.zeros((len(self.codes), m + 1), np.int32)
        f = np.full_like(h, -10_000)
        best = np.zeros(len(self.codes), np.int32)
        for row in by:
            f = np.maximum(f - EXTEND, h - OPEN)
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + row[self.codes], f[:, 1:]), 0)
            # a gap along the target: the best start so far, as a running maximum; a gap that opens from another never pays
            start = np.maximum.accumulate(new + steps, axis=1)
            new[:, 1:] = np.maximum(new[:, 1:], start[:, :-1] - OPEN + EXTEND - steps[1:])
            h = new
            best = np.maximum(best, h.max(axis=1))
        return best.astype(np.int64)


def local_score(query: str, target: str) -> int:
    return int(Targets([target]).scores(query)[0])


def local_identity(query: str, target: str) -> tuple[float, int]:
    """Matches over columns of the alignment that ends at the first best cell (by query, then target), and its score.

    Going back a diagonal step is preferred, then a gap along the target, then along the query.
    """
    a, b = _codes(query), _codes(target)
    n, m = len(a), len(b)
    h, e, f = np.zeros((n + 1, m + 1), int), np.full((n + 1, m + 1), -10_000), np.full((n + 1, m + 1), -10_000)
    steps = EXTEND * np.arange(m + 1)
    for i in range(1, n + 1):
        f[i, 1:] = np.maximum(f[i - 1, 1:] - EXTEND, h[i - 1, 1:] - OPEN)
        h[i, 1:] = np.maximum(np.maximum(h[i - 1, :-1] + MATRIX[a[i - 1], b], f[i, 1:]), 0)
        e[i, 1:] = np.maximum.accumulate(h[i] + steps)[:-1] - OPEN + EXTEND - steps[1:]
        h[i] = np.maximum(h[i], e[i])
    if n == 0 or m == 0 or h.max() == 0:
        return 0.0, 0
    i, j = np.unravel_index(h.argmax(), h.shape)
    best, same, columns, mode = int(h[i, j]), 0, 0, "h"
    while mode != "h" or h[i, j] > 0:
        if mode == "h":
            if h[i, j] == h[i - 1, j - 1] + MATRIX[a[i - 1], b[j - 1]]:
                same += a[i - 1] == b[j - 1]
                columns += 1
                i, j = i - 1, j - 1
            else:
                mode = "e" if h[i, j] == e[i, j] else "f"
        elif mode == "e":
            mode = "h" if e[i, j] == h[i, j - 1] - OPEN else "e"
            j, columns = j - 1, columns + 1
        else:
            mode = "h" if f[i, j] == h[i - 1, j] - OPEN else "f"
            i, columns = i - 1, columns + 1
    return same / columns, best


#: Cells of a diagonal, over all pairs of a batch, that are worked on at once.
CELLS = 16_384
_PAD = 128
_PADDED = np.full((_PAD + 1, _PAD + 1), -10_000, np.int32)
_PADDED[:128, :128] = MATRIX


def align(queries: list[str], targets: list[str], identity: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of each query against the target beside it and, if asked for, matches over columns as local_identity() gives them.

    Pairs of like lengths are one batch, which is worked through by diagonals; matches and columns go along with the scores, so there is no way back.
    """
    scores = np.zeros(len(queries), np.int64)
    shares = np.zeros(len(queries)) if identity else None
    order = sorted((k for k in range(len(queries)) if queries[k] and targets[k]), key=lambda k: (len(queries[k]), len(targets[k])))
    lo = 0
    while lo < len(order):
        most = max(1, CELLS // (len(queries[order[lo]]) + 8))
        part = order[lo : lo + most]
        lo += len(part)
        found, best = _align([_codes(queries[k]) for k in part], [_codes(targets[k]) for k in part], identity)
        scores[part] = found
        if identity:
            shares[part] = np.where(found > 0, (best >> 32) / np.maximum(best & 0xFFFFFFFF, 1), 0.0)
    return scores, shares


def _align(a: list[np.ndarray], b: list[np.ndarray], identity: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and, packed, matches (upper 32 bits) and columns of the alignment that ends at the first best cell, by query, then target."""
    R, n, m = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.full((n, R), _PAD, np.int32), np.full((m, R), _PAD, np.int32)
    for k, (q, t) in enumerate(zip(a, b)):
        x[: len(q), k], y[m - len(t) :, k] = q, t[::-1]  # targets backwards: a diagonal is a slice of both
    worth = _PADDED.ravel()
    # tables of the last diagonals, by place in the query; places that a diagonal has not come to yet are its borders
    h, e, f = [np.zeros((n + 1, R), np.int32) for _ in range(3)], *([np.full((n + 1, R), -10_000, np.int32) for _ in range(2)] for _ in range(2))
    ph, pe, pf = ([np.zeros((n + 1, R), np.int64) for _ in range(c if identity else 0)] for c in (3, 2, 2))
    best, at = np.zeros((n + 1, R), np.int32), np.zeros((n + 1, R), np.int64)
    # y holds target j at row m - j, from the pair's own end: shorter targets are padded at its start
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        up, here = slice(lo - 1, hi), slice(lo, hi + 1)
        h0, h1, h2, e0, e1, f0, f1 = h[d % 3], h[(d - 1) % 3], h[(d - 2) % 3], e[d % 2], e[(d - 1) % 2], f[d % 2], f[(d - 1) % 2]
        xs, ys = x[up], y[m - d + lo : m - d + hi + 1]
        step = h2[up] + worth[xs * (_PAD + 1) + ys]
        f_open, f_on, e_open, e_on = h1[up] - OPEN, f1[up] - EXTEND, h1[here] - OPEN, e1[here] - EXTEND
        gap_f, gap_e = np.maximum(f_open, f_on), np.maximum(e_open, e_on)
        new = np.maximum(np.maximum(step, gap_e), np.maximum(gap_f, 0))
        if identity:
            g0, g1, g2 = ph[d % 3], ph[(d - 1) % 3], ph[(d - 2) % 3]
            way_f = np.where(f_open >= f_on, g1[up], pf[(d - 1) % 2][up]) + 1
            way_e = np.where(e_open >= e_on, g1[here], pe[(d - 1) % 2][here]) + 1
            way = np.where(new == step, g2[up] + 1 + ((xs == ys).astype(np.int64) << 32), np.where(new == gap_e, way_e, way_f))
            way[new == 0] = 0
            g0[here], pf[d % 2][here], pe[d % 2][here] = way, way_f, way_e
        h0[here], f0[here], e0[here] = new, gap_f, gap_e
        more = new > best[here]
        if identity:
            np.copyto(at[here], way, where=more)
        np.copyto(best[here], new, where=more)
    first = best.argmax(axis=0)
    own = np.arange(R)
    return best[first, own], at[first, own]


def evalue(raw: int, query_length: int, database_length: int) -> float:
    return query_length * database_length * 2.0**-raw


def bit_score(raw: int) -> float:
    return (LAMBDA * raw - math.log(K)) / math.log(2)
