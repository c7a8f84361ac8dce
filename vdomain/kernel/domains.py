"""From hits to domains: scanning, choosing hits, state vectors, and the second look for long third loops."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from .profile import Profile, Scanner, Tables
from .schemes import State

#: Bits that a profile's best path may stay below a threshold for its domains to be looked at: all paths together score a few bits more than the best one.
SLACK = 20.0
#: Models times residues scored up to which the tables of a scan are kept for tracing (200 MB or so); longer sequences are scanned again for that.
KEPT = 120_000
#: Sequences of a block, and residues in it that are scored.
ROWS, CELLS = 128, 6000
#: Sequences from which on a block of like ones stays by itself.
FEW = 8
#: Threshold of the second look.
RESCUE = 10.0


@dataclass(frozen=True)
class Hit:
    """One profile over one stretch of the sequence (ends exclusive); columns: m, i and d from first to last."""

    hit_id: str
    evalue: float
    bitscore: float
    bias: float
    query_start: int
    query_end: int
    hit_start: int
    hit_end: int
    columns: str

    @property
    def chain(self) -> str:
        return self.hit_id.partition("_")[2]

    @property
    def species(self) -> str:
        return self.hit_id.partition("_")[0]


@dataclass
class Parsed:
    """Domains from N to C with their states and bounds; all hits over the threshold by e-value."""

    domains: list[Hit] = field(default_factory=list)
    states: list[list[State]] = field(default_factory=list)
    starts: list[int | None] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    hits: list[Hit] = field(default_factory=list)
    reverted: bool = False


Scan = Callable[[list[str], float], list[list[Hit]]]


class ProfileScan:
    """Hits of each sequence against all profiles, in the order of the profiles' best scores. Those more than SLACK bits below the threshold may be left out; none are without one."""

    def __init__(self, profiles: list[Profile]):
        self.scanner = Scanner(profiles)
        self.models = len(profiles)
        self.last: Tables | None = None

    def _blocks(self, seqs: list[str], order: list[int]) -> Iterator[tuple[list[int], int]]:
        """Like sequences together, and how many of their residues are scored: little is scored twice, and the tables stay small."""
        block: list[int] = []
        cells, alike = 0, True
        for k in order:
            size = len(seqs[k])
            same = len(os.path.commonprefix([seqs[block[-1]], seqs[k]])) if block and len(seqs[block[-1]]) == size else 0
            # a block of sequences that begin alike ends where others begin
            if block and (len(block) == ROWS or cells + size - same > CELLS or alike and len(block) >= FEW and 3 * same < size):
                yield block, cells
                block, cells, alike, same = [], 0, True, 0
            alike = alike and (not block or 3 * same >= size)
            block.append(k)
            cells += size - same
        if block:
            yield block, cells

    def __call__(self, seqs: list[str], threshold: float | None = None) -> list[list[Hit]]:
        look = -np.inf if threshold is None else threshold - SLACK
        out: list[list[Hit]] = [[] for _ in seqs]
        order = sorted((k for k in range(len(seqs)) if seqs[k]), key=lambda k: (len(seqs[k]), seqs[k]))
        parts: list[tuple[int, int, tuple[int, int, int, int, str], str]] = []
        for block, cells in self._blocks(seqs, order):
            own = [seqs[k] for k in block]
            if self.models * cells <= KEPT:
                self.last = tables = self.scanner.tables(own, before=self.last, look=look)
                near = np.argwhere(tables.bits >= look).tolist()
                found = self.scanner.paths(tables, near)
            else:
                near = np.argwhere(self.scanner.tables(own, trace=False).bits >= look).tolist()
                found = [self.scanner.paths(self.scanner.tables([own[r]], [m]), [(0, 0)])[0] for r, m in near]
            for (r, m), domains in zip(near, found):
                k = block[r]
                cuts = [0, *(d[0] for d in domains[1:]), len(seqs[k])]
                prior = [0, *(d[1] for d in domains[:-1])]
                parts += [(k, m, d, seqs[k][a:b]) for d, a, b in zip(domains, prior, cuts[1:])]
        bits = self.scanner.forward([p[3] for p in parts], np.array([p[1] for p in parts], int))
        by: dict[int, list[Hit]] = {}
        for (k, m, (qs, qe, hs, he, cols), _), b in zip(parts, bits):
            bias = self.scanner.bias(seqs[k][qs:qe], m, hs, cols)
            b = float(b) - bias
            by.setdefault(k, []).append(Hit(self.scanner.profiles[m].name, float("%.1e" % self.scanner.evalue(b, m)), float("%.1f" % b), float("%.1f" % bias), qs, qe, hs, he, cols))
        for k, hits in by.items():
            top = {h.hit_id: max(x.bitscore for x in hits if x.hit_id == h.hit_id) for h in hits}
            out[k] = sorted(hits, key=lambda h: -top[h.hit_id])
        return out


class ReplayScan:
    """Hits known beforehand, by sequence."""

    def __init__(self, hits: dict[str, list[Hit]]):
        self.hits = hits

    def __call__(self, seqs: list[str], threshold: float | None = None) -> list[list[Hit]]:
        return [self.hits.get(s, []) for s in seqs]


def states_of(hit: Hit, first: bool, alone: bool, length: int, model_length: int) -> list[State]:
    """The hit's columns as states of the 128 positions, extended at the ends where little of the model is missing."""
    return _states(hit.columns, hit.query_start, hit.query_end, hit.hit_start, hit.hit_end, first, alone, length, model_length)


@lru_cache(4096)
def _states(cols: str, query_start: int, query_end: int, hit_start: int, hit_end: int, first: bool, alone: bool, length: int, model_length: int) -> list[State]:
    at, node = query_start, hit_start
    if first and 0 < node < 5:
        # as far as the sequence goes; where the model misses more than the sequence has, only the difference
        more = node if node <= at else min(at, node - at)
        cols, at, node = "m" * more + cols, at - more, node - more
    if alone and query_end < length and 123 < hit_end < model_length:
        cols += "m" * min(model_length - hit_end, length - query_end)
    out: list[State] = []
    for c in cols:
        out.append((node + 1, c, None if c == "d" else at))
        node += c != "i"
        at += c != "d"
    return out


def choose(hits: list[Hit], length: int, threshold: float, model_lengths: dict[str, int], species: list[str] | None = None) -> Parsed:
    """Hits over the threshold that overlap none with a lower e-value, from N to C, as states.

    With species, hits of others only count where there is none of them (reverted).
    """
    p = Parsed()
    if species and hits:
        own = [h for h in hits if h.bitscore >= threshold for s in species if h.hit_id.startswith(s)]
        p.reverted = not own
        hits = own or hits
    p.hits = [h for h in sorted(hits, key=lambda h: h.evalue) if h.bitscore >= threshold]
    for h in p.hits:
        if all(h.query_end <= d.query_start or d.query_end <= h.query_start for d in p.domains):
            p.domains.append(h)
    p.domains.sort(key=lambda h: h.query_start)
    for k, d in enumerate(p.domains):
        s = states_of(d, k == 0, len(p.domains) == 1, length, model_lengths.get(d.chain, 128))
        p.states.append(s)
        p.starts.append(s[0][2] if s else None)
        p.ends.append(d.query_end)
    return p


def needs_second_look(p: Parsed, length: int) -> int | None:
    """Index of the second cysteine (104) if the only domain ends before its last framework and much sequence follows."""
    if len(p.states) != 1 or not p.states[0]:
        return None
    last, _, at = p.states[0][-1]
    if last >= 120 or at is None or at + 30 >= length:
        return None
    return next((i for s, k, i in p.states[0] if s == 104 and k == "m"), None)


def second_look(p: Parsed, cys: int, rest: Parsed) -> None:
    """Joins the domain up to its cysteine with the last framework that a scan of the rest has found; what lies between is the loop."""
    if not rest.states or not rest.states[0]:
        return
    found = rest.states[0]
    if not (found[-1][0] >= 126 and found[0][0] <= 117):
        return
    tail = [(s, k, at + cys + 1) for s, k, at in found if s >= 117 and at is not None]
    if not tail:
        return
    head = p.states[0][: next(n for n, (s, k, _) in enumerate(p.states[0]) if s == 104 and k == "m") + 1]
    loop = [(105 + n, "m", at) if n < 11 else (116, "i", at) for n, at in enumerate(range(cys + 1, tail[0][2]))]
    p.states[0] = [*head, *loop, *tail]
    p.ends[0] = tail[-1][2] + 1


def domains_of(seqs: list[str], scan: Scan, threshold: float, model_lengths: dict[str, int], species: list[str] | None = None) -> list[Parsed]:
    """Scans, chooses and rescues for a batch; the rests that need a second look are one more batch."""
    parsed = [choose(h, len(s), threshold, model_lengths, species) for h, s in zip(scan(seqs, threshold), seqs)]
    again = [(p, c, s[c + 1 :]) for p, s in zip(parsed, seqs) if (c := needs_second_look(p, len(s))) is not None]
    if again:
        for (p, c, rest), hits in zip(again, scan([r for _, _, r in again], RESCUE)):
            second_look(p, c, choose(hits, len(rest), RESCUE, model_lengths))
    return parsed


