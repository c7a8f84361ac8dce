"""Profile hidden Markov models: reading, building from aligned genes, and local multi-hit scans over batches (numpy)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .sw import MATRIX

AMINO = "ACDEFGHIKLMNPQRSTVWY"
# Amino-acid background frequencies, in the order of AMINO.
BACKGROUND = np.array([0.0787945, 0.0151600, 0.0535222, 0.0668298, 0.0397062, 0.0695071, 0.0229198, 0.0590092, 0.0594422, 0.0963728, 0.0237718, 0.0414386, 0.0482904, 0.0395639, 0.0540978, 0.0683364, 0.0540687, 0.0673417, 0.0114135, 0.0304133])
#: Sequences that begin alike from which on models are bounded before they part.
MANY = 4
#: Rows that are summed at once.
SUMMED = 256
#: Number of models that an e-value counts, whatever the number searched.
Z = 29
LN2, NEG = math.log(2), -1e9
DEFAULT_TAIL = (-4.0, 0.71)
_INDEX = np.full(256, 20, np.uint8)  # 20: any residue
_INDEX[np.frombuffer(AMINO.encode(), np.uint8)] = np.arange(20)
_INDEX[np.frombuffer(AMINO.lower().encode(), np.uint8)] = np.arange(20)


@dataclass(frozen=True)
class Profile:
    """match: probabilities (nodes, 20); step: probabilities m->m, m->i, m->d, i->m, i->i, d->m, d->d out of nodes 0..nodes; tail: location and slope of forward scores."""

    name: str
    match: np.ndarray
    step: np.ndarray
    tail: tuple[float, float] = DEFAULT_TAIL


def parse_hmm(text: str) -> list[Profile]:
    """Models of a HMMER3/f text, in order."""
    out = []
    for record in text.split("\n//"):
        lines = record.strip().splitlines()
        if not lines:
            continue
        if not lines[0].startswith("HMMER3/"):
            raise ValueError("not a HMMER3 profile file")
        head = {f[0]: f[1:] for f in map(str.split, lines) if f}
        tail = next(((float(f[3]), float(f[4])) for f in map(str.split, lines) if f[:3] == ["STATS", "LOCAL", "FORWARD"]), DEFAULT_TAIL)
        size = int(head["LENG"][0])
        at = next(k for k, x in enumerate(lines) if x.startswith("HMM ")) + 2
        at += lines[at].split()[0] == "COMPO"
        prob = lambda fields: np.array([0.0 if f == "*" else math.exp(-float(f)) for f in fields])
        step, match = np.zeros((size + 1, 7)), np.zeros((size, 20))
        step[0] = prob(lines[at + 1].split()[:7])
        for k in range(size):
            row = lines[at + 2 + 3 * k : at + 5 + 3 * k]
            match[k], step[k + 1] = prob(row[0].split()[1:21]), prob(row[2].split()[:7])
        out.append(Profile(head["NAME"][0], match, step, tail))
    if not out:
        raise ValueError("the profile file holds no model")
    return out


def build(name: str, aligned: list[str], strength: float = 3.0) -> Profile:
    """A profile from aligned genes: V and J genes each cover a part of the columns.

    Counts of a column are mixed with residues that substitute for what is seen there (by BLOSUM62), and with the background where
    nothing is seen. A column that many of the genes around it skip is easy to delete.
    """
    size = len(aligned[0])
    rows = np.array([_INDEX[np.frombuffer(a.encode(), np.uint8)] for a in aligned])
    gap = np.array([[c == "-" for c in a] for a in aligned])
    codes = [ord(c) for c in AMINO]
    like = BACKGROUND[None, :] * 2.0 ** (MATRIX[np.ix_(codes, codes)] / 2)
    like /= like.sum(axis=1, keepdims=True)
    inside = np.zeros(gap.shape, bool)
    for k, a in enumerate(aligned):
        lo, hi = size - len(a.lstrip("-")), len(a.rstrip("-"))
        inside[k, lo:hi] = True
    match, skipped = np.zeros((size, 20)), np.zeros(size)
    for c in range(size):
        seen = rows[~gap[:, c] & (rows[:, c] < 20), c]
        n = np.bincount(seen, minlength=20)[:20].astype(float)
        f = n / n.sum() if n.sum() else BACKGROUND
        match[c] = (n.sum() * f + strength * (f @ like if n.sum() else BACKGROUND)) / (n.sum() + strength)
        if inside[:, c].any():
            skipped[c] = (gap[:, c] & inside[:, c]).sum() / inside[:, c].sum()
        else:
            skipped[c] = 0.5
    into = np.append(np.clip(skipped, 0.004, 0.9), 0.0)  # by the column entered
    step = np.zeros((size + 1, 7))
    step[:, 1] = 0.008
    step[:, 2] = into * (1 - step[:, 1])
    step[:, 0] = 1 - step[:, 1] - step[:, 2]
    step[:, 3], step[:, 4] = 0.54, 0.46
    on = np.append(np.clip(0.35 + 0.6 * skipped, 0, 0.95), 0.0)
    step[:, 5], step[:, 6] = 1 - on, on
    return Profile(name, match, step)


def differ(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sorted rows of letters the first place at which each differs from the one before it; 0 where their lengths differ."""
    out = np.zeros(len(n), np.int64)
    if len(n) > 1:
        other = x[1:] != x[:-1]
        out[1:] = np.where(n[1:] != n[:-1], 0, np.where(other.any(axis=1), other.argmax(axis=1), n[1:]))
    return out


def _running_max(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maxima so far along the first axis, and the other array: both are overwritten."""
    if a.shape[1] * a.shape[2] < 16:
        return np.maximum.accumulate(a, axis=0, out=b), a
    by = 1
    while by < len(a):
        np.maximum(a[by:], a[:-by], out=b[by:])
        b[:by] = a[:by]
        a, b, by = b, a, 2 * by
    return a, b


@dataclass
class Tables:
    """Scores by step: M, I and D (row, model, node from 1), B, J, C, E and N; place: by step the row of each sequence; bits: (sequence, model).

    In memory nodes come first: slices for a step to the next node then lie in one piece, and maxima over nodes are those of whole rows.
    """

    which: list[int]
    x: np.ndarray
    n: np.ndarray
    leave: np.ndarray
    g: dict[str, np.ndarray]
    run: np.ndarray
    emit: np.ndarray
    bits: np.ndarray
    steps: list[tuple]
    place: list[np.ndarray]
    left: np.ndarray  # models that steps from `full` on hold
    full: int

    def shared(self, x: np.ndarray, n: int, most: int) -> list[tuple]:
        """The last sequence's steps as far as another of n letters x has the same beginning, `most` at most."""
        if not len(self.n) or int(self.n[-1]) != n:
            return []
        other = np.flatnonzero(self.x[-1, :n] != x[:n])
        same = min(int(other[0]) if len(other) else n - 1, most, n - 1, len(self.steps), self.full)
        return [tuple(a if len(a) == 1 else a[-1:].copy() for a in s) for s in self.steps[:same]]


class Scanner:
    """Profiles as tensors, for scans of batches of rows; a row is a sequence against one profile."""

    def __init__(self, profiles: list[Profile]):
        self.profiles = profiles
        odds = np.stack([np.concatenate((p.match / BACKGROUND, np.ones((len(p.match), 1))), axis=1) for p in profiles])  # (model, node, letter)
        self.odds = np.ascontiguousarray(odds.transpose(0, 2, 1))
        self.log_odds = np.log(np.maximum(self.odds, 1e-30)).astype(np.float32)
        step = np.stack([p.step for p in profiles])
        self.size = step.shape[1] - 1
        occupied = np.zeros((len(profiles), self.size))
        occupied[:, 0] = step[:, 0, 0] + step[:, 0, 1]
        for k in range(1, self.size):
            occupied[:, k] = occupied[:, k - 1] * (step[:, k, 0] + step[:, k, 1]) + (1 - occupied[:, k - 1]) * step[:, k, 5]
        self.entry = occupied / (occupied * np.arange(self.size, 0, -1)).sum(axis=1, keepdims=True)
        # into node k from node k-1 (the first has no node before it), and out of node k
        self.mm, self.im, self.dm = (np.concatenate((np.zeros((len(profiles), 1)), step[:, 1:-1, c]), axis=1) for c in (0, 3, 5))
        self.mi, self.ii, self.md, self.dd = (step[:, 1:, c] for c in (1, 4, 2, 6))
        with np.errstate(divide="ignore"):
            self.l = {k: np.maximum(np.log(getattr(self, k)), NEG).astype(np.float32) for k in ("entry", "mm", "im", "dm", "mi", "ii", "md", "dd")}
        # deletes: the way from a match at j to a delete at k > j, for sums; and running sums of log d->d for maxima
        log_dd = np.where(self.dd > 0, np.log(np.maximum(self.dd, 1e-30)), -30)
        self.run = np.concatenate((np.zeros((len(profiles), 1)), np.cumsum(log_dd, axis=1)[:, :-1]), axis=1)  # up to before k
        j, k = np.arange(self.size)[:, None], np.arange(self.size)[None, :]
        way = np.zeros((len(profiles), self.size, self.size))
        for m in range(len(profiles)):
            w = self.run[m][None, :] - (self.run[m][:, None] + log_dd[m][:, None])
            way[m] = np.where(k > j, self.md[m][:, None] * np.exp(np.minimum(w, 0)), 0)
        self.way = way
        # the same as running sums, where no weight leaves the range of doubles: what enters at j, and what of that comes to the match after k
        self.open, self.kept = self.md * np.exp(-np.maximum(self.run + log_dd, -300)), np.exp(np.maximum(self.run, -300)) * np.append(self.dm[:, 1:], np.zeros((len(profiles), 1)), axis=1)
        self.kept[:, 0] = 0
        self.summed = (self.run + log_dd).min(axis=1) > -300
        self.means: dict[tuple[int, int, str], np.ndarray] = {}

    @staticmethod
    def letters(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(s) for s in seqs])
        x = np.full((len(seqs), int(n.max(initial=0))), 20, np.uint8)
        for k, s in enumerate(seqs):
            x[k, : len(s)] = _INDEX[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
        return x, n

    def _flank(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of staying in and of leaving a flank, and the null model's log score, for sequences of these lengths."""
        n = np.maximum(n, 1).astype(np.float64)
        return np.log(n / (n + 3)), np.log(3 / (n + 3)), n * np.log(n / (n + 1)) + np.log(1 / (n + 1))

    def viterbi(self, seqs: list[str], models: np.ndarray) -> np.ndarray:
        """Best path's bits per row."""
        out = np.zeros(len(seqs))
        for m in np.unique(models).tolist():
            rows = sorted(np.flatnonzero(models == m).tolist(), key=lambda r: (len(seqs[r]), seqs[r]))
            out[rows] = self.tables([seqs[r] for r in rows], [m], trace=False).bits[:, 0]
        return out

    def tables(self, seqs: list[str], models: list[int] | None = None, trace: bool = True, before: Tables | None = None, look: float = -np.inf) -> Tables:
        """Best paths' scores of sequences, sorted by length and letters, under these models (all of them).

        A row stands for what sequences of one length have in common up to a residue, so that is scored once. before: the tables of the sequences
        that come before these, whose last one may begin as the first of these does. look: models under which none of the sequences can reach that many
        bits are given up where the sequences part; their bits are -inf.
        """
        which = list(range(len(self.profiles))) if models is None else models
        x, n = self.letters(seqs)
        stay, leave, null = (a[None, None, :].astype(np.float32) for a in self._flank(n))
        g = {k: v[which] for k, v in self.l.items()}
        run, emit = self.run[which].astype(np.float32), self.log_odds[which]
        W, S, half = len(which), self.size, np.float32(math.log(0.5))
        since = differ(x, n)
        done = Tables(which, x, n, leave, g, run, emit, np.zeros((len(seqs), W), np.float32), [], [], np.arange(W), 0)
        parting = int(since[1:].min(initial=x.shape[1]))
        done.full = x.shape[1]
        if trace and before is not None and before.which == which and len(seqs):
            done.steps = before.shared(x[0], int(n[0]), parting)
            done.place = [np.zeros(len(seqs), np.int32)] * len(done.steps)
        start = len(done.steps)
        every = np.arange(len(seqs))
        if start:
            M, I, D, B, J, C, _, N = (a.transpose(2, 1, 0) for a in done.steps[-1])
            reps = every[:1]
        else:
            reps = every[(since <= 0) & (n > 0)]
            M = np.full((S + 1, W, len(reps)), NEG, np.float32)
            I, D = M.copy(), M.copy()
            N, B = np.zeros((1, 1, len(reps)), np.float32), leave[:, :, reps].copy()
            J = np.full((1, W, len(reps)), NEG, np.float32)
            C = J.copy()
        own_stay, own_leave = stay[:, :, reps], leave[:, :, reps]
        spare: tuple = ()
        into = self._by_node(g, run, emit)
        for t in range(start, x.shape[1]):
            if t == parting and t > 0 and len(seqs) >= MANY and look > -np.inf:
                most = self._most((M, I, D, J, C, N), g, run, emit, x[:, t:], stay[0, 0, 0], leave[0, 0, 0], half)
                left = np.flatnonzero((most - null[0, 0, 0]) / LN2 >= look - 0.1)
                if len(left) < W:
                    done.bits[:] = -np.inf
                    done.full, done.left = t, left
                    g, run, emit, W = {k: v[left] for k, v in g.items()}, run[left], emit[left], len(left)
                    M, I, D, B, J, C = (a[:, left] if a.shape[1] > 1 else a for a in (M, I, D, B, J, C))
                    spare, into = (), self._by_node(g, run, emit)
                if not W:
                    break
            now = every[(since <= t) & (n > t)]
            if len(now) != len(reps) or (now != reps).any():
                up = np.searchsorted(reps, now, "right") - 1
                M, I, D, B, J, C, N = (np.repeat(a, len(now), axis=2) if a.shape[2] == 1 else a.take(up, axis=2) for a in (M, I, D, B, J, C, N))
                reps, own_stay, own_leave = now, stay[:, :, now], leave[:, :, now]
            if not spare or spare[0].shape[2] != len(reps):
                spare, by = tuple(np.empty((S, W, len(reps)), np.float32) for _ in range(2)), into
            elif by is into and len(reps) > 1:
                # as many rows as a step before: others will follow, and values that are there for each row are added faster
                by = {k: np.repeat(v, len(reps), axis=2) for k, v in into.items() if k != "emit"}
            one, two = spare
            new, ins, dels = (np.empty((S + 1, W, len(reps)), np.float32) for _ in range(3))
            for a in (new, ins, dels):
                a[0] = NEG
            core = new[1:]
            np.add(M[:-1], by["mm"], out=core)
            np.maximum(core, np.add(I[:-1], by["im"], out=one), out=core)
            np.maximum(core, np.add(D[:-1], by["dm"], out=one), out=core)
            np.maximum(core, np.add(B, by["entry"], out=one), out=core)
            letter = x[reps, t]
            core += into["emit"][letter[:1] if (letter == letter[0]).all() else letter].transpose(1, 2, 0)
            np.maximum(np.add(M[1:], by["mi"], out=one), np.add(I[1:], by["ii"], out=two), out=ins[1:])
            # a delete at k: best of matches before it, less the d->d steps up to it
            np.add(core, by["md"], out=one)
            one -= by["run"]
            one -= by["dd"]
            one, two = _running_max(one, two)
            dels[1] = NEG
            np.add(one[:-1], by["run"][1:], out=dels[2:])
            M, I, D = new, ins, dels
            E = np.maximum(M.max(axis=0, keepdims=True), D.max(axis=0, keepdims=True))
            J, C, N = np.maximum(J + own_stay, E + half), np.maximum(C + own_stay, E + half), N + own_stay
            B = np.maximum(N, J) + own_leave
            ended = np.flatnonzero(n[reps] == t + 1)
            at = np.searchsorted(reps, every, "right") - 1
            if len(ended):
                mine = np.flatnonzero(n == t + 1)
                done.bits[mine[:, None], done.left] = ((C + own_leave)[0][:, at[mine]] - null[0, :, mine].T).T / LN2
            if trace:
                done.steps.append(tuple(a.transpose(2, 1, 0) for a in (M, I, D, B, J, C, E, N)))
                done.place.append(at)
        return done

    @staticmethod
    def _by_node(g: dict[str, np.ndarray], run: np.ndarray, emit: np.ndarray) -> dict[str, np.ndarray]:
        """The models' values as the tables of a scan go: (node, model, 1), and emit: (letter, node, model)."""
        out = {k: np.ascontiguousarray(v.T)[:, :, None] for k, v in {**g, "run": run}.items()}
        return {**out, "emit": np.ascontiguousarray(emit.transpose(1, 2, 0))}

    @staticmethod
    def _most(state: tuple, g: dict[str, np.ndarray], run: np.ndarray, emit: np.ndarray, rest: np.ndarray, stay: np.ndarray, leave: np.ndarray, half: np.float32) -> np.ndarray:
        """By model a bound of the log scores of sequences that share this state and go on with these letters: at each place the letter counts that fits a node best."""
        W, S = run.shape
        none = np.full((W, 1), NEG, np.float32)
        after = lambda a: np.concatenate((a[:, 1:], none), axis=1)
        mm, im, dm = (after(g[k]) for k in ("mm", "im", "dm"))
        match, ins = np.full((W, S), NEG, np.float32), np.full((W, S), NEG, np.float32)
        again, end, begin = none, np.broadcast_to(leave, (W, 1)), none
        for t in range(rest.shape[1], -1, -1):
            if t < rest.shape[1]:
                gained = match + emit[:, np.unique(rest[:, t])].max(axis=1)  # by node that the next letter goes to
                start = (g["entry"] + gained).max(axis=1, keepdims=True) + leave
                again, begin, end = np.maximum(again + stay, start), np.maximum(begin + stay, start), end + stay
                to, ins_to = after(gained), ins
            else:
                to = ins_to = np.full((W, S), NEG, np.float32)
            out = half + np.maximum(again, end)
            dels = np.maximum(dm + to, out)
            skip = after(np.maximum.accumulate((run + dels)[:, ::-1], axis=1)[:, ::-1])
            match = np.maximum(np.maximum(mm + to, g["mi"] + ins_to), np.maximum(out, g["md"] - run - g["dd"] + skip))
            ins = np.maximum(im + to, g["ii"] + ins_to)
        M, I, D, J, C, N = (a[:, :, 0].T for a in state)
        most = [(M[:, 1:] + match).max(axis=1), (I[:, 1:] + ins).max(axis=1), (D[:, 1:] + dels).max(axis=1), (J + again)[:, 0], (C + end)[:, 0], (N + begin)[:, 0]]
        return np.max(most, axis=0)

    def paths(self, tables: Tables, rows: list[tuple[int, int]]) -> list[list[tuple[int, int, int, int, str]]]:
        """For rows (sequence, place of the model in the tables) the domains of the best path: (query start, query end, node start, node end, columns), ends exclusive.

        Columns are m, i and d from the first match to the last. What paths have in common towards the start is followed once.
        """
        half = np.float32(math.log(0.5))
        x, n, g, run, emit, leave = tables.x, tables.n, tables.g, tables.run, tables.emit, tables.leave
        mm, im, dm, mi, md, dd, entry = (g[k] for k in ("mm", "im", "dm", "mi", "md", "dd", "entry"))
        close = lambda a, b: abs(float(a) - float(b)) < 1e-2
        known: dict[tuple[int, int, int, int], tuple] = {}
        out = []
        for r, w in rows:
            domains: list[tuple[int, int, int, int, str]] = []
            texts: list[str] = []  # columns from last to first
            marks: list[tuple[tuple[int, int, int, int], int, int]] = []
            t = int(n[r]) - 1
            state = "C"
            cols: list[str] = []
            k = 0
            late = int(np.searchsorted(tables.left, w))

            def ended(text: str, t: int, k: int) -> None:
                texts.append(text)
                text = text[::-1].rstrip("d")
                domains.append((t, t + len(text) - text.count("d"), k, k + len(text) - text.count("i"), text))

            while t >= 0:
                u = tables.place[t][r]
                M, I, D, B, J, C, E, N = tables.steps[t]
                v = w if t < tables.full else late
                if state in "CJ":
                    if close((C if state == "C" else J)[u, v, 0], E[u, v, 0] + half):
                        state = "M" if M[u, v].max() >= D[u, v].max() else "D"
                        k, cols = int(np.argmax((M if state == "M" else D)[u, v, 1:])), []
                    else:
                        t -= 1
                    continue
                if state == "N":
                    break
                if state == "D":
                    cols.append("d")
                    ways = M[u, v, 1 : k + 1] + md[w, :k] - run[w, :k] - dd[w, :k]
                    j = int(np.argmax(ways))
                    cols += ["d"] * (k - j - 1)
                    k, state = j, "M"
                    continue
                up = tables.place[t - 1][r] if t else 0
                v_up = w if t - 1 < tables.full else late
                if state == "I":
                    cols.append("i")
                    state = "M" if close(I[u, v, k + 1], tables.steps[t - 1][0][up, v_up, k + 1] + mi[w, k]) else "I"
                    t -= 1
                    continue
                if t % 4 == 0:
                    key = (w, t, int(u), k)
                    if found := known.get(key):
                        text, t, k, earlier = found
                        ended("".join(cols) + text, t, k)
                        domains += earlier
                        # what comes before is known under this mark, and not marked anew
                        break
                    marks.append((key, len(cols), len(domains)))
                cols.append("m")
                value = M[u, v, k + 1] - emit[w, x[r, t], k]
                before = tables.steps[t - 1] if t else None
                start_b = before[3][up, v_up, 0] if before else leave[0, 0, r]
                if t == 0 or k == 0 or close(value, start_b + entry[w, k]):
                    ended("".join(cols), t, k)
                    t -= 1
                    if t < 0:
                        break
                    state = "J" if before[4][up, v_up, 0] >= before[7][up, 0, 0] and before[4][up, v_up, 0] > NEG / 2 else "N"
                    continue
                from_m, from_i, from_d = before[0][up, v_up, k] + mm[w, k], before[1][up, v_up, k] + im[w, k], before[2][up, v_up, k] + dm[w, k]
                state = "M" if from_m >= from_i and from_m >= from_d else "I" if from_i >= from_d else "D"
                k, t = k - 1, t - 1
            for key, size, nth in marks:
                known[key] = (texts[nth][size:], domains[nth][0], domains[nth][2], domains[nth + 1 :])
            out.append(domains[::-1])
        return out

    def forward(self, seqs: list[str], models: np.ndarray) -> np.ndarray:
        """Bits of all paths together, per row; scaled sums of probabilities."""
        out = np.zeros(len(seqs))
        for m in np.unique(models).tolist():
            rows = sorted(np.flatnonzero(models == m).tolist(), key=lambda r: (len(seqs[r]), seqs[r]))
            for lo in range(0, len(rows), SUMMED):
                part = rows[lo : lo + SUMMED]
                out[part] = self._forward([seqs[r] for r in part], m)
        return out

    def _forward(self, seqs: list[str], m: int) -> np.ndarray:
        """The same for sequences, sorted by length and letters, under one model; what they have in common at the start is summed once."""
        x, n = self.letters(seqs)
        stay, leave, null = self._flank(n)
        s, v = np.exp(stay)[:, None], np.exp(leave)[:, None]
        mi, ii, entry = (getattr(self, k)[m] for k in ("mi", "ii", "entry"))
        mm, im, dm = (np.append(getattr(self, k)[m, 1:], 0.0) for k in ("mm", "im", "dm"))
        S, odds, way, summed = self.size, self.odds[m], self.way[m], bool(self.summed[m])
        opened, kept, ends = self.open[m], self.kept[m], 1 + way.sum(axis=1, keepdims=True)  # a domain ends in a match, or in a delete after it
        since, every = differ(x, n), np.arange(len(seqs))
        reps = every[(since <= 0) & (n > 0)]
        # M, I: what is in nodes so far; D: what comes to the match after each node by its delete
        M = np.zeros((len(reps), S))
        I, D = M.copy(), M.copy()
        N, J, C = np.ones((len(reps), 1)), np.zeros((len(reps), 1)), np.zeros((len(reps), 1))
        B, scale = v[reps], np.zeros((len(reps), 1))
        own_s, own_v = s[reps], v[reps]
        final = np.full(len(seqs), NEG)
        one = np.empty((0, S))
        for t in range(x.shape[1]):
            now = every[(since <= t) & (n > t)]
            if len(now) != len(reps) or (now != reps).any():
                up = np.searchsorted(reps, now, "right") - 1
                M, I, D, N, J, C, B, scale = (a[up] for a in (M, I, D, N, J, C, B, scale))
                reps, own_s, own_v = now, s[now], v[now]
            if len(one) != len(reps):
                one, flat = np.empty((len(reps), S)), np.zeros(len(reps) * S + 1)
                go, come = flat[1:].reshape(-1, S), flat[:-1].reshape(-1, S)  # the same, one node on; nothing leaves the last one
            # what leaves each node for the next match
            np.multiply(M, mm, out=go)
            go += np.multiply(I, im, out=one)
            go += D
            np.multiply(I, ii, out=I)
            I += np.multiply(M, mi, out=one)
            np.multiply(B, entry, out=M)
            M += come
            letter = x[reps, t]
            M *= odds[letter[0] if (letter == letter[0]).all() else letter]
            if summed:
                np.cumsum(np.multiply(M, opened, out=one), axis=1, out=go)
                np.multiply(come, kept, out=D)
            else:
                np.matmul(M, way, out=D)
                D *= dm
            E = M @ ends
            J, C, N = J * own_s + E * 0.5, C * own_s + E * 0.5, N * own_s
            B = (N + J) * own_v
            if t % 8 == 7:  # odds stay under 1e16 or so in between
                total = N + J + C + E
                for a in (M, I, D, N, J, C, B):
                    a /= total
                scale += np.log(total)
            ended = np.flatnonzero(n == t + 1)
            if len(ended):
                at = np.searchsorted(reps, ended, "right") - 1
                final[ended] = np.log(np.maximum(C[at, 0] * own_v[at, 0], 1e-300)) + scale[at, 0]
        return (final - null) / LN2

    def bias(self, residues: str, model: int, node: int, columns: str) -> float:
        """Bits that the domain's composition explains: its residues under the mean emission of the states that its path visits, at odds of 1 to 256."""
        mean = self._mean(model, node, columns)
        x = _INDEX[np.frombuffer(residues.encode("latin-1", "replace"), np.uint8)]
        return float(np.logaddexp(0, mean[x[x < 20]].sum() - 8 * LN2) / LN2)

    def _mean(self, model: int, node: int, columns: str) -> np.ndarray:
        """By residue the log of its mean odds over these states."""
        if (found := self.means.get((model, node, columns))) is None:
            at = node + np.cumsum([c != "i" for c in columns]) - 1
            match = at[[c == "m" for c in columns]]
            inserted = columns.count("i")
            if len(self.means) >= 4096:
                self.means.clear()
            found = self.means[model, node, columns] = np.log((self.odds[model][:20, match].sum(axis=1) + inserted) / max(1, len(match) + inserted))
        return found

    def evalue(self, bits: float, model: int) -> float:
        mu, slope = self.profiles[model].tail
        return Z * min(1.0, math.exp(-slope * (bits - mu))) if bits > mu else float(Z)
