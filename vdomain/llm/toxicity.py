"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Inputs are words and characters: a word's vector is a trained vector of the word (words found in few
labelled texts share one) beside the mean of trained vectors of its hashed character trigrams; one
component of each starts as the smoothed log-odds of the word or trigram in the labelled texts. A text
is cut into overlapping windows, each window is read in both directions, its states are pooled by
attention, and the text's score is that of its highest window. Labels are of whole texts, so training
takes the highest windows of each text as its examples and picks them anew each epoch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, texts_of, trim

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Labelled rows that the network is fitted on, at most: those with the smallest hash of their id, by label.
MOST_TOXIC, MOST_CLEAN = 800, 1600
#: Bytes of their texts, at most: the sample ends before the row that would exceed them.
MOST_BYTES = 64 << 20
#: Labelled texts that must hold a word for it to have a vector of its own; buckets of trigrams.
LEAST_TEXTS, TRIGRAMS = 3, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, EPOCHS, BATCH = 8, 8, 16, 8, 128
#: Steps of training to take at least, and the most epochs to take them in.
STEPS, MOST_EPOCHS = 160, 40
#: Windows that are read side by side when scoring: their states stay in a core's cache.
SIDE_BY_SIDE = 512
EDGE = b".,;:!?\"'()[]{}<>|*_-#~`%&$"


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def bare(token: bytes) -> bytes:
    return token.strip(EDGE) or token


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of ^word$, one after the other, and where each word's begin."""
    wrapped = [b"^" + w + b"$" for w in words]
    raw = np.frombuffer(b"".join(wrapped) + b"\0\0", np.uint8).astype(np.uint32)
    code = raw[:-2] | (raw[1:-1] << 8) | (raw[2:] << 16)
    size = np.fromiter(map(len, wrapped), np.int64, len(wrapped))
    begin = np.cumsum(size) - size
    inside = np.ones(len(code), bool)
    ends = begin + size
    inside[ends - 1] = inside[ends - 2] = False
    n = size - 2
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14))[inside].astype(np.int64) % TRIGRAMS, np.cumsum(n) - n


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    window: int = WINDOW
    stride: int = STRIDE
    cache: dict[bytes, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    MOST_WORDS = 400_000

    # --- inputs -----------------------------------------------------------------------------------

    def word_row(self, word: bytes) -> int:
        return self.vocabulary.get(word, 0)

    def vectors(self, words: list[bytes]) -> np.ndarray:
        grams, begin = trigrams(words)
        size = np.diff(np.append(begin, len(grams)))
        chars = np.add.reduceat(self.p["Ec"][grams], begin, axis=0) / size[:, None]
        of = self.vocabulary.get
        return np.concatenate((self.p["Ew"][np.fromiter((of(w, 0) for w in words), np.int64, len(words))], chars), axis=1)

    @property
    def halves(self) -> np.ndarray:
        """1/2 for the two gates' inputs: a gate is (1 + tanh(x / 2)) / 2."""
        return np.repeat(np.array([0.5, 0.5, 1], np.float32), HIDDEN)

    def projections(self, x: np.ndarray) -> np.ndarray:
        """Input projections by direction of words' vectors, gates halved."""
        out = np.matmul(x[None].astype(np.float32), self.p["W"])  # in training 80 MB and more, so there is one of it
        out += self.p["b"][:, None]
        out *= self.halves
        return out

    def ids(self, found: list[bytes]) -> np.ndarray:
        """Rows of the two tables of input projections, gates halved; row 0 is padding."""
        cache = self.cache
        new = set(found).difference(cache)
        if self.table is None or len(cache) + len(new) + 1 > self.table.shape[1]:
            cache.clear()
            new = set(found)
            self.table = np.zeros((2, max(self.MOST_WORDS, len(new) + 1), 3 * HIDDEN), np.float32)
        if new:
            words = list(new)
            at = len(cache) + 1
            x = self.vectors([bare(w) for w in words])
            self.table[:, at : at + len(words)] = self.projections(x)
            cache.update(zip(words, range(at, at + len(words))))
        return np.fromiter(map(cache.__getitem__, found), np.int32, len(found))

    # --- the network ------------------------------------------------------------------------------

    def windows(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts of these word counts: text, start and length of each window. The last one ends with the text."""
        n = np.where(sizes <= self.window, np.minimum(sizes, 1), 1 + -(-(sizes - self.window) // self.stride))
        text = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.minimum(nth * self.stride, np.maximum(sizes[text] - self.window, 0))
        return text, start, np.minimum(self.window, sizes[text] - start)

    def logits(self, projected: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """projected: function of time is rows (time, window, direction, gates); length: words in each window."""
        T, B = projected.shape[:2]
        U, H = self.p["U"], HIDDEN
        h = np.zeros((2, B, H), np.float32)
        hs = np.zeros((T, 2, B, H), np.float32)
        saved = []
        alive = np.arange(T)[:, None] < length[None, :]
        for t in range(T):
            x = np.stack((projected[t, :, 0], projected[T - 1 - t, :, 1]))
            m = np.stack((alive[t], alive[T - 1 - t]))[:, :, None]
            a = np.matmul(h, U)
            g = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :, : 2 * H] + a[:, :, : 2 * H]))
            r, z = g[:, :, :H], g[:, :, H:]
            n = np.tanh(x[:, :, 2 * H :] + r * a[:, :, 2 * H :])
            new = n + z * (h - n)
            if keep is not None:
                saved.append((h, r, z, n, a[:, :, 2 * H :], m))
            h = np.where(m, new, h)
            hs[t, 0], hs[T - 1 - t, 1] = h[0], h[1]
        both = np.concatenate((hs[:, 0], hs[:, 1]), axis=2)  # time, window, 2H
        u = np.tanh(both @ self.p["A"] + self.p["ab"])
        e = np.where(alive, u @ self.p["av"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, both)
        if keep is not None:
            keep |= {"saved": saved, "both": both, "u": u, "w": w, "pooled": pooled, "alive": alive}
        return pooled @ self.p["o"] + self.p["ob"]

    def gradients(self, projected: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the weighted logistic loss: by parameter (but inputs), and by projected input."""
        k: dict = {}
        s = self.logits(projected, length, k)
        prob = 0.5 + 0.5 * np.tanh(0.5 * s)
        d = ((prob - label) * weight / weight.sum()).astype(np.float32)
        H, T, p = HIDDEN, projected.shape[0], self.p
        g = {"o": k["pooled"].T @ d, "ob": d.sum(keepdims=True)}
        dpool = d[:, None] * p["o"]
        dw = np.einsum("bh,tbh->tb", dpool, k["both"])
        dboth = k["w"][:, :, None] * dpool
        de = k["w"] * (dw - (k["w"] * dw).sum(axis=0))
        g["av"] = np.einsum("tb,tbh->h", de, k["u"])
        du = de[:, :, None] * p["av"] * (1 - k["u"] ** 2)
        g["A"], g["ab"] = k["both"].reshape(-1, 2 * H).T @ du.reshape(-1, du.shape[2]), du.sum(axis=(0, 1))
        dboth = dboth + du @ p["A"].T
        dx = np.zeros_like(projected)
        g["U"] = np.zeros_like(p["U"])
        dh = np.zeros((2, projected.shape[1], H), np.float32)
        for t in range(T - 1, -1, -1):
            h, r, z, n, an, m = k["saved"][t]
            dh = dh + np.stack((dboth[t, :, :H], dboth[T - 1 - t, :, H:]))
            dnew = np.where(m, dh, 0)
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate((dr, dz, dn * r), axis=2)
            dxt = np.concatenate((dr, dz, dn), axis=2)
            dx[t, :, 0] += dxt[0]
            dx[T - 1 - t, :, 1] += dxt[1]
            g["U"] += np.matmul(h.transpose(0, 2, 1), da)
            dh = np.where(m, dnew * z, dh) + np.matmul(da, p["U"].transpose(0, 2, 1))
        loss = float((weight * np.logaddexp(0, np.where(label > 0, -s, s))).sum() / weight.sum())
        return g, dx, loss

    def fast_logits(self, table: np.ndarray, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """As logits() without what training needs, from rows (time, window) of a table as projections() makes them."""
        (T, B), H = rows.shape, HIDDEN
        p, full = self.p, int(length.min()) == T
        U = np.ascontiguousarray((p["U"] * self.halves).reshape(2, H, 3, H).transpose(2, 0, 1, 3))
        inputs = [np.ascontiguousarray(table[d][rows].reshape(T, B, 3, H).transpose(0, 2, 1, 3)) for d in (0, 1)]
        h, a = np.zeros((2, B, H), np.float32), np.empty((3, 2, B, H), np.float32)
        hs = np.empty((2, T, B, H), np.float32)
        alive = np.arange(T)[:, None] < length[None, :]
        r, z, n = a
        x = np.empty((3, 2, B, H), np.float32)
        for t in range(T):
            x[:, 0], x[:, 1] = inputs[0][t], inputs[1][T - 1 - t]
            np.matmul(h, U, out=a)
            g = a[:2]
            g += x[:2]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            n *= r
            n += x[2]
            np.tanh(n, out=n)
            h -= n
            h *= z
            h += n
            if not full:
                h *= np.stack((alive[t], alive[T - 1 - t]))[:, :, None]
            hs[0, t], hs[1, T - 1 - t] = h[0], h[1]
        fwd, bwd = hs[0].reshape(-1, H), hs[1].reshape(-1, H)
        u = fwd @ p["A"][:H]
        u += bwd @ p["A"][H:]
        u += p["ab"]
        np.tanh(u, out=u)
        e = (u @ p["av"]).reshape(T, B)
        if not full:
            e[~alive] = -1e9
        e -= e.max(axis=0)
        np.exp(e, out=e)
        out = (fwd @ p["o"][:H] + bwd @ p["o"][H:]).reshape(T, B)
        out *= e
        return out.sum(axis=0) / e.sum(axis=0) + p["ob"]

    def highest(self, table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window of texts of these sizes, whose words are rows of the table, and the text of each window."""
        first = np.cumsum(sizes) - sizes
        text, start, length = self.windows(sizes)
        order = np.argsort(length, kind="stable")
        at = first[text] + start
        out = np.empty(len(text), np.float32)
        for lo in range(0, len(order), SIDE_BY_SIDE):
            k = order[lo : lo + SIDE_BY_SIDE]
            step = np.arange(int(length[k].max()))[:, None]
            rows = np.where(step < length[k], ids[np.minimum(at[k] + step, len(ids) - 1)], 0)
            out[k] = self.fast_logits(table, rows, length[k])
        return out, text

    def score(self, texts: list[bytes]) -> np.ndarray:
        """For each text the probability of its highest window; a text without words gets the network's answer to nothing."""
        words = [tokens(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.ids([w for ws in words for w in ws])
        best = np.full(len(texts), -np.inf, np.float32)
        logit, text = self.highest(self.table, ids, sizes)
        np.maximum.at(best, text, logit)
        best = np.where(np.isinf(best), self.p["ob"][0], best).astype(np.float64)
        return 0.5 + 0.5 * np.tanh(0.5 * best)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int | None = None) -> Network:
    """The network, fitted on whole labelled texts (1: toxic). Without both labels it answers the one there is, or 0.

    EPOCHS unless told otherwise, more with few texts: about STEPS steps are taken at least.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    split = [tokens(t) for t in texts]
    of = {1: Counter(), 0: Counter()}
    grams = np.zeros((2, TRIGRAMS))
    for ws, y in zip(split, labels):
        own = sorted({bare(w) for w in set(ws)})
        of[int(y)].update(own)
        if own:
            grams[int(y), np.unique(trigrams(own)[0])] += 1
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())

    def odds(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.clip((np.log((t + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))) * (t + c) / (t + c + 5), -4, 4)

    words = sorted(w for w in of[1].keys() | of[0].keys() if of[1][w] + of[0][w] >= LEAST_TEXTS)
    net = Network({w: i + 1 for i, w in enumerate(words)}, {})
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    D, H = WORD_DIM + CHAR_DIM, HIDDEN
    p = net.p
    p["Ew"], p["Ec"] = f32(len(words) + 1, WORD_DIM, scale=0.01), f32(TRIGRAMS, CHAR_DIM, scale=0.01)
    p["Ew"][0] = 0
    p["Ew"][1:, 0] = odds(np.array([of[1][w] for w in words], float), np.array([of[0][w] for w in words], float)) if words else 0
    p["Ec"][:, 0] = odds(grams[1], grams[0])
    p["W"], p["b"] = f32(2, D, 3 * H, scale=0.4), np.zeros((2, 3 * H), np.float32)
    p["U"] = f32(2, H, 3 * H, scale=0.3)
    p["A"], p["ab"], p["av"] = f32(2 * H, H, scale=0.4), np.zeros(H, np.float32), f32(H, scale=0.4)
    p["o"], p["ob"] = f32(2 * H, scale=0.4), np.zeros(1, np.float32)
    if not n1 or not n0:
        p["o"][:] = 0
        p["ob"][:] = 4 if n1 else -4
        return net
    p["ob"][:] = -1

    bag = sorted({w for ws in split for w in ws})  # the labelled texts' own words
    row = {w: i + 1 for i, w in enumerate(bag)}
    plain = [bare(w) for w in bag]
    word_rows = np.array([0, *(net.word_row(w) for w in plain)])
    tg, begin = trigrams(plain)
    tg_size = np.diff(np.append(begin, len(tg)))
    ids = np.fromiter((row[w] for ws in split for w in ws), np.int64, sum(map(len, split)))
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    first = np.cumsum(sizes) - sizes
    text, start, length = net.windows(sizes)

    def inputs() -> np.ndarray:
        chars = np.add.reduceat(p["Ec"][tg], begin, axis=0) / tg_size[:, None]
        return np.concatenate((p["Ew"][word_rows], np.concatenate((np.zeros((1, CHAR_DIM), np.float32), chars))), axis=1)

    def rows_of(k: np.ndarray) -> np.ndarray:
        step = np.arange(int(length[k].max()))[:, None]
        return np.where(step < length[k], ids[np.minimum(first[text[k]] + start[k] + step, len(ids) - 1)], 0)

    if epochs is None:
        epochs = max(EPOCHS, min(MOST_EPOCHS, STEPS * BATCH // max(1, len(texts) * 3 // 2)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step_n = 0
    for epoch in range(epochs):
        x = inputs()
        if epoch == 0:  # before any training: the window with the highest log-odds
            top = np.concatenate([(np.maximum(x[rows_of(k), 0], 0).sum(axis=0)) for k in np.array_split(np.arange(len(text)), len(text) // 4096 + 1)])
        else:
            top, _ = net.highest(net.projections(x), ids, sizes)
        order = np.lexsort((-top, text))
        rank = np.arange(len(order)) - np.repeat(np.flatnonzero(np.concatenate(([True], np.diff(text[order]) > 0))), np.unique(text, return_counts=True)[1])
        chosen = order[rank < 1]
        chosen = np.concatenate((chosen, rng.permutation(order[(rank >= 1) & (labels[text[order]] == 0)])[: len(chosen) // 2]))
        chosen = rng.permutation(chosen)
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        for lo in range(0, len(chosen), BATCH):
            k = chosen[lo : lo + BATCH]
            rows = rows_of(k)
            used, at = np.unique(rows, return_inverse=True)
            at = at.reshape(rows.shape)
            y = labels[text[k]]
            xs = x[used] if lo == 0 else inputs_of(p, used, word_rows, tg, begin, tg_size)
            proj = (np.einsum("nd,kdh->nkh", xs, p["W"]) + p["b"]).astype(np.float32)
            g, dx, _ = net.gradients(proj[at], length[k], y, np.where(y > 0, 1.5, 1.0).astype(np.float32))
            g |= input_gradients(p, dx, at, used, xs, word_rows, tg, begin, tg_size)
            step_n += 1
            for name, v in p.items():
                m1, m2 = moments[name]
                m1 += 0.1 * (g[name] - m1)
                m2 += 0.01 * (g[name] ** 2 - m2)
                slow = 0.1 if name in ("Ew", "Ec") else 1.0
                v -= (rate * slow * (m1 / (1 - 0.9**step_n)) / (np.sqrt(m2 / (1 - 0.99**step_n)) + 1e-6)).astype(np.float32)
                if name in ("W", "U", "A", "o"):
                    v *= 1 - 0.002 * rate
    return net


def spread(begin: np.ndarray, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the words' trigrams, and which of the words each belongs to."""
    n = size[words]
    which = np.repeat(np.arange(len(words)), n)
    return which, np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def inputs_of(p: dict[str, np.ndarray], used: np.ndarray, word_rows: np.ndarray, tg: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    chars = np.zeros((len(used), CHAR_DIM), np.float32)
    real = used[used > 0] - 1
    which, flat = spread(begin, size, real)
    if len(real):
        chars[used > 0] = np.add.reduceat(p["Ec"][tg[flat]], np.cumsum(size[real]) - size[real], axis=0) / size[real][:, None]
    return np.concatenate((p["Ew"][word_rows[used]], chars), axis=1)


def input_gradients(p: dict[str, np.ndarray], dx: np.ndarray, at: np.ndarray, used: np.ndarray, xs: np.ndarray, word_rows: np.ndarray, tg: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the projections and of words' and trigrams' vectors, from those by projected input: dx by (time, window), whose words are xs[at]."""
    by_word = np.argsort(at.ravel(), kind="stable")
    places = np.searchsorted(at.ravel()[by_word], np.arange(len(used) + 1))
    sums = np.concatenate((np.zeros((1, dx[0, 0].size), dx.dtype), np.cumsum(dx.reshape(at.size, -1)[by_word], axis=0, dtype=np.float64).astype(dx.dtype)))
    dproj = (sums[places[1:]] - sums[places[:-1]]).reshape(len(used), 2, -1)
    g = {"W": np.matmul(xs.T[None], dproj.transpose(1, 0, 2)), "b": dproj.sum(axis=0)}
    dxs = np.matmul(dproj.transpose(1, 0, 2), p["W"].transpose(0, 2, 1)).sum(axis=0)
    g["Ew"] = np.zeros_like(p["Ew"])
    np.add.at(g["Ew"], word_rows[used], dxs[:, :WORD_DIM])
    g["Ew"][0] = 0
    g["Ec"] = np.zeros_like(p["Ec"])
    real = used[used > 0] - 1
    which, flat = spread(begin, size, real)
    share = (dxs[used > 0, WORD_DIM:] / size[real][:, None])[which]
    for c in range(CHAR_DIM):
        g["Ec"][:, c] = np.bincount(tg[flat], share[:, c], TRIGRAMS)
    return g


# --- on tables --------------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 on division by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> Network:
    """Fits on a bounded sample of the labelled rows that aren't held out; ids with two labels count as toxic if either says so."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, most_toxic).union(pick(0, most_clean))  # most_toxic + most_clean rows of 12 bytes at most: bounded
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy(*order).limit(most_toxic + most_clean)
    # rows are bounded by now, bytes here
    sizes = found.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts, ys = [], []
    for r in sizes.where(F.col("bytes") <= most_bytes).orderBy(*order).select("text", "toxic").toLocalIterator():
        texts.append((r.text or "").encode())
        ys.append(r.toxic)
    network = fit(texts, np.array(ys))
    trim(docs.sparkSession)  # of what training has freed, before all texts are scored
    return network


def scored(docs: DataFrame, network: Network, text: str = "text", column: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `docs` (all) and each whole text's score; null text counts as empty."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    model = spark.sparkContext.broadcast((network.vocabulary, network.p))  # a few MB, bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*model.value)
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(net.score(texts_of(b.column(text))))], [*keep, column])

    keep = list(keep)
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias(column))._jdf.schema().toDDL()
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of `docs`, repeated and null ids too (a null id isn't held out).

    Null and empty texts get the network's answer to nothing. Labels that are null, of other values or of no document are passed over. Columns of
    `docs` other than id and text aren't read. Without labelled rows every score is the same.
    """
    net = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), net, column="score", keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that score 0.5 or more. labels: doc_id, toxic. Null and empty texts, null and repeated ids are treated as in score_all(); columns may have any name and type."""
    mark = "_toxicity"
    while mark in docs.columns:
        mark = "_" + mark
    return scored(docs, train(docs, labels), column=mark).where(F.col(mark) < 0.5).drop(mark)
