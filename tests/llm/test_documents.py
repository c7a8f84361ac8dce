"""Operators on documents against brute force, and on rows that are null, empty, repeated, long, or carry other columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vdomain.llm import mixing, packing, simhash, substrings, toxicity
from vdomain.llm.common import Scratch, union_pairs
from vdomain.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "mu"]


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def documents(seed=1, n=60):
    """Copies, near copies, shared passages, repeats, ties, nulls, empty and long texts."""
    rng = random.Random(seed)
    passage = words(rng, 45)
    rows = []
    for k in range(n):
        t = words(rng, rng.randint(0, 90))
        if k % 5 == 1:
            t = f"{t} {passage}\n{words(rng, 9)}"
        if k % 7 == 2 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if k % 11 == 3:
            t = f"{passage}\t {passage}"
        rows.append((1000 - 3 * k, t, "en", None if k % 9 == 4 else f"s{k % 4}", len(t or "")))
    rows += [(7, None, None, None, None), (8, "", "en", "s1", 0), (9, " \n\t ", "en", "s1", 4), (5, rows[0][1] + " tail", "en", "s2", None), (None, rows[0][1], "en", "s0", 1), (11, words(rng, 30_000), "de", "s3", 1)]
    rows.append(rows[3])  # one row twice
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).withColumn("fp", F.lit("own")).withColumn("dk", F.lit(1)).withColumn("n_words", F.lit("own")).withColumn("size", F.lit(2.5)).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- components and SimHash ---------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(-50, 50), rng.randint(-50, 50)) for _ in range(45)] + [(k, k + 1) for k in range(200, 260)] + [(k, 500) for k in range(400, 450)] + [(900, 900)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent}


def test_union_pairs_keeps_roots():
    parent = np.arange(6)
    union_pairs(parent, np.array([5, 4, 1]), np.array([4, 3, 0]))
    assert parent.tolist() == [0, 0, 2, 3, 3, 3]


def plain_fingerprint(text, n=3):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_are_those_of_the_sql_hash(spark):
    for t in ("", "One", "one TWO  three\nfour", "é É ß x", words(random.Random(3), 200)):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_anchors_cover_every_pair():
    """The code is perfect, and two values that differ in up to three bits meet at a home anchor."""
    first, patterns = simhash.coset_patterns(simhash.RADIUS)
    assert len(patterns) == 2048 and (np.diff(first) == 1).all()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for bits in range(4):
        b = a.copy()
        for k in range(len(b)):
            for p in rng.choice(64, bits, replace=False):
                b[k] ^= np.uint64(1) << np.uint64(p)
        cover = simhash.covering(1)
        home, all_ = [set() for _ in a], [set() for _ in a]
        for which, anchor, is_home in simhash.anchors_of(a, cover):
            for w, x in zip(which[is_home], anchor[is_home]):
                home[w].add(x)
        for which, anchor, _ in simhash.anchors_of(b, cover):
            for w, x in zip(which, anchor):
                all_[w].add(x)
        assert all(h & o for h, o in zip(home, all_))


def brute_components(rows, distance=3):
    fps = [plain_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    lowest = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            lowest[x] = min(lowest.get(x, r[0]), r[0])
    return fps, [lowest.get(x) for x in label]


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_simhash_components(spark, docs, monkeypatch, block):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, block))
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    rows = documents()
    fps, want = brute_components(rows)
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == Counter(zip([r[0] for r in rows], fps, want))


# --- substring dedup ----------------------------------------------------------------------------------


def brute_repeats(rows, window):
    """(id, words) to (words, removed, digest), windows in order of id (nulls last), key of the words, and start."""
    seen, out = set(), {}
    distinct = {(r[0], b" ".join((r[1] or "").encode().split())) for r in rows}
    key = lambda d: (d[0] is None, d[0] or 0, substrings.content_key(d[1].split()))
    for i, t in sorted(distinct, key=key):
        w = t.split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_longest(rows, window):
    """(id, words) to the longest of the lengths window, 2 * window, 4 * window... at which a run of it stands at another place too."""
    docs = {(r[0], b" ".join((r[1] or "").encode().split())) for r in rows}
    out = dict.fromkeys(docs, 0)
    n = window
    while True:
        runs = Counter()
        for _, t in docs:
            w = t.split()
            runs.update(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
        again = {r for r, c in runs.items() if c > 1}
        if not again:
            return out
        for d in docs:
            w = d[1].split()
            if any(tuple(w[s : s + n]) in again for s in range(len(w) - n + 1)):
                out[d] = n
        n *= 2


@pytest.mark.parametrize("window", [20, 7, 4])
@pytest.mark.parametrize("runs", [substrings.PART_RUNS, 50])
def test_substrings(spark, docs, window, runs, monkeypatch):
    monkeypatch.setattr(substrings, "PART_RUNS", runs)
    rows = documents()
    want, longest = brute_repeats(rows, window), brute_longest(rows, window)
    got = substrings.remove_repeats(docs, window=window, longest=True).select("doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept_text", "longest_repeat", "fp", "dk").collect()
    assert len(got) == len(rows)
    for r in got:
        t = b" ".join((r.text or "").encode().split())
        assert (r.n_words, r.n_removed, r.kept_sha256, r.longest_repeat) == (*want[r.doc_id, t], longest[r.doc_id, t])
        assert hashlib.sha256(t if r.kept_text is None else r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert (r.fp, r.dk) == ("own", 1)
    assert sum(r.n_removed for r in got) > 0


def test_substrings_of_nothing_and_rewritten(spark, docs, empty):
    assert substrings.digests(empty).count() == 0
    out = substrings.rewritten(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    again = substrings.rewritten(out.select(*SCHEMA_COLUMNS))
    assert again.where("size(split(text, ' ')) >= 20").count() >= 1


SCHEMA_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# --- mixing -------------------------------------------------------------------------------------------


def water(sizes):
    """Targets by source, in order: shares of all words by weight, capped at three times the source and shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def test_mixing(spark, docs, empty):
    rows = documents()
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    want = water(dict(size))
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * len([r for r in rows if r == rows[3]]) * 90
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.source))
    assert sorted(map(key, mixing.mix(docs.repartition(2)).collect())) == sorted(map(key, out))
    assert mixing.mix(empty).count() == 0


def test_complete_epochs_precede_and_heavier_documents_come_sooner(spark):
    # half of the documents have words of 10 letters and more, which quality() gives less weight
    rows = [(k, " ".join(f"{'verylongword' if k % 2 else 'word'}{j}" for j in range(10)), "en", "a" if k < 300 else "b", 0) for k in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    for r in out:
        assert r.size * int(r.target // r.source_size) <= r.taken <= r.size * (1 + int(r.target // r.source_size))
    sooner = [r.doc_id % 2 == 0 for r in out if r.source == "a" and r.taken > r.size]
    assert len(sooner) == 100 and sum(sooner) > 0.55 * len(sooner)
    heavy = mixing.mix(df, quality_of=F.when(F.col("doc_id") % 10 == 0, 1000.0).otherwise(1.0)).collect()
    assert all(r.taken > r.size * int(r.target // r.source_size) for r in heavy if r.doc_id % 10 == 0 and r.source == "a")


def test_first_words_are_as_they_stand(spark):
    texts = ["a  b\n\nc d", " \t a b", "a", "é  ü\r\nx ", "one\x0btwo three"]
    got = spark.createDataFrame([(t, n) for t in texts for n in (1, 2)], "t string, n int").select("t", "n", mixing.first_words("t", F.col("n")).alias("f")).collect()
    for r in got:
        w = r.t.encode().split()[: r.n]
        assert r.t.startswith(r.f) and r.f.encode().split() == w and r.f.encode()[-1:] == w[-1][-1:]


def test_mixed_rows_hold_what_was_taken(spark, docs, empty):
    docs = docs.withColumn("_c0", F.lit("own")).withColumn("rid", F.lit(2)).withColumn("_source", F.create_map(F.lit("a"), F.lit(1))).withColumn("_key", F.lit("own"))
    assert mixing.mixed(empty).count() == 0
    m = mixing.mixed(docs)
    assert {(r["_c0"], r.rid, r["_key"], r["_source"]["a"]) for r in m.collect()} == {("own", 2, "own", 1)}
    texts = {" ".join(r[1].split()) for r in documents() if r[1]}
    assert all(any(t.startswith(" ".join(r.text.split())) for t in texts) for r in m.select("text").collect())
    assert m.columns == docs.columns
    got = m.select(mixing.n_words().alias("n")).agg(F.sum("n")).first()[0]
    assert got == mixing.mix(docs).agg(F.sum("taken")).first()[0]


# --- packing ------------------------------------------------------------------------------------------


def test_plan_packs_every_piece_once():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 400):
        counts = np.bincount(rng.integers(0, 32, n), minlength=32)
        patterns, uses = packing.plan(counts, 32)
        assert ((patterns * uses[:, None]).sum(axis=0) == counts).all() and ((patterns * np.arange(1, 33)).sum(axis=1) <= 32).all()
        if n == 400:
            assert uses.sum() <= 1.06 * (counts * np.arange(1, 33)).sum() / 32 + 2
        seen = Counter(k for k, a, b, base, each in packing.places(patterns, uses) for _ in range(b - a))
        assert all(seen[k + 1] == counts[k] for k in range(32))


def test_best_pattern_is_the_best():
    price = np.array([0.0, 0.21, 0.3, 0.45, 0.5, 0.77])
    worth, pattern = packing.best_pattern(price, 9)
    best = max(sum(price[k] * n for k, n in enumerate(c)) for c in np.ndindex(10, 5, 4, 3, 2, 2) if sum((k + 1) * n for k, n in enumerate(c)) <= 9)
    assert worth == pytest.approx(best) and (pattern * price).sum() == pytest.approx(best)


TEXTS = ["", "a", "one two  three", " lead", "trail ", "a\n b", "tab\tand space  x", "don't I'll 12 $%&", "x<|endoftext|> y", "é ñ 漢字 🙂 " * 5, "a   b\n\n c\n", "word " * 3000, "\u0085 odd", "\x1c sep \x1f"]


def test_encoder_gives_the_tokenizers_ids():
    e = packing.Encoder()
    for t in TEXTS:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, docs, empty):
    rows = documents() + [(20_000 + k, t, "en", "x", 0) for k, t in enumerate(TEXTS)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    e = packing.Encoder()
    want = Counter()
    for i, t, *_ in rows:
        ids = e.whole.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            own = np.array(ids[s : s + 2048], "<u4")
            want[i, s, len(own), zlib.crc32(own.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty).count() == 0


# --- toxicity -----------------------------------------------------------------------------------------


def labelled(n=160, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(VOCABULARY) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(20, 260))]
        y = int(k % 4 == 0)
        if y:
            for _ in range(max(2, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["grumbus", "florpish", "zonkhead"])
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, y))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled()
    rows += [(5000, "", None, None, None), (5001, None, None, None, None), (None, "alpha beta", None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("own")).withColumn("_toxicity", F.create_map(F.lit(1), F.lit(2)))
    lab = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score_all(docs, lab).collect()
    assert len(out) == len(rows)
    y = {i: t for i, _, t in labels}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.9 * len(held)
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in out)


def test_scores_do_not_depend_on_the_batch():
    rows, labels = labelled(80)
    net = toxicity.fit([r[1].encode() for r in rows], np.array([t for *_, t in labels]), epochs=2)
    texts = [r[1].encode() for r in rows[:9]] + [b"", b"x " * 5000]
    alone = np.concatenate([net.score([t]) for t in texts])
    assert np.allclose(net.score(texts), alone, atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.fit([b"a b c", b"d e f"] * 5, np.array([1, 0] * 5), epochs=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, n, y, w = rng.standard_normal((5, 4, 2, 3 * toxicity.HIDDEN)), np.array([5, 3, 1, 4]), np.array([1, 0, 1, 0.0]), np.ones(4)
    g, dx, _ = net.gradients(x, n, y, w)
    for v, own in [(net.p[name], g[name]) for name in ("U", "A", "av", "o", "ob", "ab")] + [(x, dx)]:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in v.shape)
            old, e = v[at], 1e-3
            v[at] = old + e
            up = net.gradients(x, n, y, w)[2]
            v[at] = old - e
            down = net.gradients(x, n, y, w)[2]
            v[at] = old
            assert own[at] == pytest.approx((up - down) / 2 / e, abs=2e-3)


def test_gradients_of_inputs():
    """Of the projections and of words' and trigrams' vectors, against differences of the loss."""
    rng = np.random.default_rng(1)
    words = [b"alpha", b"beta", b"gam", b"delta", b"zz"]
    net = toxicity.fit([b"alpha beta gam", b"delta zz"] * 5, np.array([1, 0] * 5), epochs=1)
    p = net.p
    for k in p:
        p[k] = p[k].astype(np.float64)
    word_rows = np.array([0, *(net.word_row(w) for w in words)])
    tg, begin = toxicity.trigrams(words)
    size = np.diff(np.append(begin, len(tg)))
    used, at = np.arange(6), rng.integers(1, 6, (4, 3))
    length, y, w = np.array([4, 2, 3]), np.array([1, 0, 1.0]), np.ones(3)

    def loss():
        xs = toxicity.inputs_of(p, used, word_rows, tg, begin, size)
        proj = np.einsum("nd,kdh->nkh", xs, p["W"]) + p["b"]
        return net.gradients(proj[at], length, y, w), xs

    (_, dx, _), xs = loss()
    g = toxicity.input_gradients(p, dx, at, used, xs, word_rows, tg, begin, size)
    for name in ("W", "b", "Ew", "Ec"):
        v = p[name]
        rows = {"Ew": word_rows[1:], "Ec": tg}.get(name)
        for _ in range(6):
            k = tuple(rng.integers(0, s) for s in v.shape)
            if rows is not None:
                k = (int(rng.choice(rows)), *k[1:])
            old, e = v[k], 1e-3
            v[k] = old + e
            up = loss()[0][2]
            v[k] = old - e
            down = loss()[0][2]
            v[k] = old
            if name != "Ew" or k[0]:
                assert g[name][k] == pytest.approx((up - down) / 2 / e, abs=1e-4)


def test_fast_logits_are_logits():
    rng = np.random.default_rng(2)
    net = toxicity.fit([b"a b c", b"d e f"] * 5, np.array([1, 0] * 5), epochs=1)
    table = rng.standard_normal((2, 30, 3 * toxicity.HIDDEN)).astype(np.float32)
    for length in (np.array([7, 3, 1, 6]), np.array([5, 5])):
        rows = rng.integers(0, 30, (int(length.max()), len(length)))
        projected = np.stack((table[0][rows], table[1][rows]), axis=2) / net.halves
        assert np.allclose(net.fast_logits(table, rows, length), net.logits(projected.astype(np.float32), length), atol=1e-4)


def test_toxicity_without_examples(spark, empty):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_all(empty, lab).count() == 0
    one = spark.createDataFrame([(1, "alpha", "en", "s", 1)], SCHEMA)
    assert toxicity.score_all(one, lab).first().predicted == 0


def test_substring_answers_are_written_before_documents_are_dealt_out(spark, monkeypatch):
    """Each level's answers are a table of their own, so runs' shuffle files don't lie beside those of documents; no table of answers is left."""
    written, table = [], substrings.Scratch.table

    def spied(self, df, *replaces):
        out = table(self, df, *replaces)
        written.append((df.columns, out._scratch_path, [getattr(r, "_scratch_path", None) for r in replaces]))
        return out

    monkeypatch.setattr(substrings.Scratch, "table", spied)
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.longest_repeat) for r in substrings.digests(docs).collect()}
    assert got == {1: (0, 40), 2: (50, 40), 3: (0, 0)}
    answers = [path for columns, path, _ in written if columns == ["part", "number", "wins"]]
    assert len(answers) >= 2 and all(any(a in replaced for _, _, replaced in written) for a in answers)
