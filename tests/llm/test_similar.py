"""The pipeline's near-duplicates against brute force over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from vdomain.llm import simhash, similar

from .test_documents import SCHEMA, empty, plain_fingerprint, words  # noqa: F401


def edited(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    label, pairs = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                pairs.append((i, j))
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return pairs, [min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in label]


def test_stage_finds_every_similar_pair(spark, tmp_path, empty):  # noqa: F811
    rng = random.Random(4)
    passage, texts = words(rng, 60), [words(rng, rng.randint(3, 300)) for _ in range(40)]
    for t in texts[:20]:
        n = len(t.split())
        texts += [edited(rng, t, min(n, max(1, round(n * part)))) for part in (0.01, 0.02, 0.03, 0.06)]
    texts += [edited(rng, passage, 1) for _ in range(30)] + [f"{passage} {words(rng, 40)}" for _ in range(15)] + ["", None, texts[0].upper()]
    rng.shuffle(texts)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    pairs, want = brute(rows)
    far = [(i, j) for i, j in pairs if (plain_fingerprint(rows[i][1]) ^ plain_fingerprint(rows[j][1])).bit_count() > 3]
    assert len(far) > 20  # pairs that fingerprints within three bits leave in
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert [got[k] for k in range(len(rows))] == want
    kept = corpus_pipeline.distinct(spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.near_duplicate_groups(empty).count() == 0


def test_rows_are_told_apart_by_place(spark):
    """Null and repeated ids, and columns of any name and type: one row of each group of texts stays, and no other goes."""
    rng = random.Random(6)
    texts = [words(rng, 30) for _ in range(8)]
    ids = [None, None, None, 1, 1, 2, 3, 4]
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts)] + [(9, texts[0], "en", "s", 1), (None, texts[6], "en", "s", 1), (1, texts[3], "de", "s", 2), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("rid", F.lit("own")).withColumn("_c0", F.lit(7)).withColumn("root", F.lit(8)).repartition(4)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.dtypes == docs.dtypes
    out = kept.collect()
    assert sorted(r.text or "" for r in out) == sorted(["", *texts])
    by = {r.text: r for r in out}
    assert by[texts[0]].doc_id == 9 and by[texts[6]].doc_id == 3 and all((r.m, r.rid, r["_c0"], r.root) == ({"k": 1}, "own", 7, 8) for r in out)
    assert [r.doc_id for r in out if not r.text] == [5]


def test_a_large_group_is_dealt_out(spark, monkeypatch):
    rng = random.Random(7)
    for name, value in (("BLOCK", 8), ("VERIFIED", 4)):
        monkeypatch.setattr(similar, name, value)
    base = words(rng, 80)
    rows = [(k, edited(rng, base, 1), "en", "s", 1) for k in range(60)] + [(100 + k, edited(rng, base, 9), "en", "s", 1) for k in range(30)]
    pairs, want = brute(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[r[0]] for r in rows] == want


def test_what_a_band_leaves_apart_gives_no_more_rows_than_it_has(spark, monkeypatch):
    """Documents that share much, but not 0.8: pairs grow with the square of their number, rows do not."""
    monkeypatch.setattr(similar, "GATHERED", 16)
    rng = random.Random(8)
    base = words(rng, 90)
    docs = spark.createDataFrame([(k, edited(rng, base, 3), "en", "s", 1) for k in range(80)], SCHEMA).select(F.col("doc_id").alias("rid"), F.col("doc_id").alias("id"), "text")
    scratch = similar.Scratch(spark, "test")
    nodes = scratch.table(similar.sketched(docs).withColumn("node", F.col("rid")))
    members = similar.banded(nodes, scratch)
    roots = spark.createDataFrame([], "node long, root long")
    maybe = similar.suspects(members, roots, 0.8)
    assert 40 < maybe.count() < members.count()
    groups = simhash.connected_components(maybe, scratch).select("node", F.col("root").alias("group"))
    found = similar.joined(groups, roots, nodes, docs.select("rid", "text"), nodes.select("node", "rid"), 0.8, scratch)
    rows = [(r.rid, r.text) for r in docs.collect()]
    pairs, _ = brute(rows)
    assert found.count() < 80 and {(r.b, r.a) for r in found.collect()} <= {(max(rows[i][0], rows[j][0]), min(rows[i][0], rows[j][0])) for i, j in pairs}
