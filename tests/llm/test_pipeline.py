"""The pipeline's stages against brute force, each on what the one before has kept."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from vdomain.llm import mixing, packing, toxicity

from .test_documents import SCHEMA, brute_repeats, labelled, words
from .test_similar import brute


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = labelled(120)
    passage = words(rng, 40)
    rows += [(500 + k, f"{words(rng, 40)} {passage} {words(rng, 30)}", "en", f"s{k % 3}", 1) for k in range(20)]
    rows += [(700 + k, rows[k][1], "de", "s1", 1) for k in range(0, 40, 4)] + [(900, "", None, None, None), (901, None, None, "s1", None), rows[1]]
    # null and repeated ids: rows of their own, unless their texts are alike
    rows += [(None, words(rng, 50), "en", "s2", 1) for _ in range(3)] + [(3, words(rng, 50), "en", "s2", 1), (3, words(rng, 50), "en", "s0", 1), (None, rows[2][1], "en", "s2", 1)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    plain = lambda df: [tuple(r) for r in df.collect()]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], sf)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        tables.append(spark.read.parquet(str(tmp_path / f"stage{k}")))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
    before, clean, distinct, unrepeated, mixed, packed = map(plain, tables)

    net = toxicity.train(docs, lab)
    keep = [p < 0.5 for p in net.score([(r[1] or "").encode() for r in before])]
    assert Counter(clean) == Counter(r for r, k in zip(before, keep) if k) and len(clean) < len(before)

    _, group = brute([(k, *r[1:]) for k, r in enumerate(clean)])
    by_group = {}
    for r, g in zip(clean, group):
        by_group.setdefault(g, []).append(r)
    assert Counter(distinct) <= Counter(clean) and len(distinct) == len(by_group)
    for rs in by_group.values():
        least = min((r[0] is None, r[0] or 0) for r in rs)
        assert sum(r in distinct for r in {r for r in rs if (r[0] is None, r[0] or 0) == least}) == 1
    assert sum(r[0] is None for r in distinct) == 3 and sum(r[0] == 3 for r in distinct) == 3

    want = brute_repeats(distinct, 20)
    assert len(unrepeated) == len(distinct)
    plain_words = lambda t: b" ".join((t or "").encode().split())
    kept = Counter()
    for r in distinct:
        kept[r[0], *r[2:4], want[r[0], plain_words(r[1])][2]] += 1
    assert Counter((r[0], *r[2:4], hashlib.sha256(plain_words(r[1])).hexdigest()) for r in unrepeated) == kept
    assert all(r in distinct or r[4] == len(r[1]) for r in unrepeated) and Counter(unrepeated) != Counter(distinct)

    taken = Counter()
    for r in mixing.mix(tables[3]).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in mixed:
        got[r[0]] += len(r[1].split())
        assert any((o[1] or "").startswith(r[1]) for o in unrepeated if o[0] == r[0])
    assert got == +taken

    e = packing.Encoder()
    want_pieces = Counter()
    for r in mixed:
        ids = e.whole.encode(r[1], add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            own = np.array(ids[s : s + 2048], "<u4")
            want_pieces[r[0], s, len(own), zlib.crc32(own.tobytes()), len(ids)] += 1
    assert Counter(r[:5] for r in packed) == want_pieces
    assert Counter(r[:5] for r in plain(corpus_pipeline.run(spark, sf))) == want_pieces
