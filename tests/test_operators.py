import pytest
from pyspark.sql import functions as F

from vdomain.functions.alignment import sw_identity, sw_score
from vdomain.kernel.schemes import Symmetric
from vdomain.operators import germline, hits, numbering, regions, sequences
from vdomain.plans import engine as E
from vdomain.sources.fasta import BAD, FastaDataSource, read_fasta, records
from vdomain.sources.reference import load_genes, load_profiles
from vdomain.streaming.annotate import annotate_stream

from .test_kernel import LYSOZYME, VH, VK


@pytest.mark.parametrize(
    ("lo", "hi", "want"),
    [
        (1, 128, ["complete"] * 7),
        (27, 38, ["absent", "complete", *["absent"] * 5]),
        (39, 128, ["absent", "absent", *["complete"] * 5]),
        (20, 60, ["partial", "complete", "complete", "partial", "absent", "absent", "absent"]),
        (66, 104, ["absent"] * 4 + ["complete", "absent", "absent"]),
        (100, 110, ["absent"] * 4 + ["partial", "partial", "absent"]),
        (128, 128, ["absent"] * 6 + ["partial"]),
        (None, None, ["absent"] * 7),
    ],
)
def test_regions(spark, lo, hi, want):
    df = spark.createDataFrame([(lo, hi)], "lo int, hi int")
    assert list(df.select(*regions.annotate("lo", "hi").values()).first()) == want


def test_validation_and_replay(spark):
    df = spark.createDataFrame([(1, "ACD"), (2, "acdX1"), (3, "A" * 10_000), (4, None), (5, "ACD")], "k int, sequence string")
    out = sequences.once_per_sequence(df, lambda d: d.withColumn("error", sequences.validation_error("sequence")))
    got = {r.k: r.error for r in out.collect()}
    assert got == {1: None, 2: "Unknown amino acid letter found in sequence: 1, X", 3: "Sequence too long.", 4: None, 5: None}


def test_contiguity(spark):
    kind = "sequence string, r array<struct<num:int,ins:string,aa:string>>"
    rows = [("AC-DE", [(1, " ", "C"), (2, " ", "-"), (3, " ", "D")]), ("ACDE", [(1, " ", "A"), (2, " ", "D")]), ("ACDE", [(2, " ", "A"), (1, " ", "C")]), ("ACDE", [])]
    assert [r[0] for r in spark.createDataFrame(rows, kind).select(sequences.is_contiguous("r", "sequence")).collect()] == [True, False, False, True]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 12, 13, 14, 15, 40, 90])
def test_symmetric_loop_is_the_kernels(spark, n):
    s = ("ACDEFGHIKL" * 10)[:n]
    got = spark.createDataFrame([(s,)], "s string").select(numbering.symmetric_loop("s", 105, 117).alias("r")).first().r
    assert [tuple(x) for x in got] == Symmetric(105, 117).fill(list(s))


def test_kmers_of_queries_are_not_broadcast(spark):
    """What is sent through the driver is the index of genes, not the queries' k-mers, though these come from a smaller table."""
    queries = spark.createDataFrame([(1, "LVHWWKKD"), (2, "HHHHH")], "k int, sequence string").select("*").limit(2)
    genes = spark.createDataFrame([(0, "LVHWWAAA"), (1, "KKDKKD"), (2, "LVHWWKKD")], "gene_index int, ungapped string")
    top = germline.top_by_kmers(queries, genes, "k", 2)
    assert sorted(map(tuple, top.collect())) == [(1, 0, 2, 2), (1, 2, 5, 1)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [kmer" in plan and "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_kmers_identity_and_ties(spark):
    df = spark.createDataFrame([("LVHWW", "AC-D", "A-CD")], "s string, q string, g string")
    r = df.select(germline.kmers("s").alias("k"), germline.identity("q", "g").alias("i"), germline.kmers(F.lit("AB")).alias("none")).first()
    assert r.k == ["0052", "0522"] and r.i == pytest.approx(2 / 3) and r.none == []
    rows = [(1, 0.5, 3, "pig", "b"), (1, 0.5, 3, "human", "z"), (1, 0.5, 2, "a", "a"), (1, 0.7, 9, "a", "a")]
    best = germline.best_by_evalue(spark.createDataFrame(rows, "k int, evalue double, score int, species string, gene string"), "k").first()
    assert (best.species, best.gene) == ("human", "z")


def test_alignment_functions(spark):
    r = spark.createDataFrame([("WWW", "WWW"), (None, "A")], "a string, b string").select(sw_score("a", "b").alias("s"), sw_identity("a", "b").alias("i")).collect()
    assert (r[0].s, r[0].i) == (33, 1.0) and (r[1].s, r[1].i) == (None, None)


def test_states_are_the_kernels(spark):
    from vdomain.kernel.domains import Hit, states_of

    cols = "mmimddmmiim"
    want = states_of(Hit("x_H", 0, 0, 0, 4, 12, 6, 14, cols), False, False, 50, 128)
    got = spark.createDataFrame([(cols, 4, 6)], "c string, q int, h int").select(hits.states("c", "q", "h").alias("s")).first().s
    assert [tuple(x) for x in got] == want


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first\nACD\n EFG \n>two\nKLM\n\n>three x\r\nNPQ\r\n")
    want = [("one", "ACDEFG"), ("two", "KLM"), ("three", "NPQ")]
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fasta")).collect()] == want
    spark.dataSource.register(FastaDataSource)
    assert [tuple(r) for r in spark.read.format("fasta").load(str(tmp_path / "a.fasta")).collect()] == want
    with pytest.raises(ValueError, match=BAD):
        list(records(["ACD", ">x", "A"]))


def test_annotate(spark):
    rows = [("a", VH), ("b", VK), ("c", VH), ("d", LYSOZYME), ("e", VH + "GGGGSGGGGS" + VK), ("f", None)]
    df = spark.createDataFrame(rows, "seq_id string, sequence string")
    out = {r.seq_id: r for r in E.annotate(df, E.AnnotateOptions(assign_germline=True, regions=True)).collect()}
    assert len(out) == 6 and out["d"].domains is None and out["f"].domains is None
    assert [d.chain_type for d in out["e"].domains] == ["H", "K"]
    assert out["a"].domains == out["c"].domains
    d = out["a"].domains[0]
    assert d.germline.v_gene == "IGHV3-23*01" and d.species == "human" and set(d.regions.values()) == {"complete"}
    for distinct in (True, False):
        again = E.annotate(df.where("sequence is not null").repartition(3), E.AnnotateOptions(assign_germline=True, regions=True), distinct=distinct)
        assert {r.domains[0].bitscore for r in again.where("domains is not null").collect()} <= {x.bitscore for r in out.values() for x in r.domains or []}
    assert E.hit_rows(E.annotate(df)).where("seq_id = 'a'").count() >= 1
    assert E.residue_rows(E.domain_rows(E.annotate(df))).where("seq_id = 'a' and aa <> '-'").count() == len(VH)


def test_columns_of_rows_stay(spark):
    """With and without a pass over distinct sequences, and where names clash."""
    rows = [("a", VH, 1), ("b", None, 2), ("c", VH, 3), ("d", LYSOZYME, 4)]
    df = spark.createDataFrame(rows, "seq_id string, sequence string, n int").withColumn("error", F.lit("own")).withColumn("m", F.create_map(F.lit("k"), "n"))
    for distinct in (True, False):
        out = E.annotate(df, distinct=distinct)
        assert out.columns == ["seq_id", "sequence", "n", "m", *E.RESULTS]
        got = {r.seq_id: r for r in out.collect()}
        assert {k: (r.n, r.m) for k, r in got.items()} == {"a": (1, {"k": 1}), "b": (2, {"k": 2}), "c": (3, {"k": 3}), "d": (4, {"k": 4})}
        assert got["a"].domains == got["c"].domains and got["b"].hits is None and got["d"].domains is None and all(r.error is None for r in got.values())


def test_replay_is_joined(spark):
    df = spark.createDataFrame([("a", VH), ("b", VK)], "seq_id string, sequence string")
    hits = spark.createDataFrame([(VH, [("pan_H", 1e-50, 170.0, 0.5, 0, 118, 0, 128, "m" * 9 + "d" + "m" * 23 + "dddd" + "m" * 21 + "dd" + "m" * 11 + "d" + "m" * 38 + "d" * 1 + "m" * 16)])], f"sequence string, hits array<{E.REPLAYED}>")
    for distinct in (True, False):
        got = {r.seq_id: r for r in E.annotate(df, replay=hits, distinct=distinct).collect()}
        assert [h.id for h in got["a"].hits] == ["pan_H"] and got["a"].hits[0].bitscore == 170.0 and got["b"].hits == [] and got["b"].domains is None


def test_one_domain_fails_and_the_others_stay(spark):
    tcr = next(g for g in load_genes(spark) if g.chain == "A" and g.segment == "V").ungapped + "DSNYQLIWGAGTKLIIKP"
    r = E.annotate(spark.createDataFrame([(VH + "GGGGSGGGGS" + tcr,)], "sequence string"), E.AnnotateOptions(scheme="kabat")).first()
    assert [d.chain_type for d in r.domains] == ["H"] and "Unimplemented" in r.error
    with pytest.raises(ValueError, match="no such germline method"):
        E.annotate(spark.createDataFrame([(VH,)], "sequence string"), E.AnnotateOptions(germline_method="nonsense"))


def test_species_limit_hits(spark):
    profiles = [type(p)(p.name.replace("pan", sp), p.match, p.step, p.tail) for p in load_profiles(spark) for sp in ("human", "mouse")]
    df = spark.createDataFrame([(VH,)], "sequence string")
    own = E.annotate(df, E.AnnotateOptions(allowed_species=("mouse",)), profiles=profiles).first()
    assert {h.id.split("_")[0] for h in own.hits} == {"mouse"} and not own.reverted_species
    none = E.annotate(df, E.AnnotateOptions(allowed_species=("pig",)), profiles=profiles).first()
    assert {h.id.split("_")[0] for h in none.hits} == {"human", "mouse"} and none.reverted_species


def test_identity_by_bits_is_identity(spark):
    import random

    rng = random.Random(3)
    letters = "ACDEFGHIKLMNPQRSTVWYBXZ*?-"
    row = lambda: "".join(rng.choice(letters) for _ in range(128))
    rows = [(k, row(), row()) for k in range(60)] + [(100, "-" * 128, row()), (101, row().lower(), "-" * 128), (102, "AC", "AC" + "-" * 126)]
    df = spark.createDataFrame(rows, "k int, aligned_query string, aligned string")
    genes = df.select("k", F.lit("V").alias("seg"), F.lit("x").alias("species"), F.lit(0).alias("species_ord"), F.lit("g").alias("gene"), F.lit(0).alias("gene_ord"), "aligned", F.regexp_replace("aligned", "-", "").alias("ungapped"))
    got = {r.k: r.identity for r in germline.best_by_identity(df.withColumn("key", F.col("k")), genes, "key", "V", ["k"]).withColumnRenamed("key", "k").collect()}
    for k, q, g in rows:
        there = [(a, b) for a, b in zip(q.upper().ljust(128, "-"), g) if b != "-"]
        want = sum(a == b for a, b in there) / len(there) if there else 0
        assert got.get(k, 0) == pytest.approx(want)


def test_allow_threshold_and_errors(spark):
    df = spark.createDataFrame([("a", VH), ("b", VK)], "seq_id string, sequence string")
    got = {r.seq_id: r.domains is None for r in E.annotate(df, E.AnnotateOptions(allow=("K",))).collect()}
    assert got == {"a": True, "b": False}
    assert E.annotate(df, E.AnnotateOptions(bit_score_threshold=1e6)).where("domains is null").count() == 2
    tcr = next(g for g in load_genes(spark) if g.chain == "A" and g.segment == "V").ungapped + "DSNYQLIWGAGTKLIIKP"
    one = spark.createDataFrame([("t", tcr)], "seq_id string, sequence string")
    assert "Unimplemented numbering scheme kabat for chain A" in E.annotate(one, E.AnnotateOptions(scheme="kabat")).first().error
    with pytest.raises(Exception, match="Unimplemented"):
        E.annotate(one, E.AnnotateOptions(scheme="kabat", fail_fast=True)).collect()
    bad = spark.createDataFrame([("x", VH + "X*")], "seq_id string, sequence string")
    assert "*, X" in E.annotate(bad, E.AnnotateOptions(validate=True)).first().error


def test_number_first(spark):
    df = spark.createDataFrame([("a", VH), ("s", VH[:40]), ("n", LYSOZYME), ("x", VH + "X")], "seq_id string, sequence string")
    got = {r.seq_id: (r.chain_class, r.reason) for r in E.number_first(df).collect()}
    assert got["a"] == ("H", None) and "shorter" in got["s"][1] and "No domain" in got["n"][1] and "Unknown" in got["x"][1]
    assert "Unrecognised" in E.number_first(df, "zzz").first().reason


def test_inputs(spark):
    assert E.from_input(spark, VH).first().seq_id == "Input sequence"
    with pytest.raises(ValueError, match="Unknown amino"):
        E.from_input(spark, "ACDX")
    with pytest.raises(ValueError, match="Unknown amino"):
        E.from_input(spark, "./no/such.fasta")
    with pytest.raises(TypeError):
        E.sequences(spark, [("a", 1)])
    assert E.method_of("e-value") == "evalue" and E.method_of(None) == "evalue"
    assert [p.name for p in load_profiles(spark)] == [f"pan_{c}" for c in "HKLABGD"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", VH), ("b", VK)], "seq_id string, sequence string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id string, sequence string").parquet(str(tmp_path / "in"))
    q = annotate_stream(stream).select("seq_id", "sequence", F.size("domains").alias("n")).writeStream.format("memory").queryName("annotated").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.seq_id, r.n) for r in spark.table("annotated").collect()) == [("a", 1), ("b", 1)]


def test_write(spark, tmp_path):
    a = E.annotate(spark.createDataFrame([("a", VH)], "seq_id string, sequence string"))
    E.write(a, str(tmp_path / "d"))
    E.write(a, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("aa <> '-'").count() == len(VH)


def test_repeats_and_unwanted_fields(spark):
    rows = [(k, VH if k % 3 else VK) for k in range(12)] + [(12, None)]
    df = spark.createDataFrame(rows, "k int, sequence string")
    full = {r.k: r for r in E.annotate(df).collect()}
    got = {r.k: r for r in E.annotate(E.alike(df), E.AnnotateOptions(wanted=("chain_type", "residues")), distinct=False).collect()}
    assert sorted(got) == sorted(full) == list(range(13)) and got[12].domains is None
    for k in range(12):
        (a,), (b,) = full[k].domains, got[k].domains
        assert (a.chain_type, a.residues) == (b.chain_type, b.residues) and b.state_vector is None and got[k].hits == []
    hits = {r.k: r for r in E.annotate(df, E.AnnotateOptions(wanted=("hits",))).collect()}
    assert all(hits[k].hits == full[k].hits and hits[k].domains is None for k in range(13))
