import random

import numpy as np
import pytest

from vdomain.kernel import domains as D
from vdomain.kernel import genes as G
from vdomain.kernel import profile as P
from vdomain.kernel import schemes as S
from vdomain.kernel import sw

VH = "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAKDRGYYGMDVWGQGTTVTVSS"
VK = "DIQMTQSPSSLSASVGDRVTITCRASQDVSTAVAWYQQKPGKAPKLLIYSASFLYSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQHYTTPPTFGQGTKVEIK"
LYSOZYME = "KVFGRCELAAAMKRHGLDNYRGYSLGNWVCAAKFESNFNTQATNRNTDGSTDYGILQINSRWWCNDGRTPGSRNLCNIPCSALLSSDITASVNCAKKIVSDGNGMNAWVAWRNRCKGTDVQAWIRGCRL"
TWENTY = "ACDEFGHIKLMNPQRSTVWY"


@pytest.fixture(scope="module")
def scan():
    genes = G.built_in()
    return D.ProfileScan([P.build(f"pan_{c}", [g.aligned for g in genes if g.chain == c]) for c in "HKLABGD"])


@pytest.mark.parametrize(
    ("query", "target", "score", "identity"),
    [
        (TWENTY, TWENTY, 116, 1.0),
        (TWENTY, TWENTY.replace("I", ""), 101, 0.95),
        (TWENTY, "ACDEFAAGHIKLMNPQRSTVWY", 104, 20 / 22),
        ("MKLVWQ", "MKLVWQ", 34, 1.0),
        ("QVQLVQSGAEVKKPGAS", "QVQLVQSGAEVKKPGAT", 78, 16 / 17),
        ("WWWWWW", "WWWWWW", 66, 1.0),
        (VK[:88], "DIQMTQSPSSLSASVGDKVTITCRASQGISNALAWYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQH", 413, 80 / 88),
        ("", "ABC", 0, 0.0),
    ],
)
def test_local_alignment(query, target, score, identity):
    assert sw.local_score(query, target) == score
    assert sw.local_identity(query, target) == (pytest.approx(identity), score)


def test_batched_scores_are_those_of_each_pair():
    r = random.Random(2)
    seqs = ["".join(r.choice(sw.ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(40)]
    q = seqs[3] + seqs[5]
    assert sw.Targets(seqs).scores(q).tolist() == [sw.local_score(q, t) for t in seqs]


def test_batched_alignments_are_those_of_each_pair():
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
    q = [word(sw.ALPHABET[: 2 + k % 19] + "X*"[: k % 3]) for k in range(300)]
    t = [a[r.randint(0, 5) :] + word("ACDE") if k % 2 else word(sw.ALPHABET) for k, a in enumerate(q)]
    scores, shares = sw.align(q, t)
    assert list(zip(shares.tolist(), scores.tolist())) == [sw.local_identity(*p) for p in zip(q, t)]
    assert sw.align(q, t, identity=False)[0].tolist() == scores.tolist() and sw.align([], [])[0].tolist() == []


def test_genes_of_a_batch_are_aligned_together(monkeypatch):
    """However many domains there are: scores and identities of V genes, then of J genes."""
    table, calls = G.GeneTable(G.built_in()), []
    monkeypatch.setattr(G, "align", lambda *a: calls.append(len(a[0])) or sw.align(*a))
    states = [(k + 1, "m", k) for k in range(110)]
    domains = [(states, VH[:k] + "A" + VH[k + 1 :], "H") for k in range(20, 40)]
    together = table.assign_all(domains, "evalue")
    assert len(calls) == 4
    assert together == [G.GeneTable(G.built_in()).assign(*d, "evalue") for d in domains]
    for g in together:
        vq = G.split_v_j(*domains[together.index(g)][:2])[0]
        assert g.v_identity == sw.local_identity(vq, next(x for x in G.built_in() if x.name == g.v_gene and x.segment == "V").ungapped)[0]


def test_substitution_scores():
    assert [sw.score(*p) for p in ("QQ", "AA", "WW", "CW", "wc", "WL", "YY")] == [5, 4, 11, -2, -2, -2, 7]
    assert (sw.MATRIX == sw.MATRIX.T).all()


def test_insertion_codes():
    assert [S.code(n) for n in (-1, 0, 25, 26, 51)] == [" ", "A", "Z", "AA", "ZZ"]


@pytest.mark.parametrize("n", range(0, 118))
def test_symmetric_loop_against_a_second_form(n):
    """Fill alternately from both ends; what is over goes right of the middle, then left, in turn."""
    got = S.Symmetric(105, 117, 117).fill(list("A" * n))
    left, right, over_l, over_r = [], [], [], []
    for k in range(n):
        if k < 13:
            (left if k % 2 == 0 else right).append(k)
        else:
            (over_r if k % 2 == 1 else over_l).append(k)
    shown = [f"{p}{c.strip()}" for p, c, a in got if a != "-"]
    want = [f"{105 + k}" for k in range(len(left))] + [f"{104 + len(left)}{S.code(k)}" for k in range(len(over_l))]
    want += [f"{118 - len(right)}{S.code(k)}" for k in reversed(range(len(over_r)))] + [f"{118 - k}" for k in range(len(right), 0, -1)]
    assert shown == want
    assert len([a for _, _, a in got if a == "-"]) == max(0, 13 - n)
    assert S.Symmetric(105, 117, 117).fill(["A"] * 118) is None


def test_known_domain_in_all_schemes(scan):
    (p,) = D.domains_of([VH], scan, 80.0, {"H": 128})
    assert [d.chain for d in p.domains] == ["H"]
    shown = {s: [f"{n}{c.strip()}" for n, c, a in S.number(p.states[0], VH, s, "H")[0] if a != "-"] for s in S.NAMES.values()}
    assert shown["imgt"][:9] == [str(k) for k in range(1, 10)] and shown["imgt"][-1] == "128"
    for scheme, inserted in (("chothia", {"82A", "82B", "82C"}), ("kabat", {"82A", "82B", "82C"}), ("martin", {"72A", "72B", "72C"})):
        assert shown[scheme][-13:] == ["101", "102", *(str(k) for k in range(103, 114))] and inserted <= set(shown[scheme])
    assert shown["aho"][-1] == "149" and shown["wolfguy"][-1] == "411"
    for s in shown:
        r, first, last = S.number(p.states[0], VH, s, "H")
        assert S.check_numbering(r, VH) is None and (first, last) == (0, len(VH) - 1)


def test_ladders_leave_out_and_insert_where_the_schemes_say():
    row = lambda n: [(0, " ", "A")] * n
    shown = lambda rule, n: [f"{p}{c.strip()}" for p, c in rule.numbers(row(n), "H")]
    assert shown(S._H1, 11) == [str(k) for k in range(23, 34)]
    assert shown(S._H1, 9) == [*(str(k) for k in range(23, 30)), "32", "33"] and shown(S._H1, 1) == ["32"]
    assert shown(S._H1, 13)[8:] == ["31", "31A", "31B", "32", "33"]
    assert shown(S._H2, 5) == ["53", "54", "55", "56", "57"] and shown(S._H2, 10)[2:5] == ["52", "52A", "52B"]
    assert shown(S._H3, 8) == ["93", "94", "95", "96", "97", "98", "101", "102"]
    assert S._H3.numbers(row(37), "H") is None and shown(S._H3, 36)[-3] == "100Z"
    assert shown(S.SCHEMES["wolfguy", "H"].rules[1], 3) == ["151", "152", "199"]
    assert shown(S.SCHEMES["wolfguy", "L"].rules[1], 4) == ["508", "508A", "509", "510"]
    assert S.SCHEMES["wolfguy", "H"].rules[1].numbers(row(80), "H") is None
    assert [f"{p}" for p, _ in S.SCHEMES["aho", ""].rules[2].numbers(row(17), "K")] == [str(k) for k in range(25, 43) if k != 28]


def test_scheme_names_and_chains():
    assert S.resolve_scheme("K") == "kabat" and S.resolve_scheme("IMGT") == "imgt"
    with pytest.raises(ValueError, match="Unrecognised"):
        S.resolve_scheme("x")
    with pytest.raises(S.NumberingError, match="Unimplemented numbering scheme kabat for chain A"):
        S.scheme_for("kabat", "A")


def test_smoothing_moves_insertions_into_the_loop_and_drops_an_open_end():
    states = [(24, "m", 0), (25, "m", 1), (26, "m", 2), (26, "i", 3), (27, "m", 4), (28, "m", 5)]
    out = S.smooth(states)
    assert [(i, k) for i, k, _ in out] == [(24, "m"), (25, "m"), (26, "m"), (27, "m"), (27, "m"), (28, "m")]
    assert S.smooth([(116, "m", 0), (117, "m", 1)]) == [(116, "m", 0)]
    assert S.smooth([(116, "m", 0), (117, "m", 1)], keep_tail=True)[-1] == (117, "m", 1)


def test_domains_of_several_and_of_none(scan):
    linked = VH + "GGGGSGGGGSGGGGS" + VK
    got = D.domains_of([linked, VH + "GGGGSGGGGS" + VK + "GGGGSGGGGS" + VH, LYSOZYME, ""], scan, 80.0, {})
    assert [[d.chain for d in p.domains] for p in got] == [["H", "K"], ["H", "K", "H"], [], []]


def test_scan_does_not_depend_on_the_batch(scan):
    seqs = [VH, VK, LYSOZYME, VH[30:], VK + VH]
    together = scan(seqs)
    assert together == [scan([s])[0] for s in seqs]


def test_weak_hits_are_there_without_a_threshold(scan):
    hits = scan([VH])[0]
    assert {h.hit_id for h in hits} >= {f"pan_{c}" for c in "HKLABGD"} and min(h.bitscore for h in hits) < 20
    assert {h.hit_id for h in scan([VH], 80.0)[0] if h.bitscore >= 80} == {h.hit_id for h in hits if h.bitscore >= 80}


def test_composition_bias(scan):
    for s in (VH, VK):
        (top, *_) = scan([s], 80.0)[0]
        assert 0 <= top.bias < 0.1 * top.bitscore
    # a domain of few letters, over and over, is explained by its composition
    low = scan.scanner.bias("GS" * 40, 0, 0, "m" * 80)
    assert low > scan.scanner.bias(VH[:80], 0, 0, "m" * 80) >= 0


def test_long_sequences_are_scanned_in_two_passes(scan, monkeypatch):
    seqs = [VH, VK + "GGGGS" * 3 + VH]
    want = scan(seqs)
    monkeypatch.setattr(D, "KEPT", 0)
    assert scan(seqs) == want


def test_long_loop_needs_a_second_look(scan):
    loop = "GSYDTAERNQPS" * 6
    seq = VH[:96] + "CAR" + loop + "FDYWGQGTLVTVSS"
    (p,) = D.domains_of([seq], scan, 80.0, {"H": 128})
    assert p.states[0][-1][0] == 128 and p.ends[0] == len(seq)


def test_extension_at_the_ends():
    h = D.Hit("pan_H", 1e-9, 100.0, 0.0, 3, 100, 2, 125, "m" * 97)
    s = D.states_of(h, True, True, 110, 128)
    assert s[0] == (1, "m", 1) and s[-1][2] == 102 and len(s) == 2 + 97 + 3
    # the model misses more than the sequence has: only the difference
    short = D.Hit("pan_H", 1e-9, 100.0, 0.0, 1, 100, 3, 120, "m" * 99)
    assert D.states_of(short, True, True, 110, 128)[0] == (3, "m", 0)
    assert D.states_of(short, False, False, 110, 128)[0] == (4, "m", 1)


def test_overlap_goes_by_evalue_and_species_may_revert():
    hits = [D.Hit("human_H", 1e-5, 90.0, 0, 0, 50, 0, 50, "m" * 50), D.Hit("mouse_H", 1e-9, 95.0, 0, 40, 90, 0, 50, "m" * 50), D.Hit("human_K", 1e-7, 85.0, 0, 90, 120, 0, 30, "m" * 30)]
    p = D.choose(hits, 130, 80.0, {})
    assert [d.hit_id for d in p.domains] == ["mouse_H", "human_K"] and [h.hit_id for h in p.hits] == ["mouse_H", "human_K", "human_H"]
    assert [d.hit_id for d in D.choose(hits, 130, 80.0, {}, ["human"]).domains] == ["human_H", "human_K"]
    assert D.choose(hits, 130, 80.0, {}, ["pig"]).reverted


def test_profile_text_round_trip():
    p = P.build("pan_T", [g.aligned for g in G.built_in() if g.chain == "H"])
    neg = lambda x: "*" if x <= 0 else f"{-np.log(x):.5f}"
    lines = ["HMMER3/f [x]", "NAME  pan_T", "LENG  128", "STATS LOCAL FORWARD -3.5 0.7", "HMM  " + "  ".join(P.AMINO), "  m->m", "  " + " ".join(["1.0"] * 20), "  " + " ".join(map(neg, p.step[0]))]
    for k in range(128):
        lines += [f" {k + 1} " + " ".join(map(neg, p.match[k])) + " 1 x x - -", "  " + " ".join(["1.0"] * 20), "  " + " ".join(map(neg, p.step[k + 1]))]
    (q,) = P.parse_hmm("\n".join(lines) + "\n//\n")
    assert q.name == "pan_T" and q.tail == (-3.5, 0.7)
    assert np.allclose(p.match, q.match, atol=1e-4) and np.allclose(p.step, q.step, atol=1e-4)
    with pytest.raises(ValueError):
        P.parse_hmm("")


def test_forward_is_at_least_viterbi(scan):
    s = scan.scanner
    m = np.arange(7)
    assert (s.forward([VH] * 7, m) >= s.viterbi([VH] * 7, m) - 1e-3).all()


def test_closest_gene_is_the_one_it_was_made_from():
    table = G.GeneTable(G.built_in())
    for g in G.built_in():
        if g.segment == "V":
            seq = g.ungapped
            at = iter(range(len(seq)))
            states = [(k + 1, "d" if c == "-" else "m", None if c == "-" else next(at)) for k, c in enumerate(g.aligned)]
            for method in ("identity", "evalue"):
                assert table.assign(states, seq, g.chain, method).v_identity == 1.0
    assert table.assign(states, seq, "H", "identity", ["alpaca"]).empty
    assert table.assign(states, seq, "Z", "identity") == G.Germline()
    assert G.canonical_j_lengths(G.built_in()) == {"H": 128, "K": 127, "L": 127, "A": 128, "B": 127, "G": 128, "D": 128}


def _like(count):
    """Heavy sequences of one length that begin and end alike, sorted."""
    return sorted(VH[:96] + a + b + c + VH[99:] for a in "ACDEFGHK" for b in "LMNPQRST" for c in "VWYA")[:count]


def test_what_sequences_begin_with_is_scored_once(scan):
    seqs = _like(64)
    first, rest = scan.scanner.tables(seqs[:32]), seqs[32:]
    assert sum(len(s[0]) for s in first.steps) < 32 * len(VH) / 3
    again = scan.scanner.tables(rest, before=first)
    assert again.steps[50][0] is first.steps[50][0]  # the block after it takes over what it begins with
    for tables, own in ((first, seqs[:32]), (again, rest)):
        rows = [(r, m) for r in range(len(own)) for m in range(7)]
        for (r, m), path in zip(rows, scan.scanner.paths(tables, rows)):
            alone = scan.scanner.tables([own[r]], [m])
            assert tables.bits[r, m] == alone.bits[0, 0] and path == scan.scanner.paths(alone, [(0, 0)])[0]
    one = [scan.scanner.forward([s], np.array([0]))[0] for s in seqs]
    assert np.allclose(scan.scanner.forward(seqs, np.zeros(64, int)), one, rtol=0, atol=1e-9)


@pytest.mark.parametrize("scheme", ["imgt", "chothia", "kabat", "martin", "aho", "wolfguy"])
def test_domains_with_the_same_states_are_numbered_once(scan, scheme):
    numberer = S.Numberer(scheme)
    seqs = [*_like(40), VK, VK[:40] + "-" + VK[40:], VK.replace("A", "T"), VH[:60] + VH[64:]]
    for s, p in zip(seqs, D.domains_of(seqs, scan, 80.0, {})):
        for d, states in zip(p.domains, p.states):
            got = numberer(states, s, d.chain)
            residues, first, last = S.number(states, s, scheme, d.chain)
            codes = [S.CODES[c] if c >= 0 else " " for c in got.codes.tolist()]
            assert [(n, c, s[at] if at >= 0 else "-") for n, c, at in zip(got.numbers.tolist(), codes, got.residues.tolist())] == residues
            assert (got.first, got.last, got.error) == (first, last, S.check_numbering(residues, s))
    assert len(numberer.known) < 12


def test_models_that_cant_reach_the_threshold_are_given_up_where_sequences_part(scan):
    seqs = _like(64)
    every, some = scan.scanner.tables(seqs), scan.scanner.tables(seqs, look=60.0)
    assert some.steps[-1][0].shape[1] < every.steps[-1][0].shape[1] == 7
    high = every.bits >= 60
    assert high.any() and (some.bits[high] == every.bits[high]).all() and (some.bits[~high] < 60).all()
    rows = np.argwhere(high).tolist()
    assert scan.scanner.paths(some, rows) == scan.scanner.paths(every, rows)


def test_deletes_are_summed_along_the_nodes(scan):
    """As the table of all ways from a match to a delete has them."""
    s, seqs, m = scan.scanner, [*_like(64), VK, LYSOZYME, "W", VH + VK], np.zeros(68, int)
    assert s.summed.all()
    s.summed = ~s.summed
    try:
        ways = s.forward(seqs, m)
    finally:
        s.summed = ~s.summed
    assert np.allclose(s.forward(seqs, m), ways, rtol=0, atol=1e-9)


def test_tables_of_a_scan_hold_nodes_in_one_piece(scan):
    """A step to the next node is a slice that lies in one piece."""
    step = scan.scanner.tables(_like(32)).steps[-1]
    assert all(a.shape[0] == 32 and a.shape[2] == 129 and a.T[1:].flags.c_contiguous for a in step[:3])


def test_only_likely_genes_are_aligned(monkeypatch):
    """Genes that can't have the best score, going by the gene that the query begins like, are left out; the closest one stays the same."""
    pairs, rnd = [], random.Random(5)
    table = G.GeneTable(G.built_in())
    monkeypatch.setattr(G, "align", lambda *a: pairs.append((len(a[0]), *a[2:])) or sw.align(*a))
    queries = []
    for g in (g for g in G.built_in() if g.segment == "V"):
        for changes in (0, 2, 2, 12, 60):
            q = list(g.ungapped[: len(g.ungapped) - 4])
            for k in rnd.sample(range(len(q)), changes):
                q[k] = rnd.choice(TWENTY)
            queries.append((g.chain, "".join(q) + ("AAAAAAA" if changes == 12 else ""), table.species("V", g.chain)))
    found = table._by_evalue("V", queries)
    every = [[g for g in table.by["V", c] if g.species in species] for c, _, species in queries]
    assert pairs[0][0] < sum(map(len, every)) * 2 / 3
    for (_, q, _), gs, (best, share, _) in zip(queries, every, found):
        assert best == min(gs, key=lambda g: (-sw.local_score(q, g.ungapped), g.species, g.name))
        assert share == sw.local_identity(q, best.ungapped)[0]
