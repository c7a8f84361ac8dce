"""DuckDB SQL for the queries that run the whole engine: made sequences are put together from genes, so their numbering follows from the genes' columns.

Nothing is aligned here. Residues stand in the columns of the genes that they come from, the loop lies between column 104 and column 118, and a scheme's
rules, given as lists of numbers, are applied by SQL.
"""

from __future__ import annotations

from .kernel.genes import Gene, built_in
from .kernel.schemes import ByChain, Canonical, Ladder, Lead, Scheme, Stretch, Symmetric, scheme_for
from .kernel.sw import ALPHABET, score

CHAINS = "HKLABGD"


def pairs_of(genes: list[Gene]) -> list[tuple[str, Gene, Gene]]:
    """V and J genes of each chain that made sequences take by turns."""
    by: dict[tuple[str, str], list[Gene]] = {}
    for g in genes:
        by.setdefault((g.chain, g.segment), []).append(g)
    return [(c, v, j) for c in CHAINS for v in by[c, "V"] for j in by[c, "J"][:2]]


def residues(key: str) -> str:
    return f"translate(md5(CAST({key} AS VARCHAR)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS')"


def _put(text: str, place: str, letter: str) -> str:
    return f"substr({text}, 1, {place} - 1) || {letter} || substr({text}, {place} + 1)"


def _digit(k: int) -> str:
    return f"CAST(('0x' || substr(md5(o_orderkey || ':at'), {k}, 1)) AS INTEGER)"


_PAIRS = pairs_of(built_in())
_FEW = _put("(" + _put("vu", f"(2 + {_digit(1)})", f"substr({residues(chr(111) + '_orderkey || ' + chr(39) + ':v' + chr(39))}, 1, 1)") + ")", f"(60 + {_digit(2)})", f"substr({residues(chr(111) + '_orderkey || ' + chr(39) + ':v' + chr(39))}, 2, 1)")
#: made: an order's chain, genes, V residues (vs) and loop, which lies between column 104 and column 118.
MADE = f"""pairs(pair, chain, v_species, v_gene, j_gene, v_al, j_al) AS (VALUES {", ".join(f"({k}, '{c}', '{v.species}', '{v.name}', '{j.name}', '{v.aligned}', '{j.aligned}')" for k, (c, v, j) in enumerate(_PAIRS))}),
o AS (SELECT o_orderkey, o_orderkey // {len(_PAIRS)} AS turn, replace(v_al, '-', '') AS vu, pairs.* FROM orders JOIN pairs ON pair = o_orderkey % {len(_PAIRS)}),
made AS (SELECT *, CASE WHEN turn % 3 = 0 THEN {_FEW} ELSE vu END AS vs, substr({residues("o_orderkey")}, 1, CAST(3 + turn % 4 AS BIGINT)) AS digest FROM o)"""
#: st: residues by state (those of the loop are all at state 105), in order.
STATES = """p AS (SELECT o_orderkey, chain, vs, digest, v_al, j_al, length(replace(substr(v_al, 1, 104), '-', '')) AS framework FROM made),
l AS (SELECT *, substr(vs, framework + 1) || digest || replace(substr(j_al, 1, 117), '-', '') AS loop FROM p),
st AS (
  SELECT o_orderkey, chain, state, CAST(state AS BIGINT) AS pos, substr(vs, length(replace(substr(v_al, 1, state), '-', '')), 1) AS aa FROM (SELECT *, unnest(range(1, 105)) AS state FROM l) WHERE substr(v_al, state, 1) <> '-'
  UNION ALL SELECT o_orderkey, chain, 105, 1000 + k, substr(loop, k, 1) FROM (SELECT *, unnest(range(1, length(loop) + 1)) AS k FROM l)
  UNION ALL SELECT o_orderkey, chain, state, 2000 + state, substr(j_al, state, 1) FROM (SELECT *, unnest(range(118, 129)) AS state FROM l) WHERE substr(j_al, state, 1) <> '-')"""


def _list(numbers: tuple[int, ...]) -> str:
    return "[" + ", ".join(map(str, numbers)) + "]"


_CODE = "CASE WHEN k < 26 THEN chr(CAST(65 + k AS INTEGER)) ELSE repeat(chr(CAST(65 + k - 26 AS INTEGER)), 2) END"
_PLAIN = "list_transform({0}, lambda q: {{'n': CAST(q AS BIGINT), 'c': ''}})"


def _ladder(rule: Ladder) -> tuple[str, str | None, str | None]:
    """(numbers for n residues, condition under which the scheme doesn't apply, condition under which the alignment's numbers stay)."""
    size = len(rule.order)
    kept = f"list_sort(list_slice({_list(rule.order)}, greatest(1, {size} - n + 1), {size}))"
    numbers = _PLAIN.format(kept)
    if rule.at is not None:
        more = f"list_transform(range(0, greatest(0, n - {size})), lambda k: {{'n': CAST({rule.at} AS BIGINT), 'c': {_CODE}}})"
        numbers = f"flatten(list_transform({kept}, lambda q: list_concat([{{'n': CAST(q AS BIGINT), 'c': ''}}], CASE WHEN q = {rule.at} THEN {more} ELSE [] END)))"
    most = rule.most if rule.most is not None else size if rule.at is None else None
    stays = f"NOT (n > {rule.only[0]} OR n = {rule.only[1]})" if rule.only else None
    return numbers, None if most is None else f"n > {most}", stays


def _symmetric(rule: Symmetric) -> str:
    size = rule.last - rule.first + 1
    held, extra = f"least(n, {size})", f"greatest(0, n - {size})"
    left, right = f"({held} - {held} // 2)", f"({held} // 2)"
    parts = [
        _PLAIN.format(f"range({rule.first}, {rule.first} + {left})"),
        f"list_transform(range(0, {extra} // 2), lambda k: {{'n': CAST({rule.first} + {left} - 1 AS BIGINT), 'c': {_CODE}}})",
        f"list_reverse(list_transform(range(0, {extra} - {extra} // 2), lambda k: {{'n': CAST({rule.last} - {right} + 1 AS BIGINT), 'c': {_CODE}}}))",
        _PLAIN.format(f"range({rule.last} - {right} + 1, {rule.last + 1})"),
    ]
    return f"list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]}))"


def _canonical(rule: Canonical) -> tuple[str, str | None, str | None]:
    otherwise, none, stays = _ladder(rule.otherwise)
    cases = []
    for n, classes in rule.classes.items():
        worth = [f"list_sum(list_transform(range(1, {n + 1}), lambda i: blosum[substr(letters, i, 1) || substr('{c}', i, 1)]))" for c, _ in classes]
        best = " ".join(f"WHEN {' AND '.join(f'{worth[k]} >= {w}' for w in worth[k + 1 :])} AND {' AND '.join([f'{worth[k]} > {w}' for w in worth[:k]] or ['true'])} THEN {_PLAIN.format(_list(own))}" for k, (_, own) in enumerate(classes[:-1]))
        cases.append(f"WHEN n = {n} THEN " + (f"CASE {best} ELSE {_PLAIN.format(_list(classes[-1][1]))} END" if best else _PLAIN.format(_list(classes[0][1]))))
    return f"CASE {' '.join(cases)} ELSE {otherwise} END", f"({none}) AND n NOT IN ({', '.join(map(str, rule.classes))})" if none else None, stays


def _base(s: Scheme) -> list[tuple[int, int, int, str]]:
    """(state, region, number, insertion code) of each state where no rule says otherwise: a dropped state inserts after the one before it."""
    out, last = [], 0
    for state in range(1, 129):
        region = next(r for r, end in enumerate(s.regions) if state <= end)
        first = s.regions[region - 1] + 1 if region else 1
        number = state + s.shifts[region] - sum(first <= d <= state for d in s.dropped)
        if state not in s.dropped:
            last = state
        out.append((state, region, number, chr(64 + state - last) if state != last else ""))
    return out


def numbering(scheme: str, tag: str, chains: str) -> str:
    """CTEs that end in num_{tag} (o_orderkey, numbering) for sequences of these chains, which share a scheme."""
    s = scheme_for(scheme, chains[0])
    numbers, none, stays = {}, {}, {}
    for r, rule in s.rules.items():
        if isinstance(rule, Lead):
            continue  # without insertions the alignment's numbers stay
        if isinstance(rule, Symmetric):
            found = _symmetric(rule), f"n > {rule.most}" if rule.most else None, None
        elif isinstance(rule, Stretch):
            found = _ladder(Ladder((rule.at, *(p for p in range(1, rule.last + 1) if p != rule.at))))
        elif isinstance(rule, Canonical):
            found = _canonical(rule)
        elif isinstance(rule, ByChain):
            usual, none_, stays_ = _ladder(rule.usual)
            found = f"CASE {' '.join(f'WHEN chain = {chr(39)}{c}{chr(39)} THEN {_ladder(x)[0]}' for c, x in rule.chains)} ELSE {usual} END", none_, stays_
        else:
            found = _ladder(rule)
        numbers[r], none[r], stays[r] = found
    case = lambda of, otherwise: f"CASE {' '.join(f'WHEN region = {r} THEN {x}' for r, x in of.items() if x)} ELSE {otherwise} END" if any(of.values()) else otherwise
    gaps = "array_to_string(list_transform(range(coalesce(lag(num) OVER w, 0) + 1, num), lambda q: q || ':- '), '') || " if s.gaps else ""
    return f"""base_{tag}(state, region, num, code) AS (VALUES {", ".join(f"({a}, {b}, {c}, '{d}')" for a, b, c, d in _base(s))}),
x_{tag} AS (SELECT st.*, region, CAST(num AS BIGINT) AS num, code FROM st JOIN base_{tag} b ON b.state = st.state WHERE chain IN ({", ".join(f"'{c}'" for c in chains)})),
r_{tag} AS (SELECT o_orderkey, chain, region, count(*) AS n, string_agg(aa, '' ORDER BY pos) AS letters FROM x_{tag} GROUP BY ALL),
n_{tag} AS (SELECT o_orderkey, region, CASE WHEN {case(stays, "false")} THEN NULL ELSE {case(numbers, "NULL")} END AS own, {case(none, "false")} AS fails FROM r_{tag}, likes),
y_{tag} AS (SELECT x.*, row_number() OVER (PARTITION BY x.o_orderkey, x.region ORDER BY pos) AS nth, own FROM x_{tag} x JOIN n_{tag} n ON n.o_orderkey = x.o_orderkey AND n.region = x.region),
z_{tag} AS (SELECT o_orderkey, pos, aa, CASE WHEN own IS NULL THEN num ELSE own[nth].n END AS num, CASE WHEN own IS NULL THEN code ELSE own[nth].c END AS code FROM y_{tag}),
e_{tag} AS (SELECT o_orderkey, pos, num, {gaps}num || code || ':' || aa AS entry FROM z_{tag} WINDOW w AS (PARTITION BY o_orderkey ORDER BY pos)),
f_{tag} AS (SELECT o_orderkey, bool_or(fails) AS fails FROM n_{tag} GROUP BY o_orderkey),
num_{tag} AS (SELECT e.o_orderkey, CASE WHEN any_value(fails) THEN '' ELSE string_agg(entry, ' ' ORDER BY pos) END AS numbering FROM e_{tag} e JOIN f_{tag} f ON f.o_orderkey = e.o_orderkey GROUP BY e.o_orderkey)"""


_LIKE = "likes AS (SELECT MAP {" + ", ".join(f"'{a}{b}': {score(a, b)}" for a in ALPHABET for b in ALPHABET + "X") + "} AS blosum)"


def numbered(scheme: str, chains: str = CHAINS) -> str:
    """CTEs that end in numbered (o_orderkey, chain, numbering, error) under a scheme."""
    if scheme in ("imgt", "aho"):
        groups = {"a": chains}
    else:
        groups = {"h": "H", "l": "KL"}
    every = " UNION ALL ".join(f"SELECT * FROM num_{t}" for t in groups)
    error = "NULL" if len(groups) == 1 else f"CASE WHEN chain NOT IN ('H', 'K', 'L') THEN 'Unimplemented numbering scheme {scheme} for chain ' || chain END"
    return f"""{MADE},
{STATES},
{_LIKE},
{", ".join(numbering(scheme, t, c) for t, c in groups.items())},
numbered AS (SELECT m.o_orderkey, m.chain, n.numbering, {error} AS error FROM made m LEFT JOIN ({every}) n ON n.o_orderkey = m.o_orderkey)"""


#: Local alignment cell by cell: the last 33 cells of the 32 x 32 table in order of rows, the last 32 gaps along the query, the gap along the target, and the first best cell.
#: A cell holds its score, and matches and columns of its alignment; a diagonal step comes before a gap along the target, that before one along the query.
ALIGNED = f"""q AS (SELECT p_partkey, {residues("p_partkey")} AS a, {residues("p_partkey - 1")} AS b FROM part),
{_LIKE},
d AS (
  SELECT p_partkey, a, b, 0 AS k, list_transform(range(33), lambda x: {{'v': 0, 's': 0, 'c': 0}}) AS hs, list_transform(range(32), lambda x: {{'v': -10000, 's': 0, 'c': 0}}) AS fs, {{'v': -10000, 's': 0, 'c': 0}} AS e, {{'v': 0, 's': 0, 'c': 0}} AS best FROM q
  UNION ALL
  SELECT p_partkey, a, b, k + 1, list_append(hs[2:33], h), list_append(fs[2:32], f), e2, CASE WHEN h.v > best.v THEN h ELSE best END FROM (
    SELECT *, CASE WHEN greatest(m, e2.v, f.v) <= 0 THEN {{'v': 0, 's': 0, 'c': 0}} WHEN m >= greatest(e2.v, f.v) THEN {{'v': m, 's': diag.s + CAST(ai = bj AS INTEGER), 'c': diag.c + 1}} WHEN e2.v >= f.v THEN e2 ELSE f END AS h FROM (
      SELECT *, diag.v + blosum[ai || bj] AS m,
        CASE WHEN up.v - 11 >= fs[1].v - 1 THEN {{'v': up.v - 11, 's': up.s, 'c': up.c + 1}} ELSE {{'v': fs[1].v - 1, 's': fs[1].s, 'c': fs[1].c + 1}} END AS f,
        CASE WHEN back.v - 11 >= e1.v - 1 THEN {{'v': back.v - 11, 's': back.s, 'c': back.c + 1}} ELSE {{'v': e1.v - 1, 's': e1.s, 'c': e1.c + 1}} END AS e2 FROM (
        SELECT d.*, blosum, substr(a, 1 + k // 32, 1) AS ai, substr(b, 1 + k % 32, 1) AS bj,
          CASE WHEN k < 32 OR k % 32 = 0 THEN {{'v': 0, 's': 0, 'c': 0}} ELSE hs[1] END AS diag, CASE WHEN k < 32 THEN {{'v': 0, 's': 0, 'c': 0}} ELSE hs[2] END AS up,
          CASE WHEN k % 32 = 0 THEN {{'v': 0, 's': 0, 'c': 0}} ELSE hs[33] END AS back, CASE WHEN k % 32 = 0 THEN {{'v': -10000, 's': 0, 'c': 0}} ELSE e END AS e1 FROM d, likes WHERE k < 1024))))"""
