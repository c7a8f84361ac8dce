"""Queries of the driver's contract over its tables, and DuckDB SQL for those that SQL can express.

The tables hold no protein sequences, so sequences are derived from keys: 32 residues from a digest, in the same way by both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions.alignment import sw_identity, sw_score
from .kernel.genes import built_in
from .kernel.sw import K, LAMBDA
from .operators import germline as G
from .operators import hits as H
from .operators import numbering as N
from .operators import regions as R
from .operators import sequences as S
from .plans import engine as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def residues(*salted: Column | str) -> Column:
    """32 residues from the digest of each key, one after the other."""
    keys = [F.col(k).cast("string") if isinstance(k, str) else k for k in salted]
    return F.concat(*[F.translate(F.md5(k), "0123456789abcdef", "ACDEFGHIKLMNPQRS") for k in keys])


def _res(key: str) -> str:
    return f"translate(md5(CAST({key} AS VARCHAR)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS')"


# --- regions, distinct and replay ---------------------------------------------------------------------

_STATUS = ", ".join(f"CASE WHEN hi < {a} OR lo > {b} THEN 'absent' WHEN lo <= {a} AND hi >= {b} THEN 'complete' ELSE 'partial' END AS {r}" for r, (a, b) in R.REGIONS.items())


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 128 AS lo, least(128, 1 + l_partkey % 128 + l_suppkey % 128) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, lo, hi, {_STATUS} FROM s""")
def region_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection: seven cases a row."""
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.col("l_partkey") % 128).alias("lo"), F.col("l_suppkey")).withColumn("hi", F.least(F.lit(128), F.col("lo") + F.col("l_suppkey") % 128)).drop("l_suppkey")
    return spans.select("l_orderkey", "l_linenumber", "lo", "hi", *(c.alias(r) for r, c in R.annotate("lo", "hi").items()))


@query(f"SELECT p_partkey, {_res('p_partkey % 100')} AS sequence, CAST(32 - length(replace({_res('p_partkey % 100')}, 'A', '')) AS INTEGER) AS n_alanine FROM part")
def dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", residues((F.col("p_partkey") % 100).cast("string")).alias("sequence"))
    return S.once_per_sequence(rows, lambda d: d.withColumn("n_alanine", F.length("sequence") - F.length(F.replace("sequence", F.lit("A"), F.lit("")))))


@query(f"""WITH s AS (SELECT c_custkey, {_res('c_custkey')} || CASE WHEN c_custkey % 7 = 0 THEN 'x1' WHEN c_custkey % 11 = 0 THEN 'BZB-' WHEN c_custkey % 13 = 0 THEN repeat('A', 10000) ELSE '' END AS sequence FROM customer),
b AS (SELECT *, list_sort(list_distinct(string_split(regexp_replace(upper(sequence), '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), ''))) AS odd, length(regexp_replace(upper(sequence), '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) AS n FROM s)
SELECT c_custkey, CASE WHEN length(sequence) >= 10000 THEN 'Sequence too long.' WHEN n > 0 THEN 'Unknown amino acid letter found in sequence: ' || array_to_string(odd, ', ') END AS error FROM b""")
def sequence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tail = F.when(k % 7 == 0, "x1").when(k % 11 == 0, "BZB-").when(k % 13 == 0, F.repeat(F.lit("A"), F.lit(10000))).otherwise("")
    return read(spark, sf_dir, "customer").select("c_custkey", F.concat(residues("c_custkey"), tail).alias("sequence")).select("c_custkey", S.validation_error("sequence").alias("error"))


@query(f"SELECT c_custkey, length(repeat({_res('c_custkey')}, CAST(1 + c_custkey % 4 AS BIGINT))) >= 70 AS long_enough FROM customer")
def min_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.repeat(residues("c_custkey"), (1 + F.col("c_custkey") % 4).cast("int")).alias("sequence"))
    return rows.select("c_custkey", S.long_enough("sequence").alias("long_enough"))


# --- hits ---------------------------------------------------------------------------------------------

#: A user's events as a sequence's hits: places from their order in time, species and chain from their ids.
_HITS = """h AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS hit_ord, event_id,
  ['human','mouse','pan'][1 + event_id % 3] || '_' || ['H','K','L','A','B','G','D'][1 + event_id % 7] AS hit_id, round(value, 1) AS bitscore, CAST(1 + event_id % 9 AS DOUBLE) / 8 AS evalue FROM events),
hits AS (SELECT *, hit_ord * 7 AS query_start, CAST(hit_ord * 7 + 5 + event_id % 20 AS INTEGER) AS query_end FROM h)"""
THRESHOLD = 20.0


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (1 + F.col("event_id") % n).cast("int"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    h = e.select("user_id", order.alias("hit_ord"), "event_id", F.concat_ws("_", pick(["human", "mouse", "pan"], 3), pick(list("HKLABGD"), 7)).alias("hit_id"), F.round("value", 1).alias("bitscore"), ((1 + F.col("event_id") % 9).cast("double") / 8).alias("evalue"))
    return h.withColumn("query_start", F.col("hit_ord") * 7).withColumn("query_end", (F.col("hit_ord") * 7 + 5 + F.col("event_id") % 20).cast("int"))


@query(f"WITH {_HITS} SELECT event_id, user_id, hit_id, bitscore FROM hits WHERE bitscore >= {THRESHOLD}")
def hit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_hits(spark, sf_dir).where(H.over(THRESHOLD)).select("event_id", "user_id", "hit_id", "bitscore")


@query(f"""WITH {_HITS}, u AS (SELECT user_id, max(CASE WHEN bitscore >= 60 AND hit_id LIKE 'mouse%' THEN 1 ELSE 0 END) = 0 AS reverted FROM hits GROUP BY user_id)
SELECT event_id, user_id, hit_id, reverted FROM hits JOIN u USING (user_id) WHERE reverted OR (bitscore >= 60 AND hit_id LIKE 'mouse%')""")
def species_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.limit_species(event_hits(spark, sf_dir), "user_id", ["mouse"], 60.0).select("event_id", "user_id", "hit_id", "reverted")


@query(f"WITH {_HITS} SELECT event_id, split_part(hit_id, '_', 1) AS species, split_part(hit_id, '_', 2) AS chain FROM hits WHERE split_part(hit_id, '_', 2) IN ('H', 'K', 'L')")
def allow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = event_hits(spark, sf_dir).select("event_id", H.species_of("hit_id").alias("species"), H.chain_of("hit_id").alias("chain"))
    return h.where(H.allowed("chain", ("H", "K", "L")))


@query(f"WITH {_HITS} SELECT CASE WHEN split_part(hit_id, '_', 2) IN ('K', 'L') THEN 'L' ELSE split_part(hit_id, '_', 2) END AS chain_class, count(*) AS n FROM hits GROUP BY 1")
def chain_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_hits(spark, sf_dir).groupBy(H.chain_class(H.chain_of("hit_id")).alias("chain_class")).agg(F.count("*").alias("n"))


_FOLD = f"""WITH RECURSIVE {_HITS},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY evalue, hit_ord) AS rn FROM hits WHERE bitscore >= {THRESHOLD}),
f AS (
  SELECT user_id, rn, [{{'s': query_start, 'e': query_end, 'o': hit_ord}}] AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn, CASE WHEN len(list_filter(f.kept, lambda d: o.query_start < d.e AND d.s < o.query_end)) > 0 THEN f.kept ELSE list_append(f.kept, {{'s': o.query_start, 'e': o.query_end, 'o': o.hit_ord}}) END
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1),
z AS (SELECT user_id, arg_max(kept, rn) AS kept FROM f GROUP BY user_id),
d AS (SELECT user_id, unnest(kept) AS k FROM z),
doms AS (SELECT d.user_id, CAST(row_number() OVER (PARTITION BY d.user_id ORDER BY k.s, k.o) - 1 AS INTEGER) AS dom_ord, h.hit_id, h.query_start, h.query_end FROM d JOIN hits h ON h.user_id = d.user_id AND h.hit_ord = k.o)
"""


@query(f"{_FOLD} SELECT * FROM doms")
def greedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = H.without_overlap(event_hits(spark, sf_dir), "user_id", THRESHOLD)
    return d.select("user_id", F.posexplode("domains").alias("dom_ord", "d")).select("user_id", "dom_ord", "d.hit_id", "d.query_start", "d.query_end")


@query(f"{_FOLD} SELECT user_id, hit_id, query_start FROM doms WHERE dom_ord = 0")
def first_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = H.without_overlap(event_hits(spark, sf_dir), "user_id", THRESHOLD)
    return d.select("user_id", H.first_domain().alias("d")).select("user_id", "d.hit_id", "d.query_start")


# --- germline -----------------------------------------------------------------------------------------

_GENES = built_in()
_GENE_ROWS = ", ".join(f"('{g.segment}', '{g.chain}', '{g.species}', {g.species_ord}, '{g.name}', {g.gene_ord}, '{g.aligned}', {k})" for k, g in enumerate(_GENES))
_GENE_SQL = f"genes(seg, chain, species, species_ord, gene, gene_ord, aligned, gene_index) AS (VALUES {_GENE_ROWS})"
_CHAINS = ["H", "K", "L", "A", "B", "G", "D"]


def genes(spark: SparkSession) -> DataFrame:
    return G.gene_table(spark, _GENES)


def _query_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aligned row for each order: a V gene of its chain, with every residue column whose digest letter is A replaced by it."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _CHAINS)), (1 + F.col("o_orderkey") % 7).cast("int")).alias("chain"), *[residues(F.concat(F.col("o_orderkey").cast("string"), F.lit(f":{k}"))).alias(f"d{k}") for k in range(4)])
    v = genes(spark).where("seg = 'V'").groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("species_ord", "gene_ord", "aligned"))).alias("vs"))
    j = o.join(v, "chain").withColumn("base", F.element_at("vs", (1 + F.floor(F.col("o_orderkey") / 7) % F.size("vs")).cast("int"))["aligned"]).withColumn("noise", F.concat("d0", "d1", "d2", "d3"))
    mixed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.when(F.substring("noise", i, F.lit(1)).isin("A", "C"), F.substring("noise", i, F.lit(1))).otherwise(F.substring("base", i, F.lit(1)))), "")
    return j.select("o_orderkey", "chain", mixed.alias("aligned_query"))


_NOISE = " || ".join(_res(f"o_orderkey || ':{k}'") for k in range(4))
_QUERY_SQL = f"""{_GENE_SQL},
vs AS (SELECT chain, list(aligned ORDER BY species_ord, gene_ord) AS vs FROM genes WHERE seg = 'V' GROUP BY chain),
o AS (SELECT o_orderkey, ['H','K','L','A','B','G','D'][1 + o_orderkey % 7] AS chain, {_NOISE} AS noise FROM orders),
b AS (SELECT o_orderkey, chain, noise, vs[1 + (o_orderkey // 7) % len(vs)] AS base FROM o JOIN vs USING (chain)),
q AS (SELECT o_orderkey, chain, array_to_string(list_transform(range(1, 129), lambda i: CASE WHEN substr(noise, i, 1) IN ('A', 'C') THEN substr(noise, i, 1) ELSE substr(base, i, 1) END), '') AS aligned_query FROM b),
sc AS (SELECT q.o_orderkey, g.*, CAST(len(list_filter(range(1, 129), lambda i: substr(g.aligned, i, 1) <> '-' AND substr(g.aligned, i, 1) = substr(q.aligned_query, i, 1))) AS DOUBLE) / len(replace(g.aligned, '-', '')) AS identity FROM q JOIN genes g USING (chain)),
v AS (SELECT o_orderkey, chain, species, gene, identity FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY identity DESC, species_ord, gene_ord) AS rn FROM sc WHERE seg = 'V') WHERE rn = 1 AND identity > 0)"""


@query(f"WITH {_QUERY_SQL} SELECT o_orderkey, species, gene, identity FROM v")
def identity_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_by_identity(_query_columns(spark, sf_dir), genes(spark), "o_orderkey", "V", ["chain"])


@query(f"""WITH {_QUERY_SQL}, j AS (SELECT sc.o_orderkey, sc.gene AS j_gene, sc.identity AS j_identity, row_number() OVER (PARTITION BY sc.o_orderkey ORDER BY sc.identity DESC, sc.gene_ord) AS rn FROM sc JOIN v ON v.o_orderkey = sc.o_orderkey AND v.species = sc.species WHERE sc.seg = 'J')
SELECT v.o_orderkey, v.species, v.gene AS v_gene, j.j_gene, j.j_identity FROM v LEFT JOIN j ON j.o_orderkey = v.o_orderkey AND j.rn = 1 AND j.j_identity > 0""")
def j_within_v_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _query_columns(spark, sf_dir)
    v = G.best_by_identity(q, genes(spark), "o_orderkey", "V", ["chain"])
    j = G.best_by_identity(q.join(v.select("o_orderkey", "species"), "o_orderkey"), genes(spark), "o_orderkey", "J", ["chain", "species"])
    return v.join(j.select("o_orderkey", F.col("gene").alias("j_gene"), F.col("identity").alias("j_identity")), "o_orderkey", "left").select("o_orderkey", "species", F.col("gene").alias("v_gene"), "j_gene", "j_identity")


@query(f"WITH {_GENE_SQL}, s AS (SELECT chain, list(DISTINCT species) AS sp FROM genes WHERE seg = 'V' GROUP BY chain) SELECT chain, NOT (list_contains(sp, 'human') AND list_contains(sp, 'alpaca')) AS missing FROM s")
def allowed_species_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = genes(spark).where("seg = 'V'").groupBy("chain").agg(F.collect_set("species").alias("sp"))
    return s.select("chain", G.missing_species(["human", "alpaca"], "sp").alias("missing"))


@query(f"WITH {_GENE_SQL} SELECT chain, CAST(sum(length(replace(aligned, '-', ''))) AS BIGINT) AS length FROM genes WHERE seg = 'V' AND species IN ('human') GROUP BY chain")
def db_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.database_length(genes(spark), "V", ["human"])


@query(f"WITH {_GENE_SQL} SELECT chain, CAST(max(length(rtrim(aligned, '-'))) AS INTEGER) AS length FROM genes WHERE seg = 'J' AND gene_ord = 0 GROUP BY chain")
def canonical_j_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_j_length(genes(spark))


_REDUCE = "translate(%s, 'LVIMCAGSTPFYWEDNQKRHX', '000001111122233334456')"
_KMERS = f"list_sort(list_distinct(list_transform(range(1, 30), lambda i: substr({_REDUCE % 's'}, i, 4))))"


@query(f"WITH p AS (SELECT p_partkey, {_res('p_partkey')} AS s FROM part) SELECT p_partkey, array_to_string({_KMERS}, ' ') AS kmers FROM p")
def kmer_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", residues("p_partkey").alias("sequence")).select("p_partkey", F.array_join(G.kmers("sequence"), " ").alias("kmers"))


@query(f"""WITH {_GENE_SQL}, gk AS (SELECT gene_index, unnest(list_distinct(list_transform(range(1, length(replace(aligned, '-', '')) - 2), lambda i: substr({_REDUCE % "replace(aligned, '-', '')"}, i, 4)))) AS kmer FROM genes),
p AS (SELECT p_partkey, {_res('p_partkey')} AS s FROM part), pk AS (SELECT p_partkey, unnest({_KMERS}) AS kmer FROM p),
c AS (SELECT p_partkey, gene_index, count(*) AS hits FROM pk JOIN gk USING (kmer) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY hits DESC, gene_index) AS INTEGER) AS rank FROM c)
SELECT p_partkey, gene_index, hits, rank FROM r WHERE rank <= 5""")
def kmer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spark.createDataFrame([(k, g.ungapped) for k, g in enumerate(_GENES)], "gene_index int, ungapped string")
    q = read(spark, sf_dir, "part").select("p_partkey", residues("p_partkey").alias("sequence"))
    return G.top_by_kmers(q, index, "p_partkey", 5)


@query(f"""WITH RECURSIVE {oracle.ALIGNED}
SELECT p_partkey, a, b, CAST(best.v AS BIGINT) AS score, CASE WHEN best.v > 0 THEN CAST(best.s AS DOUBLE) / best.c ELSE 0 END AS identity FROM d WHERE k = 1024""")
def sw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's whole sequence against that of the part before it."""
    keys = read(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file is few tasks' work, but much of it
    p = keys.select("p_partkey", residues("p_partkey").alias("a"), residues((F.col("p_partkey") - 1).cast("string")).alias("b"))
    return p.select("p_partkey", "a", "b", sw_score("a", "b").alias("score"), sw_identity("a", "b").alias("identity"))


@query(f"SELECT p_partkey, round(({LAMBDA} * (20 + p_size) - ln({K})) / ln(2.0), 6) AS bits, CAST(100 AS DOUBLE) * 5000 * pow(2.0, -(20 + p_size)) AS evalue FROM part")
def bit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = 20 + F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(G.bit_score(raw), 6).alias("bits"), G.evalue(raw, F.lit(100), F.lit(5000)).alias("evalue"))


@query("""WITH s AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) % 5 AS score, ['human','mouse','pig'][1 + l_partkey % 3] AS species, 'IGHV' || (l_suppkey % 7) AS gene FROM lineitem), e AS (SELECT *, 1000 * pow(2.0, -score) AS evalue FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY evalue, score DESC, species, gene) AS rn FROM e)
SELECT l_orderkey, species, gene, evalue, score FROM r WHERE rn = 1""")
def evalue_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    s = li.select("l_orderkey", (F.col("l_quantity").cast("int") % 5).alias("score"), F.element_at(F.array(F.lit("human"), F.lit("mouse"), F.lit("pig")), (1 + F.col("l_partkey") % 3).cast("int")).alias("species"), F.concat(F.lit("IGHV"), F.col("l_suppkey") % 7).alias("gene"))
    return G.best_by_evalue(s.withColumn("evalue", 1000 * F.pow(F.lit(2.0), -F.col("score"))), "l_orderkey")


# --- numbering ----------------------------------------------------------------------------------------


def _shown(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat(x["num"].cast("string"), F.trim(x["ins"]), F.lit(":"), x["aa"])), " ")


_LOOP = f"""WITH s AS (SELECT o_orderkey, substr({_res('o_orderkey')}, 1, CAST(o_orderkey % 33 AS INTEGER)) AS s FROM orders),
a AS (SELECT *, length(s) AS n, least(length(s), 13) AS held, greatest(length(s) - 13, 0) AS extra FROM s),
b AS (SELECT *, held // 2 AS r, held - held // 2 AS l, extra // 2 AS il, extra - extra // 2 AS ir, 13 - held AS g FROM a)
SELECT o_orderkey, array_to_string(list_transform(range(0, n + g), lambda k: CAST(CASE WHEN k < l THEN 105 + k WHEN k < l + il THEN 104 + l WHEN k < l + il + g THEN 105 + k - il WHEN k < l + il + g + ir THEN 118 - r ELSE 118 - r + k - (l + il + g + ir) END AS VARCHAR)
  || CASE WHEN k >= l AND k < l + il THEN chr(CAST(65 + k - l AS INTEGER)) WHEN k >= l + il + g AND k < l + il + g + ir THEN chr(CAST(65 + l + il + g + ir - 1 - k AS INTEGER)) ELSE '' END || ':'
  || CASE WHEN k >= l + il AND k < l + il + g THEN '-' WHEN k < l + il THEN substr(s, CAST(k + 1 AS INTEGER), 1) ELSE substr(s, CAST(k - g + 1 AS INTEGER), 1) END), ' ') AS numbering FROM b"""


@query(_LOOP)
def imgt_cdr_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.substring(residues("o_orderkey"), F.lit(1), (F.col("o_orderkey") % 33).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", N.symmetric_loop("s", 105, 117).alias("r")).select("o_orderkey", _shown("r").alias("numbering"))


_STEPS = "list_transform(range(1, 9), lambda i: CAST(i * 2 + (o_orderkey + i) % 3 AS INTEGER))"


@query(f"""WITH s AS (SELECT o_orderkey, {_STEPS} AS nums, {_res('o_orderkey')} AS s FROM orders),
r AS (SELECT o_orderkey, list_sort(nums) AS nums, s FROM s),
f AS (SELECT o_orderkey, list_transform(range(1, 9), lambda i: array_to_string(list_append(list_transform(range(CASE WHEN i = 1 THEN 1 ELSE nums[i - 1] + 1 END, nums[i]), lambda p: p || ':-'), nums[i] || ':' || substr(s, i, 1)), ' ')) AS parts FROM r)
SELECT o_orderkey, array_to_string(parts, ' ') AS numbering FROM f""")
def gap_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nums = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i * 2 + (F.col("o_orderkey") + i) % 3).cast("int")))
    o = read(spark, sf_dir, "orders").select("o_orderkey", nums.alias("nums"), residues("o_orderkey").alias("s"))
    r = F.transform("nums", lambda n, k: F.struct(n.alias("num"), F.lit(" ").alias("ins"), F.substring("s", k + 1, F.lit(1)).alias("aa")))
    return o.select("o_orderkey", r.alias("r")).select("o_orderkey", N.fill_gaps("r").alias("f")).select("o_orderkey", _shown("f").alias("numbering"))


@query(f"""WITH s AS (SELECT o_orderkey, {_res("o_orderkey")} AS sequence FROM orders),
p AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN substr(sequence, 5, 9) || 'W' ELSE substr(sequence, 5, 10) END AS part FROM s),
r AS (SELECT *, list_transform(range(1, 11), lambda i: CASE WHEN o_orderkey % 7 = 0 AND i = 10 THEN 0 ELSE i END) AS nums FROM p)
SELECT o_orderkey, len(list_filter(range(2, 11), lambda i: nums[i] < nums[i - 1])) = 0 AND strpos(sequence, part) > 0 AS contiguous FROM r""")
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row has a letter of its own, every seventh a number that falls."""
    k = F.col("o_orderkey")
    letters = F.substring(residues("o_orderkey"), 5, 10)
    o = read(spark, sf_dir, "orders").select("o_orderkey", residues("o_orderkey").alias("sequence"), F.when(k % 5 == 0, F.concat(F.substring(letters, 1, 9), F.lit("W"))).otherwise(letters).alias("part"))
    r = F.transform(F.split("part", ""), lambda c, i: F.struct(F.when((k % 7 == 0) & (i == 9), 0).otherwise(i + 1).alias("num"), F.lit(" ").alias("ins"), c.alias("aa")))
    return o.withColumn("r", r).select("o_orderkey", S.is_contiguous("r", "sequence").alias("contiguous"))


_COLS = "translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'mmmmmmmmmmiidddm')"


@query(f"""WITH s AS (SELECT o_orderkey, {_COLS} AS c, CAST(o_orderkey % 9 AS INTEGER) AS qs, CAST(o_orderkey % 90 AS INTEGER) AS hs FROM orders),
x AS (SELECT o_orderkey, c, qs, hs, CAST(unnest(range(1, 33)) AS INTEGER) AS k FROM s)
SELECT o_orderkey, k - 1 AS pos, hs + 1 + length(replace(substr(c, 1, k - 1), 'i', '')) AS id, substr(c, k, 1) AS typ, CASE WHEN substr(c, k, 1) <> 'd' THEN CAST(qs + length(replace(substr(c, 1, k - 1), 'd', '')) AS INTEGER) END AS si FROM x""")
def align_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "mmmmmmmmmmiidddm").alias("c"), (F.col("o_orderkey") % 9).cast("int").alias("qs"), (F.col("o_orderkey") % 90).cast("int").alias("hs"))
    return o.select("o_orderkey", F.posexplode(H.states("c", "qs", "hs")).alias("pos", "s")).select("o_orderkey", "pos", F.col("s.id").cast("long").alias("id"), "s.typ", "s.si")


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS qs, CAST(100 + o_orderkey % 9 AS INTEGER) AS qe, CAST(o_orderkey // 7 % 6 AS INTEGER) AS hs, CAST(120 + o_orderkey // 3 % 9 AS INTEGER) AS he,
  CAST(104 + o_orderkey % 5 AS INTEGER) AS length, o_orderkey % 4 <> 0 AS first, o_orderkey % 3 <> 0 AS alone FROM orders),
m AS (SELECT *, CASE WHEN NOT first OR hs NOT BETWEEN 1 AND 4 THEN 0 WHEN qs >= hs THEN hs WHEN hs - qs < qs THEN hs - qs ELSE qs END AS more, CASE WHEN alone AND he BETWEEN 124 AND 127 AND length > qe THEN least(128 - he, length - qe) ELSE 0 END AS tail FROM s)
SELECT o_orderkey, qs - more AS qs, qe + tail AS qe, hs - more AS hs, he + tail AS he FROM m""")
def terminal_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = read(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 7).cast("int").alias("qs"), (100 + k % 9).cast("int").alias("qe"), (F.floor(k / 7) % 6).cast("int").alias("hs"), (120 + F.floor(k / 3) % 9).cast("int").alias("he"), (104 + k % 5).cast("int").alias("length"))
    return h.select("o_orderkey", *(c.alias(n) for n, c in H.extended("qs", "qe", "hs", "he", "length", F.lit(128), k % 4 != 0, k % 3 != 0).items()))


# --- the kernel ---------------------------------------------------------------------------------------


def made_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain for each order, from its own key: a V gene of its chain, 3 to 6 digest residues, a J gene; one order in three has few substitutions.

    With short loops the best path goes through the whole domain, so the numbering follows from the genes' columns, which is what the SQL goes by.
    """
    rows = [(k, c, v.ungapped, j.ungapped) for k, (c, v, j) in enumerate(oracle.pairs_of(_GENES))]
    parts = F.broadcast(spark.createDataFrame(rows, "pair int, chain string, v string, j string"))
    k, turn = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / len(rows))  # by turns, each pair meets each length and both kinds
    o = read(spark, sf_dir, "orders").select("o_orderkey").withColumn("pair", (k % len(rows)).cast("int"))
    loop = F.substring(residues("o_orderkey"), F.lit(1), (3 + turn % 4).cast("int"))
    # two framework residues, at places and to letters that further digests of the key give
    noise = residues(F.concat(k.cast("string"), F.lit(":v")))
    at = lambda first, bits: (first + F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(":at"))), bits, 1), 16, 10).cast("int")).cast("int")
    put = lambda c, place, letter: F.concat(F.substring(c, F.lit(1), place - 1), letter, F.substring(c, place + 1, F.lit(200)))
    few = put(put(F.col("v"), at(2, 1), F.substring(noise, 1, 1)), at(60, 2), F.substring(noise, 2, 1))
    return o.join(parts, "pair").select("o_orderkey", "chain", F.concat(F.when(turn % 3 == 0, few).otherwise(F.col("v")), loop, "j").alias("sequence"))


def _numbered(scheme: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = E.annotate(E.alike(made_sequences(spark, sf_dir)), E.AnnotateOptions(scheme=scheme, wanted=("chain_type", "residues")), distinct=False)
        return a.select("o_orderkey", "chain", F.try_element_at("domains", F.lit(1)).alias("d"), "error").select("o_orderkey", "chain", F.col("d.chain_type").alias("found"), _shown("d.residues").alias("numbering"), "error")

    run.__name__ = f"number_{scheme}"
    return run


for _scheme in ("imgt", "chothia", "kabat", "martin", "aho", "wolfguy"):
    query(f"WITH {oracle.numbered(_scheme)} SELECT o_orderkey, chain, CASE WHEN numbering IS NOT NULL THEN chain END AS found, numbering, error FROM numbered")(_numbered(_scheme))


@query()
def profile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hit_rows(E.annotate(E.alike(made_sequences(spark, sf_dir)), E.AnnotateOptions(wanted=("hits",)), distinct=False)).select("o_orderkey", "chain", "hit_ord", "id", "evalue", "bitscore", "query_start", "query_end")


@query()
def annotate_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = E.AnnotateOptions(assign_germline=True, regions=True, wanted=("chain_type", "species", "bitscore", "germline", "covered"))
    a = E.annotate(E.alike(made_sequences(spark, sf_dir)), o, distinct=False)
    return E.domain_rows(a).select("o_orderkey", "chain", "chain_type", "species", "bitscore", "germline.v_gene", "germline.v_identity", "germline.j_gene", F.col("covered.lo").alias("covered_lo"), F.col("covered.hi").alias("covered_hi"), F.col("regions")["cdr3"].alias("cdr3"))


_OTHER_J = " ".join(f"WHEN chain = '{c}' AND v_species = '{sp}' THEN '{js[0]}'" for c in _CHAINS for sp in dict.fromkeys(g.species for g in _GENES) if len(js := [g.name for g in _GENES if (g.chain, g.segment, g.species) == (c, "J", sp)]) == 1)


@query(f"""WITH {oracle.MADE}, j AS (SELECT *, j_gene IN (SELECT gene FROM genes_j WHERE species = v_species AND genes_j.chain = made.chain) AS own FROM made)
SELECT o_orderkey, chain, chain AS chain_type, v_species AS species, v_gene, CASE WHEN own THEN j_gene ELSE CASE {_OTHER_J} END END AS j_gene, 1 AS covered_lo, CASE WHEN chain IN ('K', 'L', 'B') THEN 127 ELSE 128 END AS covered_hi, 'complete' AS cdr3 FROM j""".replace("WITH ", "WITH genes_j(chain, species, gene) AS (VALUES " + ", ".join(f"('{g.chain}', '{g.species}', '{g.name}')" for g in _GENES if g.segment == "J") + "), ", 1))
def annotate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What annotate_end_to_end() reports without its scores: the genes that each sequence was made from, J genes being of the V gene's species."""
    return annotate_end_to_end(spark, sf_dir).drop("bitscore", "v_identity")


@query(f"""WITH {oracle.numbered("kabat")}
SELECT o_orderkey, chain, CASE WHEN error IS NULL THEN CASE WHEN chain = 'H' THEN 'H' ELSE 'L' END END AS chain_class, CAST(len(string_split(numbering, ' ')) AS INTEGER) AS n, error AS reason FROM numbered""")
def number_first_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.number_first(E.alike(made_sequences(spark, sf_dir)), "kabat", distinct=False)
    return n.select("o_orderkey", "chain", "chain_class", F.size("numbering").alias("n"), "reason")


@query()
def long_cdr3_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heavy order's domain with a third loop of 60 residues."""
    h = made_sequences(spark, sf_dir).where("chain = 'H'")
    loop = F.substring(residues(F.concat(F.col("o_orderkey").cast("string"), F.lit("x")), F.concat(F.col("o_orderkey").cast("string"), F.lit("y"))), 1, 60)
    made = h.select("o_orderkey", F.concat(F.substring("sequence", 1, 98), loop, F.lit("FDPWGQGTLVSVSS")).alias("sequence"))
    a = E.annotate(E.alike(made), E.AnnotateOptions(wanted=("query_end", "residues")), distinct=False)
    return a.select("o_orderkey", F.length("sequence").alias("length"), F.try_element_at("domains", F.lit(1)).alias("d")).select("o_orderkey", "length", "d.query_end", F.size("d.residues").alias("n"))


_AT = "CAST(sum(CAST(list_contains(string_split(numbering, ' '), '%s') AS INTEGER)) AS BIGINT) AS %s"


@query(f"""WITH {oracle.numbered("imgt")} SELECT chain AS chain_type, count(*) AS n, {_AT % ("23:C", "c23")}, {_AT % ("41:W", "w41")}, {_AT % ("104:C", "c104")} FROM numbered GROUP BY chain""")
def anchor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the conserved residues C23, W41 and C104 stand in their columns, by chain."""
    d = E.domain_rows(E.annotate(E.alike(made_sequences(spark, sf_dir)), E.AnnotateOptions(wanted=("chain_type", "residues")), distinct=False))
    at = lambda n, aa: F.exists("residues", lambda r: (r["num"] == n) & (r["aa"] == aa)).cast("int")
    return d.groupBy("chain_type").agg(F.count("*").alias("n"), F.sum(at(23, "C")).alias("c23"), F.sum(at(41, "W")).alias("w41"), F.sum(at(104, "C")).alias("c104"))
