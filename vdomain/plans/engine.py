"""Annotation of sequences: one Arrow kernel over distinct sequences, between DataFrame operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel.domains import Hit, ProfileScan, ReplayScan, Scan, domains_of
from ..kernel.genes import Gene, GeneTable, Germline, canonical_j_lengths
from ..kernel.profile import Profile
from ..kernel.schemes import CODES, Numbered, Numberer, NumberingError, resolve_scheme
from ..operators import regions as R
from ..operators.hits import CHAINS, chain_class
from ..operators.sequences import LONGEST, RESIDUES, validation_error
from ..sources.reference import load_genes, load_profiles

STATE = "struct<id:int,typ:string,si:int>"
GERMLINE = "struct<empty:boolean,v_species:string,v_gene:string,v_identity:double,v_evalue:double,j_species:string,j_gene:string,j_identity:double,j_evalue:double>"
DOMAIN = f"struct<id:string,species:string,chain_type:string,evalue:double,bitscore:double,bias:double,query_start:int,query_end:int,scheme:string,state_vector:array<{STATE}>,residues:array<struct<num:int,ins:string,aa:string>>,start:int,end:int,germline:{GERMLINE},covered:struct<lo:int,hi:int>>"
HIT = "struct<id:string,description:string,evalue:double,bitscore:double,bias:double,query_start:int,query_end:int>"
RESULT_TYPES = {"domains": f"array<{DOMAIN}>", "hits": f"array<{HIT}>", "reverted_species": "boolean", "error": "string"}
#: A hit to replay: columns are m, i and d from the first match to the last.
REPLAYED = "struct<hit_id:string,evalue:double,bitscore:double,bias:double,query_start:int,query_end:int,hit_start:int,hit_end:int,columns:string>"


@dataclass(frozen=True)
class AnnotateOptions:
    """scheme: a name or its first letter; allow: chain types to report; allowed_species: of profiles and genes; germline_method: evalue or identity.

    database: path of a profile file (the session's, or profiles built from the genes, unless told otherwise).

    wanted: fields of domains, and `hits`, that are made, unless all are; the others are null (empty for hits).

    assign_germline: report genes, not only the species; regions: add the regions that each domain covers; validate: refuse sequences with other letters or
    that are too long; fail_fast: raise instead of giving an error column; keep_tail: number the last framework of fragments that end in it.
    """

    scheme: str = "imgt"
    allow: tuple[str, ...] = CHAINS
    allowed_species: tuple[str, ...] | None = None
    bit_score_threshold: float = 80.0
    germline_method: str = "evalue"
    assign_germline: bool = False
    regions: bool = False
    validate: bool = False
    fail_fast: bool = False
    keep_tail: bool = False
    min_length: int = 0
    database: str | None = None
    wanted: tuple[str, ...] | None = None
    batch: int = 256

    def wants(self, name: str) -> bool:
        """Whether a field of domains, or all domains, or hits are made."""
        return self.wanted is None or name in self.wanted or name == "domains" and any(x != "hits" for x in self.wanted)


def method_of(name: str | None) -> str:
    known = {None: "evalue", "identity": "identity", "evalue": "evalue", "e-value": "evalue", "e_value": "evalue"}
    if (name.lower() if name else None) not in known:
        raise ValueError(f"no such germline method: {name}")
    return known[name.lower() if name else None]


def result_type() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(", ".join(f"{c} {t}" for c, t in RESULT_TYPES.items())))


def covered(states: list[tuple[int, str, int | None]]) -> dict[str, int | None]:
    """First and last match state that has a residue."""
    ids = [i for i, kind, at in states if kind == "m" and at is not None]
    return {"lo": min(ids, default=None), "hi": max(ids, default=None)}


def annotate_batch(seqs: list[str], scan: Scan, table: GeneTable, lengths: dict[str, int], o: AnnotateOptions, numberer: Numberer | None = None) -> list[dict]:
    """The kernel: results of sequences, in order. A domain that can't be numbered leaves an error; its sequence's other domains stay.

    A domain's states and numbers are in `numbered`, by place in its `sequence`; domain_arrays() makes columns of them.
    """
    species, method = list(o.allowed_species or []), method_of(o.germline_method)
    numberer = numberer or Numberer(resolve_scheme(o.scheme), o.keep_tail)
    todo = [k for k, s in enumerate(seqs) if len(s) >= o.min_length]
    out: list[dict] = [{"sequence": s, "domains": None, "hits": [], "reverted_species": False, "error": None} for s in seqs]
    placed: list[tuple[dict, list, str, str]] = []  # domains, whose genes are looked up together
    for k, p in zip(todo, domains_of([seqs[k] for k in todo], scan, o.bit_score_threshold, lengths, species)):
        seq = seqs[k]
        if o.wants("hits"):
            out[k]["hits"] = [{"id": h.hit_id, "description": "", "evalue": h.evalue, "bitscore": h.bitscore, "bias": h.bias, "query_start": h.query_start, "query_end": h.query_end} for h in p.hits]
        # profiles of no single species are always the other ones; then genes decide
        out[k]["reverted_species"] = p.reverted
        if not o.wants("domains"):
            continue
        domains = []
        for d, states, start, end in zip(p.domains, p.states, p.starts, p.ends):
            if d.chain not in o.allow or not states:
                continue
            numbered = numberer(states, seq, d.chain)
            if numbered.error is not None:
                if o.fail_fast:
                    raise NumberingError(numbered.error)
                out[k]["error"] = out[k]["error"] or numbered.error
                continue
            domains.append(
                {"id": d.hit_id, "species": d.species, "chain_type": d.chain, "evalue": d.evalue, "bitscore": d.bitscore, "bias": d.bias, "query_start": start, "query_end": end, "scheme": numberer.scheme,
                 "start": numbered.first, "end": numbered.last, "germline": None, "covered": covered(states) if o.wants("covered") else None, "sequence": seq, "numbered": numbered})
            placed.append((domains[-1], states, seq, d.chain))
        out[k]["domains"] = domains or None
    if not (o.wants("species") or o.wants("germline")):
        return out
    found: list[Germline] = table.assign_all([x[1:] for x in placed], method if o.assign_germline else "identity", species)
    for (domain, *_), g in zip(placed, found):
        domain["species"] = g.v_species or domain["species"]
        if o.assign_germline:
            domain["germline"] = {f: (float(v) if isinstance(v := getattr(g, f), float) else v) for f in Germline.__dataclass_fields__}
    return out


def _letters(codes: np.ndarray) -> pa.Array:
    """One character each, from their code points."""
    if codes.max(initial=0) < 128:
        return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32)), pa.py_buffer(codes.astype(np.uint8)))
    return pa.array([chr(c) for c in codes.tolist()], pa.string())


_CODES = pa.array([*CODES, " "], pa.string())


def _structs(parts: list[np.ndarray], columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """A list of structs for each part, from columns over all parts."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)


def domain_arrays(rows: list[list[dict] | None], kind: pa.DataType, o: AnnotateOptions) -> pa.Array:
    """Domains of rows, as annotate_batch() gives them, as a column of this type; fields that aren't wanted are null."""
    flat = [d for r in rows for d in r or ()]
    numbered: list[Numbered] = [d["numbered"] for d in flat]
    join = lambda parts, t=np.int32: np.concatenate(parts).astype(t, copy=False) if parts else np.zeros(0, t)
    fields = []
    for f in kind.value_type:
        if not flat or not o.wants(f.name):
            fields.append(pa.nulls(len(flat), f.type))
        elif f.name == "state_vector":
            at = join([n.places for n in numbered])
            fields.append(_structs([n.ids for n in numbered], [pa.array(join([n.ids for n in numbered])), _letters(join([n.kinds for n in numbered])), pa.array(at, mask=at < 0)], f.type))
        elif f.name == "residues":
            parts = [n.residues for n in numbered]
            codes = join([n.codes for n in numbered])
            # a gap's place, -1, is that of the letter put behind each sequence
            letters = join([np.frombuffer((d["sequence"] + "-").encode("utf-32-le", "surrogatepass"), np.uint32)[n.residues] for d, n in zip(flat, numbered)], np.uint32)
            fields.append(_structs(parts, [pa.array(join([n.numbers for n in numbered])), _CODES.take(pa.array(np.where(codes < 0, len(CODES), codes))), _letters(letters)], f.type))
        else:
            fields.append(pa.array([d[f.name] for d in flat], f.type))
    values = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
    offsets = np.concatenate(([0], np.cumsum([len(r or ()) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=kind, mask=pa.array([r is None for r in rows], pa.bool_()))


def _parts(profiles: list[Profile], genes: list[Gene]) -> tuple:
    """As plain tuples and arrays, which any worker can read."""
    return [(p.name, p.match, p.step, p.tail) for p in profiles], [(g.segment, g.chain, g.species, g.species_ord, g.name, g.gene_ord, g.aligned) for g in genes]


#: Columns that annotate() adds.
RESULTS = ("domains", "hits", "reverted_species", "error")
#: Bytes of profiles and genes that are sent to every executor, at most.
MOST_SENT = 256 << 20


def annotate(df: DataFrame, options: AnnotateOptions = AnnotateOptions(), profiles: list[Profile] | None = None, genes: list[Gene] | None = None, replay: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """`df`, which has a `sequence` column, with domains (null if there are none), hits, reverted_species and error; its own columns of these names give way.

    Each distinct sequence is scanned once (`distinct`: skip that where few repeat, or in a stream; rows then go through the scan with all their columns).
    A null sequence has nulls. replay: (sequence, hits: array of REPLAYED) to use instead of a scan, joined by sequence; those without an entry have no hits.
    """
    spark = df.sparkSession
    genes = genes or load_genes(spark)
    o = options
    resolve_scheme(o.scheme)
    method_of(o.germline_method)
    parts = _parts([] if replay is not None else profiles or load_profiles(spark, o.database, genes), genes)
    if (size := len(pickle.dumps(parts))) > MOST_SENT:
        raise ValueError(f"profiles and genes take {size} bytes; {MOST_SENT} can be sent to all executors")
    held = spark.sparkContext.broadcast(parts)
    letters, kind = set(RESIDUES), result_type()
    results, replayed = [kind.field(c) for c in RESULTS], replay is not None
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in RESULTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ps, gs = held.value
        own = [Gene(*g) for g in gs]
        table, lengths, numberer = GeneTable(own), canonical_j_lengths(own), Numberer(resolve_scheme(o.scheme), o.keep_tail)
        scan = None if replayed else ProfileScan([Profile(*p) for p in ps])
        for whole in batches:
            for lo in range(0, whole.num_rows, o.batch):
                b = whole.slice(lo, o.batch)
                seqs = b.column("sequence").to_pylist()
                good = [k for k, s in enumerate(seqs) if s is not None and (not o.validate or s and len(s) < LONGEST and set(s.upper()) <= letters)]
                use = scan
                if replayed:
                    hits = b.column("_replayed").to_pylist()
                    use = ReplayScan({seqs[k]: [Hit(**h) for h in hits[k] or []] for k in good})
                rows: list[dict] = [dict.fromkeys(RESULTS)] * len(seqs)
                once = list(dict.fromkeys(seqs[k] for k in good))
                found = dict(zip(once, annotate_batch(once, use, table, lengths, o, numberer)))
                for k in good:
                    rows[k] = found[seqs[k]]
                for k in set(range(len(seqs))).difference(good):
                    if seqs[k] is not None:
                        rows[k] = {"domains": None, "hits": [], "reverted_species": False, "error": "invalid"}
                kept = [c for c in b.schema.names if c != "_replayed"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(domain_arrays([r["domains"] for r in rows], f.type, o) if f.name == "domains" else pa.array([r[f.name] for r in rows], f.type) for f in results)], [*kept, *RESULTS])

    def kernel(d: DataFrame) -> DataFrame:
        schema = d.drop("_replayed").select("*", *(F.lit(None).cast(t).alias(c) for c, t in RESULT_TYPES.items()))._jdf.schema().toDDL()
        out = d.mapInArrow(run, schema)
        if o.regions:  # before results are joined back: once per distinct sequence
            out = out.withColumn("domains", F.transform("domains", lambda d: d.withField("regions", R.as_map(d["covered"]["lo"], d["covered"]["hi"]))))
        return out

    def with_replay(d: DataFrame) -> DataFrame:
        if replay is None:
            return d
        known = replay.groupBy("sequence").agg(F.first("hits").alias("_replayed"))
        return d.join(known, "sequence", "left")

    if not distinct:
        out = kernel(with_replay(df))
    else:
        # one exchange: rows are dealt out by sequence, and each task drops its repeats
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        once = df.where("sequence is not null").select("sequence").repartition(n, "sequence").dropDuplicates().sortWithinPartitions(F.length("sequence"), "sequence")
        out = df.join(kernel(with_replay(once)), "sequence", "left").select(*df.columns, *RESULTS)
    if o.validate:
        out = out.withColumn("error", F.coalesce(validation_error("sequence"), "error"))
        if o.fail_fast:
            out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error("error").cast("string")))
    return out


def alike(df: DataFrame) -> DataFrame:
    """`df` dealt out by ranges of its sequences' lengths and letters: equal ones are scanned once then (with `distinct=False`), and what like ones begin with too."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, F.length("sequence"), "sequence").sortWithinPartitions(F.length("sequence"), "sequence")


def domain_rows(annotated: DataFrame) -> DataFrame:
    """One row per domain, with its place from N to C."""
    rest = [c for c in annotated.columns if c not in ("domains", "hits")]
    return annotated.select(*rest, F.posexplode("domains").alias("dom_ord", "d")).select(*rest, "dom_ord", "d.*")


def hit_rows(annotated: DataFrame) -> DataFrame:
    """One row per hit, by e-value."""
    rest = [c for c in annotated.columns if c not in ("domains", "hits")]
    return annotated.select(*rest, F.posexplode("hits").alias("hit_ord", "h")).select(*rest, "hit_ord", "h.*")


def residue_rows(domains: DataFrame) -> DataFrame:
    rest = [c for c in domains.columns if c not in ("residues", "state_vector", "germline", "covered", "regions")]
    return domains.select(*rest, F.posexplode("residues").alias("res_ord", "r")).select(*rest, "res_ord", "r.num", "r.ins", "r.aa")


def number_first(df: DataFrame, scheme: str = "imgt", allow: tuple[str, ...] = CHAINS, min_length: int = 70, threshold: float = 80.0, species: tuple[str, ...] = ("human", "mouse"), **resources) -> DataFrame:
    """`df` with numbering and chain_class of the first domain, and the reason where there is none. Never fails on a sequence."""
    try:
        resolve_scheme(scheme)
    except ValueError as e:
        none = df.withColumn("numbering", F.lit(None).cast("array<struct<num:int,ins:string,aa:string>>"))
        return none.withColumn("chain_class", F.lit(None).cast("string")).withColumn("reason", F.lit(str(e)))
    o = AnnotateOptions(scheme=scheme, allow=allow, allowed_species=species, bit_score_threshold=threshold, germline_method="identity", validate=True, min_length=min_length, wanted=("chain_type", "residues"))
    a = annotate(df, o, **resources)
    first = F.try_element_at("domains", F.lit(1))
    short = F.when(F.length("sequence") < min_length, F.lit(f"The sequence is shorter than {min_length} residues."))
    a = a.withColumn("reason", F.coalesce("error", short, F.when(F.col("domains").isNull(), F.lit("No domain was found."))))
    return a.select(*df.columns, F.when(F.col("reason").isNull(), first["residues"]).alias("numbering"), F.when(F.col("reason").isNull(), chain_class(first["chain_type"])).alias("chain_class"), "reason")


def sequences(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A DataFrame of (id, sequence) pairs; anything else is refused."""
    if not all(isinstance(r, tuple | list) and len(r) == 2 and all(isinstance(x, str) for x in r) for r in rows):
        raise TypeError("sequences must be pairs of an id and a sequence")
    return spark.createDataFrame([tuple(r) for r in rows], "seq_id string, sequence string")


def from_input(spark: SparkSession, source: str | list[tuple[str, str]]) -> DataFrame:
    """Pairs, the path of a FASTA file that is there, or one raw sequence, which is validated and named "Input sequence"."""
    from ..sources.fasta import read_fasta, there

    if not isinstance(source, str):
        return sequences(spark, source)
    if there(spark, source):
        return read_fasta(spark, source)
    bad = sorted(set(source.upper()) - set(RESIDUES))
    if bad or len(source) >= 10_000:
        raise ValueError("Sequence too long." if len(source) >= 10_000 else "Unknown amino acid letter found in sequence: " + ", ".join(bad))
    return sequences(spark, [("Input sequence", source)])


def write(annotated: DataFrame, path: str, kind: str = "parquet") -> None:
    """Domains as Parquet, or one CSV row per residue."""
    rows = domain_rows(annotated)
    (residue_rows(rows).write.option("header", True).csv if kind == "csv" else rows.write.parquet)(path)
