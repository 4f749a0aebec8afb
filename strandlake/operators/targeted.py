"""Engine C: full-amplicon reads aligned to a reference, target sites called, linked and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandlake.functions.seq import AMINO_ACIDS, CODONS, dorado_read_q, is_valid_record, read_id
from strandlake.tables import stage
from strandlake.workers import on_workers

FAILURES = ("low_read_q", "partial_reference", "low_alignment_identity", "low_protected_identity", "protected_indel")
PRIMARY = ("malformed_fastq", "duplicate_read_id", "low_read_q", "concatemer_or_chimera", "alignment_failed", *FAILURES[1:])
STATUSES = ("not_covered", "target_insertion", "target_deletion", "ambiguous", "low_quality", "wt", "stop_codon", "variant")
_TABLE = dict(zip(CODONS, AMINO_ACIDS, strict=True))


@dataclass(frozen=True)
class Target:
    """A site of the reference, half-open and 0-based."""

    name: str
    start: int
    end: int
    wt_dna: str

    @property
    def wt_aa(self) -> str | None:
        return to_protein(self.wt_dna) if len(self.wt_dna) % 3 == 0 else None


@dataclass(frozen=True)
class TargetedSettings:
    min_read_q: float = 10.0
    min_base_q: float = 15.0
    min_coverage: float = 0.90
    min_identity: float = 0.85
    min_protected_identity: float = 0.95
    max_protected_indels: int = 30
    rescue_flank: int = 30
    concatemer: float = 1.5


def to_protein(dna: str) -> str:
    return "".join(_TABLE.get(dna[i : i + 3], "X") for i in range(0, len(dna), 3))


def resolve_targets(reference: str, sites: list[tuple[str, int, int]]) -> tuple[str, list[Target]]:
    """The cleaned reference and the targets (name, first base counted from 1, length) in order of place."""
    clean = "".join(reference.split()).upper()
    if not clean or set(clean) - set("ACGT"):
        raise ValueError("the reference must be of A, C, G and T")
    out = []
    for name, start, length in sites:
        if not name.strip() or length < 1 or start < 1 or start - 1 + length > len(clean):
            raise ValueError(f"target {name!r} isn't on the reference")
        out.append(Target(name.strip(), start - 1, start - 1 + length, clean[start - 1 : start - 1 + length]))
    out.sort(key=lambda t: (t.start, t.name))
    if not out or len({t.name for t in out}) < len(out):
        raise ValueError("targets need names, each of them once")
    if any(a.end > b.start for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("targets overlap")
    return clean, out


def first_reads(reads: DataFrame, bindings: dict[int, int]) -> DataFrame:
    """Adds round_idx, valid, read_id and duplicate: whether an earlier valid record of the round has the id.

    Earlier is by (source_id, ordinal). The first place of an id is a minimum that combines on the map side, so
    an id that many records share never gathers them."""
    rounds = F.create_map(*[F.lit(x) for pair in bindings.items() for x in pair])
    out = reads.withColumns(
        {"round_idx": F.try_element_at(rounds, F.col("source_id")), "valid": is_valid_record(F.col("header"), F.col("seq"), F.col("sep"), F.col("qual")), "read_id": read_id(F.col("header"))}
    )
    firsts = out.filter("valid").groupBy("round_idx", "read_id").agg(F.min(F.struct("source_id", "ordinal")).alias("__first"))
    joined = out.join(firsts, ["round_idx", "read_id"], "left")
    return joined.withColumn("duplicate", F.col("valid") & (F.struct("source_id", "ordinal") != F.col("__first"))).drop("__first")


def classify(reads: DataFrame, reference_length: int, settings: TargetedSettings) -> DataFrame:
    """Adds read_q and drop: why a read isn't aligned, NULL if it is."""
    from math import ceil

    out = reads.withColumn("read_q", F.when(F.col("valid"), dorado_read_q(F.col("header"), F.col("qual"))["effective"]))
    reason = (
        F.when(~F.col("valid"), "malformed_fastq")
        .when(F.col("duplicate"), "duplicate_read_id")
        .when(F.col("read_q") < settings.min_read_q, "low_read_q")
        .when(F.length("seq") >= ceil(reference_length * settings.concatemer), "concatemer_or_chimera")
    )
    return out.withColumn("drop", reason)


_CALL = "struct<site:string,site_ord:int,status:string,dna:string,aa:string,min_q:double,mean_q:double,callable:boolean,rescued:boolean>"
ALIGNED = (
    "source_id int, ordinal long, round_idx int, aligned boolean, strand int, score long, read_start int, read_end int, identity double, coverage double, "
    "protected_identity double, cigar string, band int, qc_passed boolean, failures array<string>, "
    f"calls array<{_CALL}>, haplotype string, events array<struct<type:string,ref_pos:int,read_pos:int,ref:string,alt:string>>"
)


def quality_control(path, mask, read_q: float, identity: float, coverage: float, settings: TargetedSettings):
    """The failed checks in order, and the identity over the protected bases. An inserted base counts as protected
    if both of its neighbours on the reference are."""
    import numpy as np

    from strandlake.operators.align import D, I, M, X

    on_ref = path != I
    at = np.cumsum(on_ref) - on_ref
    edge = np.concatenate([[True], mask, [True]])
    safe = np.where(on_ref, edge[at + 1], edge[at] & edge[at + 1])
    good, wrong, lost, extra = (int((safe & (path == c)).sum()) for c in (M, X, D, I))
    total = good + wrong + lost + extra
    protected = good / total if total else 0.0
    checks = (
        read_q < settings.min_read_q, coverage < settings.min_coverage, identity < settings.min_identity,
        protected < settings.min_protected_identity, lost + extra > settings.max_protected_indels,
    )
    return [name for name, failed in zip(FAILURES, checks, strict=True) if failed], protected


def rescuable(projection, target: Target, mask, settings: TargetedSettings) -> bool:
    """Whether the protected bases around a target are good enough, although the read as a whole isn't."""
    from strandlake.operators.align import D, M, X

    lo, hi = target.start - settings.rescue_flank, target.end + settings.rescue_flank
    if lo < 0 or hi > len(mask):
        return False
    op, safe = projection.op[lo:hi], mask[lo:hi]
    good = int((safe & (op == M)).sum())
    errors = int(projection.inserted_before[lo:hi].sum() + (safe & ((op == X) | (op == D))).sum())
    covered = safe & ((op == M) | (op == X))
    flank, inner = settings.rescue_flank, target.start - lo
    enough = covered[:inner].sum() >= flank and covered[inner + target.end - target.start :].sum() >= flank
    return bool(enough and good + errors and good / (good + errors) >= settings.min_protected_identity)


def call_site(projection, target: Target, seq, qual, min_q: float) -> dict:
    """The state of one target on one read."""
    call = {"status": None, "dna": None, "aa": None, "min_q": None, "mean_q": None, "callable": False}
    if target.start < projection.first or target.end - 1 > projection.last:
        return call | {"status": "not_covered"}
    if projection.inserted_before[target.start + 1 : target.end].any():
        return call | {"status": "target_insertion"}
    at = projection.to_read[target.start : target.end]
    if (at < 0).any():
        return call | {"status": "target_deletion"}
    if (at >= min(len(seq), len(qual))).any():
        return call | {"status": "not_covered"}
    dna = bytes(seq[at]).decode()
    if set(dna) - set("ACGT"):
        return call | {"status": "ambiguous", "dna": dna}
    q = qual[at].astype(float).clip(33) - 33
    aa = to_protein(dna) if len(dna) % 3 == 0 else None
    call |= {"dna": dna, "aa": aa, "min_q": float(q.min()), "mean_q": float(q.mean()), "callable": True}
    if q.min() < min_q:
        return call | {"status": "low_quality", "callable": False}
    return call | {"status": "wt" if dna == target.wt_dna else "stop_codon" if aa and "*" in aa else "variant"}


def align_reads(batches, reference: str, targets: list[Target], settings: TargetedSettings, schema):
    """source_id, ordinal, round_idx, seq, qual, read_q -> ALIGNED. Reads are aligned in batches, on one strand or
    both: the one with more shared k-mers first, the other if that fails, fails its checks or is hardly better."""
    import numpy as np
    import pyarrow as pa

    from strandlake.operators import align as A

    ref = A.Reference(np.frombuffer(reference.encode(), np.uint8))
    mask = np.ones(len(reference), bool)
    for t in targets:
        mask[t.start : t.end] = False
    flip = bytes.maketrans(b"ACGT", b"TGCA")
    for whole in batches:
        for begin in range(0, whole.num_rows, 1024):
            rows = whole.slice(begin, 1024).to_pylist()
            strands = {1: [np.frombuffer(r["seq"].upper().encode(), np.uint8) for r in rows]}
            strands[-1] = [np.frombuffer(bytes(s).translate(flip)[::-1], np.uint8) for s in strands[1]]
            guess = {s: [ref.estimate(r) for r in reads] for s, reads in strands.items()}
            first = [-1 if guess[-1][k][1] > guess[1][k][1] else 1 for k in range(len(rows))]

            def tried(which, sides):
                """Candidates (passed, score, strand, alignment, failures, protected identity) of the reads."""
                found = A.align(ref.seq, [strands[s][k] for k, s in zip(which, sides, strict=True)], [guess[s][k] for k, s in zip(which, sides, strict=True)])
                out = {}
                for k, s, a in zip(which, sides, found, strict=True):
                    if a is not None:
                        failed, protected = quality_control(a.path, mask, rows[k]["read_q"], a.identity, a.coverage, settings)
                        out[k] = (not failed, a.score, s, a, failed, protected)
                return out

            best = tried(range(len(rows)), first)
            unsure = [k for k in range(len(rows)) if k not in best or not best[k][0] or abs(guess[1][k][1] - guess[-1][k][1]) <= 2]
            for k, other in tried(unsure, [-first[k] for k in unsure]).items():
                if k not in best or other[:3] > best[k][:3]:
                    best[k] = other
            out = []
            for k, r in enumerate(rows):
                row = {c: r[c] for c in ("source_id", "ordinal", "round_idx")}
                if k not in best:
                    out.append(row | {"aligned": False})
                    continue
                passed, score, strand, a, failed, protected = best[k]
                seq = strands[strand][k]
                qual = np.frombuffer(r["qual"].encode(), np.uint8)[::strand]
                projection = A.project(a, len(ref.seq))
                calls = []
                for n, t in enumerate(targets):
                    call = call_site(projection, t, seq, qual, settings.min_base_q)
                    calls.append(call | {"site": t.name, "site_ord": n, "rescued": not passed and rescuable(projection, t, mask, settings)})
                linked = passed and calls and all(c["callable"] for c in calls)
                out.append(
                    row
                    | {
                        "aligned": True, "strand": strand, "score": score, "read_start": a.read_start, "read_end": a.read_end, "identity": a.identity,
                        "coverage": a.coverage, "protected_identity": protected, "cigar": "".join(f"{n}{op}" for op, n in a.cigar), "band": a.band,
                        "qc_passed": passed, "failures": failed, "calls": calls, "haplotype": "|".join(c["dna"] for c in calls) if linked else None,
                        "events": [dict(zip(("type", "ref_pos", "read_pos", "ref", "alt"), e, strict=True)) for e in A.events(a, ref.seq, seq)],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)


def align_targets(reads: DataFrame, reference: str, targets: list[Target], settings: TargetedSettings = TargetedSettings(), task_bases: int = 1_000_000, most_tasks: int = 20_000) -> DataFrame:
    """ALIGNED, and drop: the one reason why a read isn't counted in full, NULL if it passed all checks.

    Reads that are dropped beforehand never reach Python; they come back with their reason. The others are dealt
    over tasks of about task_bases bases, however the search for duplicates left them, as aligning costs far more
    than moving a read."""
    schema = to_arrow_schema(StructType.fromDDL(ALIGNED))
    classified = stage(classify(reads, len(reference), settings), "targeted-reads")
    survivors = classified.filter("drop is null").select("source_id", "ordinal", "round_idx", "seq", "qual", "read_q")
    bases = survivors.agg(F.sum(F.length("seq")).alias("n")).first()["n"] or 0
    tasks = min(most_tasks, max(reads.sparkSession.sparkContext.defaultParallelism, bases // task_bases + 1))
    survivors = survivors.repartition(tasks)
    found = survivors.mapInArrow(on_workers(align_reads, reference, targets, settings, schema), ALIGNED)
    # A projection above would be evaluated with the aligner each time the result is used.
    found = stage(found.withColumn("drop", F.when(~F.col("aligned"), "alignment_failed").otherwise(F.get("failures", 0))), "targeted-aligned")
    lost = classified.filter("drop is not null").select("source_id", "ordinal", "round_idx", "drop")
    return found.unionByName(lost, allowMissingColumns=True)


def site_calls(aligned: DataFrame) -> DataFrame:
    """A row per aligned read and target; counted if the read passed or the target was rescued, and is callable."""
    rows = aligned.filter("aligned").select("source_id", "ordinal", "round_idx", "qc_passed", F.explode("calls").alias("c")).select("source_id", "ordinal", "round_idx", "qc_passed", "c.*")
    return rows.withColumn("counted", (F.col("qc_passed") | F.col("rescued")) & F.col("callable"))


def target_counts(calls: DataFrame, rounds) -> DataFrame:
    """round, site, dna, n."""
    name = F.element_at(F.array(*[F.lit(r) for r in rounds]), F.col("round_idx") + 1)
    return calls.filter("counted").withColumn("round", name).groupBy("round", "site", "dna").agg(F.count(F.lit(1)).alias("n"))


def combination_counts(aligned: DataFrame, rounds) -> DataFrame:
    """round, dna (targets joined by |), n."""
    name = F.element_at(F.array(*[F.lit(r) for r in rounds]), F.col("round_idx") + 1)
    return aligned.filter("haplotype is not null").withColumn("round", name).groupBy("round", F.col("haplotype").alias("dna")).agg(F.count(F.lit(1)).alias("n"))


def file_funnel(aligned: DataFrame, keys=("source_id",)) -> DataFrame:
    """Reads, reads that passed, and each primary reason; they add up to the reads."""
    kinds = [F.count_if(F.col("drop") == k).alias(k) for k in PRIMARY]
    return aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_reads"), F.count_if("aligned").alias("aligned"), F.count_if(F.col("drop").isNull()).alias("full_qc_passed"), *kinds)


def site_funnel(calls: DataFrame, targets: list[Target]) -> DataFrame:
    """The states of each round and target over all aligned reads, and what is counted."""
    wild = F.create_map(*[F.lit(x) for t in targets for x in (t.name, t.wt_aa or "")])
    state = F.col("status")
    indel = state.isin("target_insertion", "target_deletion")
    return calls.groupBy("round_idx", "site").agg(
        *[F.count_if(state == s).alias(s) for s in ("low_quality", "not_covered", "ambiguous", "stop_codon")],
        F.count_if(indel).alias("target_indel"), F.count_if("counted").alias("passed_qc"), F.count_if(F.expr("counted and qc_passed")).alias("callable_full"),
        F.count_if(F.expr("counted and not qc_passed")).alias("callable_rescued"), F.count_if(F.col("counted") & (F.col("aa") == F.element_at(wild, F.col("site")))).alias("wt_count"),
    )
