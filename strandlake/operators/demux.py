"""Engine A: round assignment by primer barcodes, region extraction and the exclusive QC funnel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.seq import barcode_penalty, find, has_no_stop, is_valid_record, mean_phred, reverse_complement
from strandlake.tables import settle

ANCHOR, MAX_PENALTY, MIN_MARGIN = 10, 1.0, 1.0
DISCARDS = ("discard_truncated", "discard_length_indel", "discard_low_quality_cds", "discard_stop_codon")
UNASSIGNED = ("malformed_fastq", "low_quality", "no_anchor", "barcode_mismatch", "ambiguous")


@dataclass(frozen=True)
class Round:
    """A selection round: primers 5' to 3' and the coding region counted from the end of the forward primer."""

    name: str
    fw_primer: str
    rv_primer: str
    cds_start: int
    cds_end: int

    @property
    def anchor(self) -> str:
        return self.fw_primer[-ANCHOR:]

    @property
    def barcode(self) -> str:
        return self.fw_primer[:-ANCHOR]

    @property
    def rv_anchor(self) -> str:
        return self.rv_primer[::-1].translate(str.maketrans("ATCG", "TAGC"))[:ANCHOR]


@dataclass(frozen=True)
class Settings:
    min_read_q: float = 20.0
    min_cds_q: float = 20.0
    adaptive: bool = True
    filter_stop: bool = True


def check_rounds(rounds) -> None:
    names = [r.name for r in rounds]
    if not names or len(set(names)) < len(names):
        raise ValueError("rounds need names, each of them once")
    for r in rounds:
        if not r.fw_primer or set(r.fw_primer + r.rv_primer) - set("ACGTNacgtn"):
            raise ValueError(f"{r.name}: primers are of A, C, G, T and N")
        if r.cds_end < r.cds_start:
            raise ValueError(f"{r.name}: cds_start <= cds_end is needed")


def _hits(reads: DataFrame, rounds, bound: bool) -> DataFrame:
    """Adds fw_hits and rc_hits: (penalty, round, end of the forward primer) of each round whose anchor is in the
    read, the best first. One column per round, so no rows are multiplied."""
    sides = [(s, i, r) for s in ("fw", "rc") for i, r in enumerate(rounds)]
    placed = settle(reads, {f"__{s}{i}": find(F.lit(r.anchor), F.col(f"{s}_seq")) for s, i, r in sides})
    pads = {}
    for s, i, r in sides:
        at, n = F.col(f"__{s}{i}"), len(r.barcode)
        pads[f"__pad_{s}{i}"] = F.lpad(F.col(f"{s}_seq").substr(F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n))), n, "-") if n else F.lit("")
    padded = settle(placed, pads)
    hits: dict[str, list[Column]] = {"fw": [], "rc": []}
    for s, i, r in sides:
        here = F.col(f"__{s}{i}") >= 0
        if bound:
            here = here & (F.col("bound_round") == i)
        hit = F.struct(barcode_penalty(f"__pad_{s}{i}", r.barcode).alias("penalty"), F.lit(i).alias("round_idx"), (F.col(f"__{s}{i}") + len(r.anchor)).alias("fw_end"))
        hits[s].append(F.when(here, hit))
    found = settle(padded, {f"{s}_hits": F.sort_array(F.array_compact(F.array(*h))) for s, h in hits.items()})
    return found.drop(*[c for c in found.columns if c.startswith("__")])


def _verdict(hits: Column) -> Column:
    best, second = F.get(hits, 0), F.get(hits, 1)
    return (
        F.when(F.size(hits) == 0, "no_anchor")
        .when(best["penalty"] > MAX_PENALTY, "barcode_mismatch")
        .when(F.coalesce(second["penalty"] - best["penalty"] < MIN_MARGIN, F.lit(False)), "ambiguous")
        .otherwise("assigned")
    )


def _rank(verdict: Column) -> Column:
    return F.when(verdict == "assigned", 3).when(verdict == "ambiguous", 2).when(verdict == "barcode_mismatch", 1).otherwise(0)


def assign(reads: DataFrame, rounds, settings: Settings = Settings(), bindings: dict[int, int] | None = None) -> DataFrame:
    """Adds valid, read_q, status, strand, round_idx, fw_end and the oriented read (seq_o, qual_o).

    Forward first, the reverse complement if that isn't assigned; an unassigned read keeps the more telling of
    the two reasons. With bindings (source_id to round) a read competes for its own round only."""
    check_rounds(rounds)
    valid = is_valid_record(F.col("header"), F.col("seq"), F.col("sep"), F.col("qual"))
    out = settle(reads, {"valid": valid, "fw_seq": F.upper("seq")})
    out = settle(out, {"read_q": F.when(F.col("valid"), mean_phred(F.col("qual"))), "rc_seq": reverse_complement(F.col("fw_seq"))})
    if bindings is not None:
        table = F.create_map(*[F.lit(x) for pair in bindings.items() for x in pair])
        out = out.withColumn("bound_round", F.try_element_at(table, F.col("source_id")))
    out = settle(_hits(out, rounds, bindings is not None), {f"{s}_verdict": _verdict(F.col(f"{s}_hits")) for s in ("fw", "rc")})
    forward, backward = F.col("fw_verdict"), F.col("rc_verdict")
    reason = F.when(_rank(backward) > _rank(forward), backward).otherwise(forward)
    status = F.when(~F.col("valid"), "malformed_fastq").when(F.col("read_q") < settings.min_read_q, "low_quality").otherwise(reason)
    out = settle(out, {"status": status})
    out = settle(out, {"strand": F.when(F.col("status") == "assigned", F.when(forward == "assigned", 1).otherwise(-1))})
    turned = F.col("strand") == -1
    best = lambda c: F.when(F.col("strand") == 1, F.get("fw_hits", F.lit(0))[c]).when(turned, F.get("rc_hits", F.lit(0))[c])
    out = settle(
        out,
        {c: best(c) for c in ("round_idx", "fw_end", "penalty")}
        | {"seq_o": F.when(turned, F.col("rc_seq")).otherwise(F.col("fw_seq")), "qual_o": F.when(turned, F.reverse("qual")).otherwise(F.col("qual"))},
    )
    return out.drop("fw_hits", "rc_hits", "fw_seq", "rc_seq")


def extract(assigned: DataFrame, rounds, settings: Settings = Settings()) -> DataFrame:
    """Adds round, cds, cds_q and bucket: the status of an unassigned read, a discard, or passed_qc; dna if passed."""

    def pick(values):
        out = F.when(F.col("round_idx") == 0, F.lit(values[0]))
        for i, v in enumerate(values[1:], 1):
            out = out.when(F.col("round_idx") == i, F.lit(v))
        return out

    begin = F.col("fw_end") + pick([r.cds_start - 1 for r in rounds])
    end = F.col("fw_end") + pick([r.cds_end for r in rounds])
    out = settle(assigned, {"round": pick([r.name for r in rounds]), "__begin": begin, "__end": end, "__rv": find(pick([r.rv_anchor for r in rounds]), F.col("seq_o"), F.col("fw_end"))})
    n = F.col("__end") - F.col("__begin")
    inside = (F.col("__begin") >= 0) & (F.col("__end") <= F.length("seq_o"))
    part = lambda c: F.when(inside, F.col(c).substr(F.col("__begin") + 1, n))
    out = settle(out, {"cds": part("seq_o"), "cds_q": mean_phred(part("qual_o"))})
    bucket = F.when(F.col("status") != "assigned", F.col("status")).when(~inside, "discard_truncated")
    if not settings.adaptive:
        bucket = bucket.when((F.col("__rv") >= 0) & (F.col("__end") > F.col("__rv")), "discard_length_indel")
    bucket = bucket.when(n % 3 != 0, "discard_length_indel").when((n > 0) & (F.col("cds_q") < settings.min_cds_q), "discard_low_quality_cds")
    if settings.filter_stop:
        bucket = bucket.when(~has_no_stop(F.col("cds")), "discard_stop_codon")
    out = settle(out, {"bucket": bucket.otherwise("passed_qc")})
    return out.withColumn("dna", F.when(F.col("bucket") == "passed_qc", F.col("cds"))).drop("__begin", "__end", "__rv")


def demultiplex(reads: DataFrame, rounds, settings: Settings = Settings(), bindings: dict[int, int] | None = None) -> DataFrame:
    return extract(assign(reads, rounds, settings, bindings), rounds, settings)


def variant_counts(extracted: DataFrame) -> DataFrame:
    """round, dna, n."""
    return extracted.filter("bucket = 'passed_qc'").groupBy("round", "dna").agg(F.count(F.lit(1)).alias("n"))


def round_funnel(extracted: DataFrame) -> DataFrame:
    """One row per round: assigned reads, each discard, and those that passed; the buckets add up."""
    kinds = {k: F.count_if(F.col("bucket") == k).alias(k) for k in (*DISCARDS, "passed_qc")}
    return extracted.filter("status = 'assigned'").groupBy("round").agg(F.count(F.lit(1)).alias("total_assigned"), *kinds.values())


def global_funnel(extracted: DataFrame) -> DataFrame:
    """One row: reads, and the unassigned by reason."""
    kinds = [F.count_if(F.col("status") == k).alias(k) for k in UNASSIGNED]
    return extracted.agg(F.count(F.lit(1)).alias("total_reads"), *kinds, F.count_if(F.col("status") != "assigned").alias("global_unassigned"))
