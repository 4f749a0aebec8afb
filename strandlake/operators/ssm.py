"""Engine B: dual-anchor site extraction from long reads, counted over attempts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandlake.functions.seq import STOPS, is_valid_record, mean_phred
from strandlake.operators.banded import best_windows
from strandlake.tables import spread
from strandlake.workers import on_workers

STOP_CODONS = frozenset(c.encode() for c in STOPS)
SITE_BUCKETS = ("discard_roi_indel", "discard_low_q_roi", "discard_frameshift", "discard_stop_codon", "passed_qc")


@dataclass(frozen=True)
class Site:
    name: str
    fw_anchor: str
    rv_anchor: str
    roi_len: int
    wt_dna: str


@dataclass(frozen=True)
class SsmSettings:
    min_read_q: float = 10.0
    min_roi_q: float = 15.0
    max_subs: int = 2
    max_indels: int = 1
    max_barcode_error: int = 2
    min_margin: int = 1
    window: int = 100
    filter_stop: bool = True


def resolve_wild_types(reference: str, sites: list[tuple[str, str, str, int]]) -> list[Site]:
    """Sites (name, anchors, length) with the reference's bases between the first exact anchors in order."""
    clean = "".join(c for c in reference.upper() if c in "ACGTN")
    out = []
    for name, fw, rv, length in sites:
        begin = clean.find(fw)
        end = clean.find(rv, begin + len(fw)) if begin >= 0 else -1
        if end < 0:
            raise ValueError(f"{name}: the anchors aren't in the reference in this order")
        out.append(Site(name, fw, rv, length, clean[begin + len(fw) : end]))
    return out


def banded_match(df: DataFrame, needle: str, hay: str, out: str, subs: int, indels: int) -> DataFrame:
    """Adds out = (score, start, end) of the best occurrence of the column needle in the column hay, else NULL.

    Every start and every length within indels of the needle's counts; the budget is subs + indels edits;
    the lowest score wins, then the earliest start, then the shortest. Rows stay where they are: a batch of reads
    is matched at once for each of its needles.
    """
    names = [c for c in df.columns if c != out]
    schema = StructType([*(df.schema[c] for c in names), StructField(out, StructType([StructField(c, IntegerType()) for c in ("score", "start", "end")]))])
    return df.select(*names).mapInArrow(on_workers(match_rows, needle, hay, out, subs, indels), schema)


def match_rows(batches, needle: str, hay: str, out: str, subs: int, indels: int):
    import pyarrow as pa

    for batch in batches:
        needles, hays = (batch.column(c).cast(pa.binary()).to_pylist() for c in (needle, hay))
        hits = np.full((3, len(hays)), -1, np.int64)
        by: dict[bytes, list[int]] = {}
        for k, (n, h) in enumerate(zip(needles, hays, strict=True)):
            if n and h is not None:
                by.setdefault(n, []).append(k)
        for n, rows in by.items():
            hits[:, rows] = best_windows(n, [hays[k] for k in rows], subs, indels)
        none = pa.array(hits[0] < 0)
        found = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in hits], ["score", "start", "end"], mask=none)
        yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])


def usable_reads(reads: DataFrame, settings: SsmSettings = SsmSettings()) -> DataFrame:
    """source_id, ordinal, seq (upper case), qual of the valid reads of enough quality."""
    valid = is_valid_record(F.col("header"), F.col("seq"), F.col("sep"), F.col("qual"))
    good = reads.filter(valid & (F.lit(settings.min_read_q <= 0) | (mean_phred(F.col("qual")) >= settings.min_read_q)))
    return good.select("source_id", "ordinal", F.upper("seq").alias("seq"), "qual")


def match_rounds(heads: list[bytes], barcodes, settings: SsmSettings) -> np.ndarray:
    """The round whose barcode matches each read's head best, -1 if none does or the margin is short."""
    none = 1 << 20
    scores = np.full((max(2, len(barcodes)), len(heads)), none, np.int64)
    for r, barcode in enumerate(barcodes):
        if barcode:
            found = best_windows(barcode.encode(), heads, settings.max_subs, settings.max_indels)[0]
            scores[r] = np.where(found < 0, none, found)
    order = np.sort(scores, axis=0)
    clear = (order[0] <= settings.max_barcode_error) & (order[1] - order[0] >= settings.min_margin)
    return np.where(clear, scores.argmin(axis=0), -1)


def call_sites(seqs: list[bytes], quals: list[bytes], sites, settings: SsmSettings):
    """For each site the buckets of the reads (None: not found) and the bases between the anchors."""
    out = []
    for s in sites:
        buckets, bases = [None] * len(seqs), [None] * len(seqs)
        head = best_windows(s.fw_anchor.encode(), seqs, settings.max_subs, settings.max_indels)
        some = np.flatnonzero(head[0] >= 0)
        tails = [seqs[k][head[2, k] :] for k in some]
        for k, tail, n in zip(some, tails, best_windows(s.rv_anchor.encode(), tails, settings.max_subs, settings.max_indels)[1], strict=True):
            if n >= 0:
                roi, qual = tail[:n], quals[k][head[2, k] : head[2, k] + n]
                buckets[k], bases[k] = judge(roi, qual, s.roi_len, settings), roi.decode()
        out.append((buckets, bases))
    return out


def judge(roi: bytes, qual: bytes, roi_len: int, settings: SsmSettings) -> str:
    if len(roi) != roi_len:
        return "discard_roi_indel"
    if settings.min_roi_q > 0 and (len(qual) != len(roi) or (sum(qual) / len(qual) - 33 if qual else 0.0) < settings.min_roi_q):
        return "discard_low_q_roi"
    if len(roi) % 3:
        return "discard_frameshift"
    if settings.filter_stop and any(roi[i : i + 3] in STOP_CODONS for i in range(0, len(roi), 3)):
        return "discard_stop_codon"
    return "passed_qc"


def attempt_batches(batches, sites, settings: SsmSettings, barcodes, bindings):
    """source_id, ordinal, seq, qual -> a row per attempt and site."""
    import pyarrow as pa

    flip = bytes.maketrans(b"ATCG", b"TAGC")
    names = ["source_id", "ordinal", "strand", "round_idx", "site", "site_ord", "bucket", "dna"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def called(which, strand, sources, seqs, quals):
        """The rows of one orientation of the reads, and which of them gave a site."""
        if bindings is None:
            rounds = match_rounds([s[: settings.window] for s in seqs], barcodes, settings)
        else:
            rounds = np.array([bindings.get(s, -1) for s in sources], np.int64)
        done = np.zeros(len(which), bool)
        for order, (site, (buckets, bases)) in enumerate(zip(sites, call_sites(seqs, quals, sites, settings), strict=True)):
            passed = np.array([b == "passed_qc" for b in buckets], bool)
            done |= passed & (rounds >= 0)
            n = len(which)
            columns = [sources, which, [strand] * n, pa.array(rounds.astype(np.int32), mask=rounds < 0), [site.name] * n, [order] * n, buckets, [d if ok else None for d, ok in zip(bases, passed, strict=True)]]
            yield done, pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        sources, ordinals = (batch.column(c).to_pylist() for c in ("source_id", "ordinal"))
        seqs, quals = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("seq", "qual"))
        done = np.zeros(len(seqs), bool)
        for done, rows in called(ordinals, 1, sources, seqs, quals):
            yield rows
        again = np.flatnonzero(~done).tolist()
        if again:
            pick = lambda values: [values[k] for k in again]
            for _, rows in called(pick(ordinals), -1, pick(sources), [s.translate(flip)[::-1] for s in pick(seqs)], [q[::-1] for q in pick(quals)]):
                yield rows


def run_attempts(reads: DataFrame, sites, settings: SsmSettings = SsmSettings(), barcodes=None, bindings: dict[int, int] | None = None) -> DataFrame:
    """A row per attempt and site: source_id, ordinal, strand, round_idx, site, site_ord, bucket (NULL: not found), dna if
    it passed. The reverse complement is an attempt only where the forward read gave no site; both attempts count
    in the funnel, as the counters run on attempts, not on reads.

    The round is that of the best barcode, or bound to the source by bindings. No row is shuffled, unless the reads
    lie in fewer partitions than there are cores."""
    schema = "source_id int, ordinal long, strand int, round_idx int, site string, site_ord int, bucket string, dna string"
    return spread(usable_reads(reads, settings)).mapInArrow(on_workers(attempt_batches, sites, settings, barcodes, bindings), schema)


def site_funnel(calls: DataFrame, rounds, sites) -> DataFrame:
    """round, site: anchor_found, the buckets and the wild-type count, over attempts with a round."""
    wt: Column = F.lit(False)
    for s in sites:
        wt = wt | ((F.col("site") == s.name) & (F.col("dna") == s.wt_dna))
    name = F.element_at(F.array(*[F.lit(r) for r in rounds]), F.col("round_idx") + 1)
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in SITE_BUCKETS]
    placed = calls.filter("round_idx is not null").withColumn("round", name)
    return placed.groupBy("round", "site").agg(F.count("bucket").alias("anchor_found"), *counts, F.count_if(wt).alias("wt_count"))


def attempt_funnel(reads: DataFrame, calls: DataFrame, settings: SsmSettings = SsmSettings()) -> DataFrame:
    """One row: malformed and low-quality reads, attempts without a round and attempts without a site."""
    valid = is_valid_record(F.col("header"), F.col("seq"), F.col("sep"), F.col("qual"))
    base = reads.agg(
        F.count_if(~valid).alias("malformed_fastq"),
        F.count_if(valid & (F.lit(settings.min_read_q > 0)) & (mean_phred(F.col("qual")) < settings.min_read_q)).alias("low_quality_read"),
    )
    per = calls.groupBy("source_id", "ordinal", "strand").agg(F.first("round_idx").alias("r"), F.count_if(F.col("bucket") == "passed_qc").alias("n"))
    rest = per.agg(F.count_if(F.col("r").isNull()).alias("barcode_mismatch"), F.count_if(F.col("r").isNotNull() & (F.col("n") == 0)).alias("no_site_extracted"))
    return base.crossJoin(rest)


def site_counts(calls: DataFrame, rounds) -> DataFrame:
    """round, site, dna, n."""
    name = F.element_at(F.array(*[F.lit(r) for r in rounds]), F.col("round_idx") + 1)
    return calls.filter("bucket = 'passed_qc' and round_idx is not null").withColumn("round", name).groupBy("round", "site", "dna").agg(F.count(F.lit(1)).alias("n"))


def haplotypes(calls: DataFrame, rounds, sites) -> DataFrame:
    """round, dna (the sites' joined by _), n: attempts on which every site passed."""
    name = F.element_at(F.array(*[F.lit(r) for r in rounds]), F.col("round_idx") + 1)
    per = calls.filter("bucket = 'passed_qc' and round_idx is not null").groupBy("source_id", "ordinal", "strand", "round_idx")
    joined = per.agg(F.array_sort(F.collect_list(F.struct("site_ord", "dna"))).alias("s")).filter(F.size("s") == len(sites))
    return joined.select(name.alias("round"), F.array_join(F.transform("s", lambda x: x["dna"]), "_").alias("dna")).groupBy("round", "dna").agg(F.count(F.lit(1)).alias("n"))
