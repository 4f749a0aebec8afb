"""Whole runs of the engines, from reads to files."""

from __future__ import annotations

import os
import shutil
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import demux as A
from strandlake.operators import enrich as E
from strandlake.operators import ssm as B
from strandlake.operators import targeted as C
from strandlake.sources import sinks
from strandlake.tables import stage


class ZeroCoverage(ValueError):
    """A denominator of the run is zero, so its scores would mean nothing."""

    def __init__(self, missing: list[str]):
        super().__init__(f"run rejected, nothing was counted for {', '.join(missing)}")
        self.missing = missing


def require_coverage(counts: DataFrame, rounds, sites: list[str] | None = None, linked: DataFrame | None = None) -> None:
    """Raises unless every round, at every site and in the linked combinations if given, has a counted read."""
    keys = ["round"] if sites is None else ["round", "site"]
    seen = {tuple(r) for r in counts.filter("n > 0").select(*keys).distinct().collect()}
    missing = [r if sites is None else f"{r} / {s}" for r in rounds for s in (sites or [None]) if ((r,) if sites is None else (r, s)) not in seen]
    if linked is not None:
        both = {r["round"] for r in linked.filter("n > 0").select("round").distinct().collect()}
        missing += [f"{r} / linked combinations" for r in rounds if r not in both]
    if missing:
        raise ZeroCoverage(missing)


def fdr_summary(matrix: DataFrame, prefix: str, keys: list[str] | None = None, last: bool = False) -> list[dict]:
    """Hits below 0.05 and 0.01 for each comparison of a written matrix, within keys; of the last round only if last."""
    columns = [c for c in matrix.columns if c.startswith(prefix)]
    hits = E.fdr_hits(matrix, columns[-1:] if last else columns, keys) if columns else None
    return [r.asDict() for r in hits.orderBy(*(keys or []), "comparison").collect()] if columns else []


def run_cdna(reads: DataFrame, rounds, folder: str, settings: A.Settings = A.Settings(), bindings=None, pseudocount: float = 0.5, strict: bool = False) -> dict:
    """Engine A: master matrix (also as combination matrix), run statistics, QC report and methods in folder.

    Without a counted read no matrix. A round without one is a warning, or an error if strict, and nothing is written."""
    os.makedirs(folder, exist_ok=True)
    extracted = stage(A.demultiplex(reads, rounds, settings, bindings).select("status", "round", "bucket", "dna"), "cdna-reads")
    names = [r.name for r in rounds]
    counts, funnel, loose = stage(A.variant_counts(extracted), "cdna-counts"), A.round_funnel(extracted), A.global_funnel(extracted).first()
    if strict:
        require_coverage(counts, names)
    denominators = counts.groupBy("round").agg(F.sum("n").alias("passed"))
    medians: dict[str, float] = {}
    hits: list[dict] = []
    if not counts.isEmpty():
        if len(rounds) > 1:
            row = E.analyse(counts, denominators, names, p=pseudocount).agg(*[F.first(f"median{i}").alias(n) for i, n in enumerate(names) if i]).first()
            medians = {f"Enrich_Global_{n}_vs_{names[0]}": row[n] for n in names[1:]}
        matrix = stage(E.master_matrix(counts, denominators, names, pseudocount), "cdna-matrix")
        last = f"Centered_Enrich_{names[-1]}_vs_{names[0]}" if len(names) > 1 else f"RPM_{names[0]}"
        sinks.write_csv(matrix.orderBy(F.col(f"`{last}`").desc(), "Peptide_Seq"), f"{folder}/Master_Enrichment_Matrix.csv")
        shutil.copyfile(f"{folder}/Master_Enrichment_Matrix.csv", f"{folder}/Combination_Enrichment_Matrix.csv")
        hits = fdr_summary(matrix, "FDR_q_")
    rows = [r.asDict() for r in funnel.orderBy("round").collect()]
    empty = [f"no read of {n} was counted" for n in names if not any(r["round"] == n and r["passed_qc"] for r in rows)]
    texts = {
        "run_stats.json": sinks.run_stats(funnel, names, loose, pseudocount, medians),
        "qc_report.txt": sinks.qc_report("Quality control", rows, {k: loose[k] for k in A.UNASSIGNED}, empty + sinks.median_warnings(medians)),
        "methods.txt": sinks.methods_text("cdna", pseudocount=pseudocount, min_read_q=settings.min_read_q, min_cds_q=settings.min_cds_q),
    }
    return _write(folder, texts) | {"medians": medians, "rounds": rows, "fdr": hits}


def run_ssm(reads: DataFrame, rounds: list[str], sites, folder: str, settings: B.SsmSettings = B.SsmSettings(), barcodes=None, bindings=None, pseudocount: float = 0.5, min_baseline: int | None = None, strict: bool = False, require_linked: bool = False) -> dict:
    """Engine B: per-site and haplotype matrices and the attempts' funnel. With strict, a round without a counted read at
    a site (and with require_linked, on all sites at once) is an error, and no matrix is written."""
    os.makedirs(folder, exist_ok=True)
    calls = stage(B.run_attempts(reads, sites, settings, barcodes, bindings), "ssm-calls")
    counts = stage(B.site_counts(calls, rounds), "ssm-counts")
    names = [s.name for s in sites]
    linked = stage(B.haplotypes(calls, rounds, sites), "ssm-haplotypes") if len(sites) > 1 else None
    if strict:
        require_coverage(counts, rounds, names, linked if require_linked else None)
    wt = reduce(lambda a, b: a | b, [(F.col("site") == s.name) & (F.col("dna") == s.wt_dna) for s in sites])
    wild = counts.groupBy("round", "site").agg(F.sum(F.when(wt, F.col("n")).otherwise(0)).alias("wt"))
    passed = counts.groupBy("round", "site").agg(F.sum("n").alias("passed"))
    score = f"Centered_Fitness_{rounds[-1]}"
    matrix = stage(E.site_matrix(counts, passed, wild, rounds, pseudocount, min_baseline), "ssm-matrix")
    sinks.write_csv(E.in_order(matrix, rounds, score, "Variant_AA", "Site", names), f"{folder}/Per_Site_Matrix.csv")
    if linked is not None:
        whole = "_".join(s.wt_dna for s in sites)
        both = linked.groupBy("round").agg(F.sum(F.when(F.col("dna") == whole, F.col("n")).otherwise(0)).alias("wt"))
        sinks.write_csv(E.in_order(E.haplotype_matrix(linked, both, rounds, pseudocount), rounds, score, "Haplotype_AA"), f"{folder}/Haplotype_Matrix.csv")
    rows = [r.asDict() for r in B.site_funnel(calls, rounds, sites).orderBy("round", "site").collect()]
    loose = B.attempt_funnel(reads, calls, settings).first().asDict()
    texts = {"funnel.csv": sinks.quoted_csv(["round", "site", "anchor_found", *B.SITE_BUCKETS, "wt_count"], rows), "qc_report.txt": sinks.qc_report("Quality control", rows, loose), "methods.txt": sinks.methods_text("ssm", pseudocount=pseudocount)}
    return _write(folder, texts) | {"sites": rows, "unassigned": loose, "fdr": fdr_summary(matrix, "FDR_q_", ["Site"], last=True)}


def run_targeted(reads: DataFrame, reference: str, targets, rounds: list[str], bindings: dict[int, int], folder: str, settings: C.TargetedSettings = C.TargetedSettings(), min_baseline: int = 10, pseudocount: float = 0.5, strict: bool = False, require_linked: bool = False) -> dict:
    """Engine C: per-target and combination matrices, exact tables, funnels and run statistics. With strict, a round
    without a counted read at a target (and with require_linked, on all targets at once) is an error, and no matrix
    is written."""
    os.makedirs(folder, exist_ok=True)
    aligned = C.align_targets(C.first_reads(reads, bindings), reference, targets, settings)
    calls = C.site_calls(aligned)
    counts, linked = stage(C.target_counts(calls, rounds), "target-counts"), stage(C.combination_counts(aligned, rounds), "target-combinations")
    passed = counts.groupBy("round", "site").agg(F.sum("n").alias("passed"))
    together = linked.groupBy("round").agg(F.sum("n").alias("passed"))
    names = [t.name for t in targets]
    if strict:
        require_coverage(counts, rounds, names, linked if require_linked and len(names) > 1 else None)
    score = f"Centered_Enrichment_{rounds[-1]}_vs_{rounds[0]}"
    matrix = stage(E.target_matrix(counts, passed, rounds, min_baseline, pseudocount), "target-matrix")
    sinks.write_csv(E.in_order(matrix, rounds, score, "Variant_AA", "Target", names), f"{folder}/Per_Target_Matrix.csv")
    sinks.write_csv(E.in_order(E.combination_matrix(linked, rounds, min_baseline, pseudocount), rounds, score, "Combination_AA"), f"{folder}/Combination_Matrix.csv")
    codons = E.in_order(E.exact_table(counts, passed, rounds, ["site"]), rounds, "", "dna", "site", names)
    exact = E.exact_table(linked, together, rounds, []).orderBy("dna")
    sinks.write_csv(codons, f"{folder}/Exact_Codons.csv")
    sinks.write_csv(exact, f"{folder}/Exact_Combinations.csv")
    funnel, states = C.file_funnel(aligned), C.site_funnel(calls, targets)
    rows = [r.asDict() for r in funnel.orderBy("source_id").collect()]
    texts = {
        "run_stats.json": sinks.targeted_run_stats(settings, funnel, states, codons, exact), "file_funnel.csv": sinks.quoted_csv(funnel.columns, rows),
        "qc_report.txt": sinks.qc_report("Quality control", rows), "methods.txt": sinks.methods_text("targeted", pseudocount=pseudocount, rescue_flank=settings.rescue_flank, min_baseline=min_baseline),
    }
    states_rows = [r.asDict() for r in states.collect()]
    texts["callability.csv"] = sinks.callability(states_rows, rounds, names)
    return _write(folder, texts) | {"files": rows, "fdr": fdr_summary(matrix.filter("Score_Eligible"), "FDR_q_", ["Target"])}


def _write(folder: str, texts: dict[str, str]) -> dict:
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return {"folder": folder}
