"""Files of whole runs: the order of their rows, rejection without coverage, summaries."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from strandlake.operators import targeted as T
from strandlake.plans import runs
from strandlake.sources import derive

SF = "/root/testdata/sf0.001"
NAMES = [r.name for r in derive.ROUNDS]


def read(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def in_order(rows, site, sites, score, tie):
    keys = [(sites.index(r[site]) if site else 0, -float(r[score] or 0), r[tie]) for r in rows]
    return len(keys) > 3 and keys == sorted(keys)


def test_engine_b(spark, tmp_path):
    reads, sites = derive.site_reads(spark, SF), list(reversed(derive.SITES))
    out = runs.run_ssm(reads, NAMES, sites, str(tmp_path), barcodes=derive.SSM_BARCODES, strict=True, require_linked=True)
    assert in_order(read(tmp_path / "Per_Site_Matrix.csv"), "Site", [s.name for s in sites], "Centered_Fitness_Round_2", "Variant_AA")
    assert in_order(read(tmp_path / "Haplotype_Matrix.csv"), None, [], "Centered_Fitness_Round_2", "Haplotype_AA")
    assert {(r["Site"], r["comparison"]) for r in out["fdr"]} == {(s.name, "FDR_q_Round_2") for s in sites}
    with pytest.raises(runs.ZeroCoverage) as e:
        runs.run_ssm(reads.filter("source_id <> 1"), NAMES, sites, str(tmp_path / "none"), barcodes=derive.SSM_BARCODES, strict=True, require_linked=True)
    assert e.value.missing == ["Round_1 / S2", "Round_1 / S1", "Round_1 / linked combinations"]
    assert not os.path.exists(tmp_path / "none" / "Per_Site_Matrix.csv")


def test_engine_c(spark, tmp_path):
    reference, targets = T.resolve_targets(derive.REFERENCE, derive.TARGET_SITES)
    reads, bindings = derive.amplicon_reads(spark, SF), {i: i for i in range(3)}
    out = runs.run_targeted(reads, reference, targets, NAMES, bindings, str(tmp_path), strict=True, require_linked=True)
    names = [t.name for t in targets]
    score = "Centered_Enrichment_Round_2_vs_Round_0"
    assert in_order(read(tmp_path / "Per_Target_Matrix.csv"), "Target", names, score, "Variant_AA")
    assert in_order(read(tmp_path / "Combination_Matrix.csv"), None, [], score, "Combination_AA")
    codons = [(names.index(r["site"]), r["dna"]) for r in read(tmp_path / "Exact_Codons.csv")]
    assert codons == sorted(codons) and len(codons) > 20
    states = read(tmp_path / "callability.csv")
    assert [(r["round"], r["target"]) for r in states] == [(n, t) for n in NAMES for t in names] and all(0 < float(r["callability"]) <= 1 for r in states)
    assert {r["Target"] for r in out["fdr"]} == set(names)


def test_engine_a(spark, tmp_path):
    reads = derive.short_reads(spark, SF)
    out = runs.run_cdna(reads, derive.ROUNDS, str(tmp_path), strict=True)
    assert in_order(read(tmp_path / "Master_Enrichment_Matrix.csv"), None, [], "Centered_Enrich_Round_2_vs_Round_0", "Peptide_Seq")
    assert (tmp_path / "Combination_Enrichment_Matrix.csv").read_bytes() == (tmp_path / "Master_Enrichment_Matrix.csv").read_bytes()
    assert [r["comparison"] for r in out["fdr"]] == ["FDR_q_Round_1_vs_Round_0", "FDR_q_Round_2_vs_Round_0"]
    only = reads.filter(F.col("ordinal") % 3 == 0)
    with pytest.raises(runs.ZeroCoverage) as e:
        runs.run_cdna(only, derive.ROUNDS, str(tmp_path / "none"), strict=True)
    assert e.value.missing == ["Round_1", "Round_2"]
