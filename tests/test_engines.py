import json
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandlake.functions import seq as Q
from strandlake.functions import stats as S
from strandlake.operators import demux as A
from strandlake.operators import targeted as T
from strandlake.plans import oracles, runs
from strandlake.plans.queries import QUERIES
from strandlake.sources import config, derive, sinks

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["demux_assign", "demux_per_round", "funnel_strict", "master_matrix", "ssm_attempt_funnel", "haplotype_fitness", "eligibility_gate", "readid_dedup", "volcano_points", "yates_chi2", "banded_match", "targeted_align", "targeted_calls", "targeted_matrix", "targeted_combinations", "alignment_events", "pairwise_tests", "fisher_exact", "count_sample"])
def test_query_agrees_with_its_sql(spark, name):
    got = QUERIES[name](spark, SF)
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = duckdb.sql(oracles.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    left = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert left == Counter(tuple(plain(r[k]) for k in place) for r in want.fetchall())


def test_registry_is_whole():
    assert set(oracles.ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_sequences(spark):
    lit = F.lit
    assert one(spark, Q.reverse_complement(lit("ACGTNx"))) == "xNACGT"
    assert one(spark, Q.translate(lit("ATGTAANNNGC"))) == "M*XX" and one(spark, Q.translate(lit(""))) == ""
    assert one(spark, Q.has_no_stop(lit("ATGTA"))) and not one(spark, Q.has_no_stop(lit("ATGTAA")))
    assert one(spark, Q.mean_phred(lit("!I"))) == 20.0 and one(spark, Q.mean_phred(lit(""))) == 0.0
    assert one(spark, Q.dorado_header_q(lit("@r qs:f:12.5 x"))) == 12.5
    assert abs(one(spark, Q.dorado_mean_q(lit("5" * 60 + "?" * 20))) - 30) < 1e-9
    assert one(spark, Q.read_id(lit("@abc def"))) == "abc"
    assert one(spark, Q.mutation_label(lit("R233"), lit("W"))) == "R233W" and one(spark, Q.mutation_label(lit("loop"), lit("W"))) == "loop:W"


def test_statistics(spark):
    lit = F.lit
    assert abs(one(spark, S.two_sided_p(lit(1.959964))) - 0.05) < 1e-6
    assert one(spark, S.two_sided_p(lit(float("inf")))) == 0.0 and one(spark, S.neg_log10_p(lit(0.0))) == 300.0
    assert one(spark, S.var_log2_rpm_ratio(lit(0.0), lit(0.0), lit(0.0), lit(0.0))) == float("inf")
    assert abs(S.fisher_right(8, 2, 1, 5) - 0.024475524475524) < 1e-12 and S.fisher_right(0, 0, 3, 4) == 1.0
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, float("nan"), None, 0.03])], "i int, p double")
    q = {r.i: r.q for r in S.bh_fdr(rows, "p", "q").collect()}
    assert [round(q[i], 6) for i in (0, 1, 2, 5)] == [0.04, 0.04, 0.04, 0.04] and math.isnan(q[3]) and q[4] is None
    with pytest.raises(ValueError):
        S.check_pseudocount(0)


TINY = A.Round("r0", "GGGGGAAAAACCCCC", "TTTTTGGGGG", 1, 9)


@pytest.mark.parametrize(
    ("seq", "bucket"),
    [
        ("GGGGGAAAAACCCCCATGGCTAAAGG", "passed_qc"), ("GGGGNAAAAACCCCCATGGCTAAAGG", "passed_qc"), ("AAGGGAAAAACCCCCATGGCTAAAGG", "barcode_mismatch"),
        ("GGGGGAAAAACCCCCATGGC", "discard_truncated"), ("GGGGGAAAAACCCCCATGTAAAAAGG", "discard_stop_codon"), ("ACACACACACACACACACACAC", "no_anchor"), ("GGGGGAAAAAXCCCC", "malformed_fastq"),
    ],
)
def test_buckets_on_both_strands(spark, seq, bucket):
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([(0, k, "@a", s, "+", "I" * len(s)) for k, s in enumerate((seq, back))], "source_id int, ordinal long, header string, seq string, sep string, qual string")
    assert {r.bucket for r in A.demultiplex(reads, [TINY]).collect()} == {bucket}


def test_targeted_funnel_adds_up(spark):
    aligned, targets = None, None
    reference, targets = T.resolve_targets(derive.REFERENCE, derive.TARGET_SITES)
    reads = T.first_reads(derive.amplicon_reads(spark, SF), {i: i for i in range(3)})
    aligned = T.align_targets(reads, reference, targets)
    total = T.file_funnel(aligned, ()).first()
    assert total.total_reads == total.full_qc_passed + sum(total[k] for k in T.PRIMARY)
    assert total.full_qc_passed > 0.5 * total.total_reads
    calls = T.site_calls(aligned).filter("counted and status = 'wt'").select("dna", "site").distinct().collect()
    assert {(r.site, r.dna) for r in calls} == {(t.name, t.wt_dna) for t in targets}


def test_runs_write_their_files(spark, tmp_path):
    out = runs.run_cdna(derive.short_reads(spark, SF), derive.ROUNDS, str(tmp_path))
    stats = json.loads((tmp_path / "run_stats.json").read_text())
    assert stats["schema_version"] == 2 and stats["rounds"]["Round_0"]["passed_qc"] == next(r["passed_qc"] for r in out["rounds"] if r["round"] == "Round_0")
    first = (tmp_path / "Master_Enrichment_Matrix.csv").read_text().split("\n")[:2]
    assert first[0].startswith("Peptide_Seq,Dominant_DNA_Seq,Count_Round_0") and first[1].startswith("AWK,GCTTGGAAA")


def test_cells_and_chunks():
    assert [sinks.cell(x) for x in (None, 1e7, float("nan"), float("-inf"), True, 'a"b', 3)] == ["", "10000000.0", "", "-inf", "True", '"a""b"', "3"]
    rows = [(i, i / 3) for i in range(1000)]
    assert "".join(sinks.csv_chunks(["a", "b"], rows, 100)) == "".join(sinks.csv_chunks(["a", "b"], rows))


def test_configurations(tmp_path):
    assert config.read_fasta(">x\nAC\nGT\n") == "ACGT" and config.parse_positions("AA:21, nt:61 2") == [61, 61, 4]
    again = config.unlock(config.lock_cdna([TINY], A.Settings(), 0.5))
    assert again["rounds"] == [TINY] and again["settings"] == A.Settings()
    assert config.target_label("ATGGCTAAA", 4) == "A2"
    with pytest.raises(ValueError):
        config.bind_sources([0, 0], 2, 2)
    with pytest.raises(ValueError):
        T.resolve_targets("ACGTACGTACGT", [("a", 1, 3), ("b", 2, 3)])
