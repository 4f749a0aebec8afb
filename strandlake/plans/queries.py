"""The registered queries: each operator of the three engines over reads derived from the events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import seq as Q
from strandlake.functions import stats as S
from strandlake.operators import dashboard as H
from strandlake.operators import demux as A
from strandlake.operators import enrich as E
from strandlake.operators import ssm as B
from strandlake.operators import targeted as T
from strandlake.sources import derive as D
from strandlake.tables import spread, stage

NAMES = [r.name for r in D.ROUNDS]


def r6(*names: str) -> list[Column]:
    return [F.round(n if isinstance(n, Column) else F.col(n), 6).alias(n) for n in names]


def _extracted(spark, sf_dir) -> DataFrame:
    return A.demultiplex(D.short_reads(spark, sf_dir), D.ROUNDS)


def _counts(spark, sf_dir) -> DataFrame:
    """round, dna, n of engine A, written once: it is the input of every statistic."""
    return stage(A.variant_counts(_extracted(spark, sf_dir)), "counts")


def _passed(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy("round", *keys).agg(F.sum("n").alias("passed"))


def _analysed(spark, sf_dir) -> DataFrame:
    counts = _counts(spark, sf_dir)
    return E.analyse(counts, _passed(counts), NAMES)


def _calls(spark, sf_dir) -> DataFrame:
    return B.run_attempts(D.site_reads(spark, sf_dir), D.SITES, barcodes=D.SSM_BARCODES)


def _site_counts(spark, sf_dir) -> DataFrame:
    return stage(B.site_counts(_calls(spark, sf_dir), NAMES), "site-counts")


def _site_wild(counts: DataFrame) -> DataFrame:
    wt = reduce(lambda a, b: a | b, [(F.col("site") == s.name) & (F.col("dna") == s.wt_dna) for s in D.SITES])
    return counts.groupBy("round", "site").agg(F.sum(F.when(wt, F.col("n")).otherwise(0)).alias("wt"))


def _aa_counts(spark, sf_dir) -> DataFrame:
    return _counts(spark, sf_dir).groupBy("round", Q.translate(F.col("dna")).alias("aa")).agg(F.sum("n").alias("n"))


def read_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = D.short_reads(spark, sf_dir)
    return reads.select("ordinal", Q.is_valid_record(*(F.col(c) for c in ("header", "seq", "sep", "qual"))).alias("valid"))


def mean_phred_filter(spark, sf_dir):
    return D.short_reads(spark, sf_dir).select("ordinal", F.round(Q.mean_phred(F.col("qual")), 6).alias("read_q")).filter("read_q >= 20")


def revcomp(spark, sf_dir):
    return D.short_reads(spark, sf_dir).select("ordinal", Q.reverse_complement(F.upper("seq")).alias("rc"))


def gc_percent(spark, sf_dir):
    return D.short_reads(spark, sf_dir).select("ordinal", F.round(Q.gc_percent(F.upper("seq")), 6).alias("gc"))


def translate_cds(spark, sf_dir):
    return _extracted(spark, sf_dir).filter("cds is not null").select("ordinal", "cds", Q.translate(F.col("cds")).alias("aa"))


def stop_filter(spark, sf_dir):
    return _extracted(spark, sf_dir).filter("cds is not null").select("ordinal", Q.has_no_stop(F.col("cds")).alias("no_stop"))


def dorado_read_q(spark, sf_dir):
    q = Q.dorado_read_q(F.col("header"), F.col("qual"))
    return D.short_reads(spark, sf_dir).select("ordinal", q.alias("q")).select("ordinal", F.round("q.effective", 6).alias("effective"), F.round("q.recalculated", 6).alias("recalculated"), F.round("q.delta", 6).alias("delta"), "q.source")


def barcode_score(spark, sf_dir):
    return A.assign(D.short_reads(spark, sf_dir), D.ROUNDS).filter("status = 'assigned'").select("ordinal", "penalty")


def demux_assign(spark, sf_dir):
    return _extracted(spark, sf_dir).select("ordinal", "status", "strand", "round", "bucket", "dna")


def demux_per_round(spark, sf_dir):
    bindings = {i: i % 3 for i in range(6)}
    return A.demultiplex(D.short_reads(spark, sf_dir), D.ROUNDS, bindings=bindings).select("ordinal", "status", "strand", "round", "bucket", "dna")


def rc_retry_reason(spark, sf_dir):
    out = A.assign(D.short_reads(spark, sf_dir), D.ROUNDS).filter("valid and read_q >= 20")
    return out.groupBy("fw_verdict", "rc_verdict", "status").agg(F.count(F.lit(1)).alias("n"))


def funnel_by_round(spark, sf_dir):
    return A.round_funnel(_extracted(spark, sf_dir))


def funnel_global(spark, sf_dir):
    return A.global_funnel(_extracted(spark, sf_dir))


def funnel_strict(spark, sf_dir):
    strict = A.Settings(adaptive=False, min_read_q=10.0)
    return A.round_funnel(A.demultiplex(D.short_reads(spark, sf_dir), D.ROUNDS, strict))


def variant_counts(spark, sf_dir):
    return A.variant_counts(_extracted(spark, sf_dir))


def aa_collapse(spark, sf_dir):
    return _aa_counts(spark, sf_dir)


def dominant_dna(spark, sf_dir):
    return E.collapse(_counts(spark, sf_dir), NAMES, []).select("aa", "dominant")


def rpm_matrix(spark, sf_dir):
    return _analysed(spark, sf_dir).select("aa", *r6("rpm0", "rpm1", "rpm2"))


def enrich_step(spark, sf_dir):
    return _analysed(spark, sf_dir).select("aa", *r6("step1", "step2"))


def enrich_centered(spark, sf_dir):
    return _analysed(spark, sf_dir).select("aa", *r6("centred1", "centred2"))


def var_enrich(spark, sf_dir):
    return _analysed(spark, sf_dir).select("aa", *r6("var1", "var2"))


def wald_z_p(spark, sf_dir):
    return _analysed(spark, sf_dir).select("aa", *r6("z1", "p1", "z2", "p2"))


def bh_fdr(spark, sf_dir):
    return _analysed(spark, sf_dir).select("aa", *r6("q1", "q2"))


def _rounded(out: DataFrame) -> DataFrame:
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def master_matrix(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return _rounded(E.master_matrix(counts, _passed(counts), NAMES))


def library_median(spark, sf_dir):
    out = _analysed(spark, sf_dir).agg(F.first("median1").alias("m1"), F.first("median2").alias("m2"))
    return out.select(*r6("m1", "m2"))


def fdr_hit_counts(spark, sf_dir):
    return E.fdr_hits(_analysed(spark, sf_dir), ["q1", "q2"])


def banded_match(spark, sf_dir):
    reads = D.site_reads(spark, sf_dir).select("ordinal", F.upper("seq").alias("hay"), F.lit(D.SITES[0].fw_anchor).alias("needle"))
    out = B.banded_match(spread(reads), "needle", "hay", "hit", 2, 1)
    return out.select("ordinal", "hit.score", "hit.start", "hit.end")


def ssm_sites(spark, sf_dir):
    return B.site_funnel(_calls(spark, sf_dir), NAMES, D.SITES)


def ssm_attempt_funnel(spark, sf_dir):
    return B.attempt_funnel(D.site_reads(spark, sf_dir), stage(_calls(spark, sf_dir), "calls"))


def ssm_site_counts(spark, sf_dir):
    return B.site_counts(_calls(spark, sf_dir), NAMES)


def ssm_haplotypes(spark, sf_dir):
    return B.haplotypes(_calls(spark, sf_dir), NAMES, D.SITES)


def _fitness(spark, sf_dir, min_baseline=None):
    counts = _site_counts(spark, sf_dir)
    return E.analyse(counts, _passed(counts, "site"), NAMES, ["site"], wild=_site_wild(counts), min_baseline=min_baseline)


def wt_fitness(spark, sf_dir):
    return _fitness(spark, sf_dir).select("site", "aa", *r6("raw0", "raw1", "raw2", "centred2", "var2"))


def site_scoped_fdr(spark, sf_dir):
    return _fitness(spark, sf_dir).select("site", "aa", *r6("p1", "q1", "p2", "q2"))


def eligibility_gate(spark, sf_dir):
    counts = _site_counts(spark, sf_dir)
    out = E.analyse(counts, _passed(counts, "site"), NAMES, ["site"], min_baseline=10)
    return out.select("site", "aa", "eligible", *r6("centred2", "z2", "p2", "q2"))


def haplotype_fitness(spark, sf_dir):
    counts = stage(B.haplotypes(_calls(spark, sf_dir), NAMES, D.SITES), "haplotypes")
    joined = "_".join(s.wt_dna for s in D.SITES)
    wild = counts.groupBy("round").agg(F.sum(F.when(F.col("dna") == joined, F.col("n")).otherwise(0)).alias("wt"))
    out = E.analyse(counts, _passed(counts), NAMES, [], wild=wild, aa=E.haplotype_aa("_"))
    return out.select("aa", "dominant", "c0", "c1", "c2", *r6("raw2", "q2"))


def readid_dedup(spark, sf_dir):
    reads = D.short_reads(spark, sf_dir)
    return T.first_reads(reads, {i: i % 3 for i in range(6)}).select("ordinal", "round_idx", "read_id", "duplicate")


def exact_codon_table(spark, sf_dir):
    counts = _site_counts(spark, sf_dir)
    out = E.exact_table(counts, _passed(counts, "site"), NAMES, ["site"])
    return out.select("site", "dna", Q.translate(F.col("dna")).alias("aa"), *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def exact_combination_table(spark, sf_dir):
    counts = stage(B.haplotypes(_calls(spark, sf_dir), NAMES, D.SITES), "haplotypes")
    out = E.exact_table(counts, _passed(counts), NAMES, [])
    return out.select("dna", E.haplotype_aa("_").alias("aa"), *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def combination_label(spark, sf_dir):
    calls = _site_counts(spark, sf_dir).select("site", Q.translate(F.col("dna")).alias("aa")).distinct()
    name = F.when(F.col("site") == "S1", "R233").otherwise("loop")
    return calls.select("site", "aa", Q.mutation_label(name, F.col("aa")).alias("label"))


def gini(spark, sf_dir):
    return H.gini(_aa_counts(spark, sf_dir), ["round"]).select("round", *r6("gini"))


def power_law_slope(spark, sf_dir):
    return H.power_law(_aa_counts(spark, sf_dir), ["round"], "n", "aa").select("round", *r6("slope"))


def count_histogram(spark, sf_dir):
    return H.histogram(_aa_counts(spark, sf_dir), ["round"])


def histogram_fit(spark, sf_dir):
    return H.normal_fit(_aa_counts(spark, sf_dir), ["round"]).select("round", "n_values", "fitted", *r6("mean", "sd"))


def logo_information(spark, sf_dir):
    return H.sequence_logo(_aa_counts(spark, sf_dir).filter("round = 'Round_2'")).select("position", "letter", *r6("bits"))


def target_logo(spark, sf_dir):
    counts = _site_counts(spark, sf_dir).select("site", Q.translate(F.col("dna")).alias("aa"), "n")
    return H.target_logo(counts).select("site", "aa", *r6("share", "bits"))


def rank_abundance(spark, sf_dir):
    return H.rank_abundance(_aa_counts(spark, sf_dir), ["round"], "n", "aa")


def top_bottom_n(spark, sf_dir):
    out = _analysed(spark, sf_dir).select("aa", F.round("centred2", 6).alias("score"))
    return H.top_bottom(out, "score", "aa")


def volcano_points(spark, sf_dir):
    out = _analysed(spark, sf_dir).select("aa", F.round("raw2", 6).alias("score"), F.round("q2", 6).alias("q"))
    return H.volcano(out, "score", "q", "aa").select("aa", "score", "q", "rank", "significant", *r6("neg_log10_q"))


def scatter_points(spark, sf_dir):
    return H.scatter(_analysed(spark, sf_dir).select("aa", "c0", "c2"), "c0", "c2", "aa")


def pairwise_tests(spark, sf_dir):
    out = H.pairwise_tests(_analysed(spark, sf_dir), 1, 2)
    return out.select("aa", *r6("log2fc"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def volcano_recomputed(spark, sf_dir):
    out = H.pairwise_tests(_analysed(spark, sf_dir), 1, 2).select("aa", F.round("log2fc", 6).alias("score"), F.round("q", 6).alias("q"))
    return H.volcano(out, "score", "q", "aa").select("aa", "score", "q", "rank", "significant", *r6("neg_log10_q"))


def count_sample(spark, sf_dir):
    return H.count_sample(_aa_counts(spark, sf_dir), ["round"], "n", "aa")


def matrix_preview(spark, sf_dir):
    last = "Centered_Enrich_Round_2_vs_Round_0"
    return H.preview(master_matrix(spark, sf_dir), [F.col(last).desc(), "Peptide_Seq"])


def target_fdr_hits(spark, sf_dir):
    matrix = targeted_matrix(spark, sf_dir).filter("Score_Eligible")
    return E.fdr_hits(matrix, ["FDR_q_Round_1_vs_Round_0", "FDR_q_Round_2_vs_Round_0"], ["Target"])


def site_fdr_hits(spark, sf_dir):
    return E.fdr_hits(_fitness(spark, sf_dir), ["q2"], ["site"])


def alignment_events(spark, sf_dir):
    rows = _aligned(spark, sf_dir)[0].filter("aligned").select("ordinal", F.explode("events").alias("e"))
    return rows.select("ordinal", "e.type", "e.ref_pos", "e.read_pos", "e.ref", "e.alt")


def yates_chi2(spark, sf_dir):
    out = _tables_2x2(spark, sf_dir)
    return out.select("aa", F.round(S.yates_chi2_right(*(F.col(c) for c in "abcd")), 6).alias("p"))


def _tables_2x2(spark, sf_dir):
    out = _analysed(spark, sf_dir)
    return out.select("aa", F.col("c2").alias("a"), F.col("c0").alias("b"), (F.col("n2") - F.col("c2")).cast("long").alias("c"), (F.col("n0") - F.col("c0")).cast("long").alias("d"))


def fisher_exact(spark, sf_dir):
    out = _tables_2x2(spark, sf_dir)
    return out.select("aa", "a", "b", "c", "d", F.round(S.enrichment_p(*(F.col(c) for c in "abcd")), 9).alias("p"))


def sankey_links(spark, sf_dir):
    return H.sankey(A.round_funnel(_extracted(spark, sf_dir)), [*A.DISCARDS, "passed_qc"])


def q_quantiles(spark, sf_dir):
    q = D.short_reads(spark, sf_dir).select("source_id", Q.dorado_read_q(F.col("header"), F.col("qual"))["effective"].alias("q"))
    return H.quantiles(q, ["source_id"], "q").select("source_id", *r6("q_min", "q_25", "q_50", "q_75", "q_max"))


def zero_coverage(spark, sf_dir):
    some = _site_counts(spark, sf_dir).filter("not (round = 'Round_1' and site = 'S2')")
    return H.zero_coverage(some, NAMES, [s.name for s in D.SITES], spark)


def shard_union_invariance(spark, sf_dir):
    reads = D.short_reads(spark, sf_dir)
    shards = reduce(DataFrame.unionByName, [reads.filter(F.col("source_id") == i) for i in (5, 3, 1, 0, 2, 4)])
    return A.variant_counts(A.demultiplex(shards, D.ROUNDS))


def round_totals(spark, sf_dir):
    return _aa_counts(spark, sf_dir).filter("n > 0").groupBy("round").agg(F.sum("n").alias("reads"), F.count(F.lit(1)).alias("distinct_aa"))


def _aligned(spark, sf_dir):
    reference, targets = T.resolve_targets(D.REFERENCE, D.TARGET_SITES)
    reads = T.first_reads(D.amplicon_reads(spark, sf_dir), {i: i for i in range(3)})
    return T.align_targets(reads, reference, targets), targets


def targeted_align(spark, sf_dir):
    return _aligned(spark, sf_dir)[0].select("ordinal", "drop", "strand", "score", "read_start", "read_end", "cigar", "band", "qc_passed", "haplotype")


def targeted_calls(spark, sf_dir):
    return T.site_calls(_aligned(spark, sf_dir)[0]).select("ordinal", "site", "status", "dna", "aa", "min_q", "counted", "rescued")


def targeted_funnel(spark, sf_dir):
    return T.file_funnel(_aligned(spark, sf_dir)[0])


def targeted_site_funnel(spark, sf_dir):
    aligned, targets = _aligned(spark, sf_dir)
    return T.site_funnel(T.site_calls(aligned), targets)


def targeted_matrix(spark, sf_dir):
    counts = stage(T.target_counts(T.site_calls(_aligned(spark, sf_dir)[0]), NAMES), "target-counts")
    return _rounded(E.target_matrix(counts, _passed(counts, "site"), NAMES))


def targeted_combinations(spark, sf_dir):
    return _rounded(E.combination_matrix(stage(T.combination_counts(_aligned(spark, sf_dir)[0], NAMES), "combinations"), NAMES))


QUERIES = {
    f.__name__: f
    for f in (
        read_validity, mean_phred_filter, revcomp, gc_percent, translate_cds, stop_filter, dorado_read_q, barcode_score, demux_assign, demux_per_round,
        rc_retry_reason, funnel_by_round, funnel_global, funnel_strict, variant_counts, aa_collapse, dominant_dna, rpm_matrix, enrich_step,
        enrich_centered, var_enrich, wald_z_p, bh_fdr, master_matrix, library_median, fdr_hit_counts, banded_match, ssm_sites, ssm_attempt_funnel,
        ssm_site_counts, ssm_haplotypes, wt_fitness, site_scoped_fdr, eligibility_gate, haplotype_fitness, readid_dedup, exact_codon_table,
        exact_combination_table, combination_label, gini, power_law_slope, count_histogram, histogram_fit, logo_information, target_logo,
        rank_abundance, top_bottom_n, volcano_points, scatter_points, yates_chi2, fisher_exact, sankey_links, q_quantiles, zero_coverage,
        shard_union_invariance, round_totals, targeted_align, targeted_calls, targeted_funnel, targeted_site_funnel, targeted_matrix,
        targeted_combinations, pairwise_tests, volcano_recomputed, count_sample, matrix_preview, target_fdr_hits, site_fdr_hits, alignment_events,
    )
}
