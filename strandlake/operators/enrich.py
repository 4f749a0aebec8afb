"""From variant counts to the enrichment matrix: collapse, normalise, score, test, adjust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import stats as S
from strandlake.functions.seq import translate
from strandlake.tables import stage


def collapse(counts: DataFrame, rounds, keys: list[str], aa: Column | None = None) -> DataFrame:
    """keys, aa, dominant (the DNA with the largest total, the smallest of equals) and c0, c1, ... per round.

    The rounds become columns in the first aggregation, which combines on the map side, so the pivot costs no
    shuffle of its own."""
    aa = translate(F.col("dna")) if aa is None else aa
    each = [F.sum(F.when(F.col("round") == r, F.col("n")).otherwise(0)).alias(f"c{i}") for i, r in enumerate(rounds)]
    by_dna = counts.groupBy(*keys, "dna").agg(*each)
    total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(len(rounds))])
    sums = [F.sum(f"c{i}").cast("long").alias(f"c{i}") for i in range(len(rounds))]
    return by_dna.withColumn("aa", aa).groupBy(*keys, "aa").agg(F.min_by("dna", F.struct(-total, F.col("dna"))).alias("dominant"), *sums)


def per_round(table: DataFrame, value: str, rounds, keys: list[str], prefix: str) -> DataFrame:
    """A row per key (one row if there are none) with the value of each round; rounds without a row give 0."""
    each = [F.coalesce(F.sum(F.when(F.col("round") == r, F.col(value))), F.lit(0)).cast("double").alias(f"{prefix}{i}") for i, r in enumerate(rounds)]
    return table.groupBy(*keys).agg(*each) if keys else table.agg(*each)


def _attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Joins a table that has one row per family: a single row without keys, else one per site of the design."""
    return df.join(small, keys, "left") if keys else df.crossJoin(F.broadcast(small))


def analyse(
    counts: DataFrame, denominators: DataFrame, rounds, keys: list[str] | None = None, p: float = S.PSEUDOCOUNT,
    wild: DataFrame | None = None, min_baseline: int | None = None, aa: Column | None = None,
) -> DataFrame:
    """The wide matrix: keys, aa, dominant, eligible and for round i c{i}, rpm{i}, step{i}, raw{i}, centred{i}, var{i}, z{i}, p{i}, q{i}.

    counts has round, keys, dna, n; denominators has round, keys, passed. With wild (round, keys, wt) the score
    is the ratio to the wild type, and round 0 has one too; else it is the ratio of RPM, from round 1 on.
    Rows with fewer than min_baseline reads in the first round get no test, and neither count for the median nor
    for the family's false discovery rate. The variants are written out twice on the way: reads are scanned once
    however many comparisons there are.
    """
    keys = keys or []
    first = 0 if wild is not None else 1
    collapsed = stage(collapse(counts, rounds, keys, aa), "enrich-counts")
    out = _attach(collapsed, per_round(denominators, "passed", rounds, keys, "n"), keys)
    if wild is not None:
        out = _attach(out, per_round(wild, "wt", rounds, keys, "w"), keys)
    c = lambda i: F.col(f"c{i}").cast("double")
    n = lambda i: F.coalesce(F.col(f"n{i}"), F.lit(0.0))
    w = lambda i: F.coalesce(F.col(f"w{i}"), F.lit(0.0))
    ks = range(len(rounds))
    out = out.withColumn("eligible", F.lit(True) if min_baseline is None else F.col("c0") >= min_baseline)
    out = out.withColumns({f"rpm{i}": S.rpm(c(i), n(i)) for i in ks})
    if wild is None:
        scores = {f"raw{i}": S.log2_rpm_ratio(c(i), n(i), c(0), n(0), p) for i in ks[1:]}
        scores |= {f"step{i}": S.log2_rpm_ratio(c(i), n(i), c(i - 1), n(i - 1), p) for i in ks[1:]}
        variances = {f"var{i}": S.var_log2_rpm_ratio(c(i), n(i), c(0), n(0), p) for i in ks[1:]}
    else:
        scores = {f"raw{i}": S.log2_rpm_wt_ratio(c(i), w(i), n(i), c(0), w(0), n(0), p) for i in ks}
        variances = {f"var{i}": S.var_log2_rpm_wt_ratio(c(i), w(i), n(i), c(0), w(0), n(0), p) for i in ks}
    out = out.withColumns(scores | variances)
    out = out.withColumns({f"z{i}": S.wald_z(F.col(f"raw{i}"), F.col(f"var{i}")) for i in ks[first:]})
    out = out.withColumns({f"p{i}": S.two_sided_p(F.col(f"z{i}")) for i in ks[first:]})
    if min_baseline is not None:
        out = out.withColumns({f"{m}{i}": F.when(F.col("eligible"), F.col(f"{m}{i}")) for m in ("var", "z", "p") for i in ks[first:]})
    if ks[first:]:
        medians = [S.finite_median(F.when(F.col("eligible"), F.col(f"raw{i}"))).alias(f"median{i}") for i in ks[first:]]
        out = _attach(out, out.groupBy(*keys).agg(*medians) if keys else out.agg(*medians), keys)
        out = stage(out.withColumns({f"centred{i}": F.col(f"raw{i}") - F.col(f"median{i}") for i in ks[first:]}), "enrich-tests")
    for i in ks[first:]:
        out = S.bh_fdr(out, f"p{i}", f"q{i}", keys)
    return out


def _wide(out: DataFrame, rounds, head: list[Column], names: dict[str, str], first: int) -> DataFrame:
    """Renames to the exported columns, grouped by metric; names map the internal metric to a pattern."""
    columns = list(head)
    for metric, pattern in names.items():
        for i, r in enumerate(rounds):
            if i >= (0 if metric in ("c", "rpm") else first):
                columns.append(F.col(f"{metric}{i}").alias(pattern.format(r=r, prev=rounds[i - 1], first=rounds[0])))
    return out.select(*columns)


MATRIX_NAMES = {
    "c": "Count_{r}", "rpm": "RPM_{r}", "step": "Enrich_Step_{r}_vs_{prev}", "centred": "Centered_Enrich_{r}_vs_{first}", "z": "Z_Enrich_{r}_vs_{first}",
    "p": "Pval_Enrich_{r}_vs_{first}", "q": "FDR_q_{r}_vs_{first}", "var": "Var_Enrich_{r}_vs_{first}",
}
FITNESS_NAMES = {
    "c": "Count_{r}", "rpm": "RPM_{r}", "raw": "Fitness_vs_WT_{r}", "centred": "Centered_Fitness_{r}", "z": "Z_Fitness_{r}", "p": "Pval_Fitness_{r}",
    "q": "FDR_q_{r}", "var": "Var_Fitness_{r}",
}
TARGET_NAMES = {
    "c": "Count_{r}", "rpm": "RPM_{r}", "raw": "Enrichment_{r}_vs_{first}", "centred": "Centered_Enrichment_{r}_vs_{first}", "z": "Z_Enrichment_{r}_vs_{first}",
    "p": "Pval_Enrichment_{r}_vs_{first}", "q": "FDR_q_{r}_vs_{first}", "var": "Var_Enrichment_{r}_vs_{first}",
}


def master_matrix(counts: DataFrame, denominators: DataFrame, rounds, p: float = S.PSEUDOCOUNT) -> DataFrame:
    """Engine A's matrix in its final order: the last centred enrichment (or RPM of a single round) first."""
    out = _wide(analyse(counts, denominators, rounds, p=p), rounds, [F.col("aa").alias("Peptide_Seq"), F.col("dominant").alias("Dominant_DNA_Seq")], MATRIX_NAMES, 1)
    last = f"Centered_Enrich_{rounds[-1]}_vs_{rounds[0]}" if len(rounds) > 1 else f"RPM_{rounds[0]}"
    return out.orderBy(F.col(f"`{last}`").desc(), "Peptide_Seq")


def in_order(out: DataFrame, rounds, score: str, tie: str, site: str | None = None, sites=()) -> DataFrame:
    """The rows of engines B and C in their final order: sites as designed, then the score of the last round (the best
    first), then the variant. A single round has no score."""
    order = []
    if site is not None:
        places = F.create_map(*[F.lit(x) for k, name in enumerate(sites) for x in (name, k)])
        order.append(F.coalesce(F.try_element_at(places, F.col(f"`{site}`")), F.lit(len(sites))) if sites else F.col(f"`{site}`"))
    if score in out.columns:
        order.append(F.coalesce(F.col(f"`{score}`"), F.lit(0.0)).desc())
    return out.orderBy(*order, F.col(f"`{tie}`"))


def site_matrix(counts: DataFrame, denominators: DataFrame, wild: DataFrame, rounds, p: float = S.PSEUDOCOUNT, min_baseline: int | None = None) -> DataFrame:
    """Engine B's per-site matrix."""
    out = analyse(counts, denominators, rounds, ["site"], p, wild, min_baseline)
    head = [F.col("site").alias("Site"), F.col("aa").alias("Variant_AA"), F.col("dominant").alias("Dominant_DNA")]
    if min_baseline is not None:
        head.append(F.col("eligible").alias("Score_Eligible"))
    return _wide(out, rounds, head, FITNESS_NAMES, 0)


def haplotype_aa(separator: str) -> Column:
    return F.array_join(F.transform(F.split("dna", f"[{separator}]"), lambda x: translate(x)), separator)


def haplotype_matrix(counts: DataFrame, wild: DataFrame, rounds, p: float = S.PSEUDOCOUNT) -> DataFrame:
    """Engine B's haplotype matrix; its denominators are the reads on which every site passed."""
    denominators = counts.groupBy("round").agg(F.sum("n").alias("passed"))
    out = analyse(counts, denominators, rounds, [], p, wild, aa=haplotype_aa("_"))
    return _wide(out, rounds, [F.col("aa").alias("Haplotype_AA"), F.col("dominant").alias("Haplotype_DNA")], FITNESS_NAMES, 0)


def target_matrix(counts: DataFrame, denominators: DataFrame, rounds, min_baseline: int = 10, p: float = S.PSEUDOCOUNT) -> DataFrame:
    """Engine C's per-target matrix."""
    out = analyse(counts, denominators, rounds, ["site"], p, None, min_baseline)
    head = [F.col("site").alias("Target"), F.col("aa").alias("Variant_AA"), F.col("dominant").alias("Dominant_DNA"), F.col("eligible").alias("Score_Eligible")]
    return _wide(out, rounds, head, TARGET_NAMES, 1)


def combination_matrix(counts: DataFrame, rounds, min_baseline: int = 10, p: float = S.PSEUDOCOUNT) -> DataFrame:
    """Engine C's matrix of linked combinations."""
    denominators = counts.groupBy("round").agg(F.sum("n").alias("passed"))
    out = analyse(counts, denominators, rounds, [], p, None, min_baseline, haplotype_aa("|"))
    return _wide(out, rounds, [F.col("aa").alias("Combination_AA"), F.col("dominant").alias("Combination_DNA"), F.col("eligible").alias("Score_Eligible")], TARGET_NAMES, 1)


def exact_table(counts: DataFrame, denominators: DataFrame, rounds, keys: list[str]) -> DataFrame:
    """Exact DNA counts, Count and RPM of each round side by side; keys and dna first."""
    each = [F.sum(F.when(F.col("round") == r, F.col("n")).otherwise(0)).cast("long").alias(f"c{i}") for i, r in enumerate(rounds)]
    wide = _attach(counts.groupBy(*keys, "dna").agg(*each), per_round(denominators, "passed", rounds, keys, "n"), keys)
    columns = [x for i, r in enumerate(rounds) for x in (F.col(f"c{i}").alias(f"Count_{r}"), S.rpm(F.col(f"c{i}").cast("double"), F.coalesce(F.col(f"n{i}"), F.lit(0.0))).alias(f"RPM_{r}"))]
    return wide.select(*keys, "dna", *columns)


def fdr_hits(out: DataFrame, q_columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """For each family and comparison: finite q-values below 0.05 and 0.01."""
    keys = keys or []
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(f"`{c}`").alias("q")) for c in q_columns]))
    long = out.select(*keys, stacked.alias("s")).select(*keys, "s.*")
    hit = lambda t: F.count_if(S.finite(F.col("q")) & (F.col("q") < t))
    return long.groupBy(*keys, "comparison").agg(hit(0.05).alias("hits_05"), hit(0.01).alias("hits_01"))
