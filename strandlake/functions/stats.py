"""Enrichment statistics as Columns and windows, and the few special functions Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.workers import on_workers

MILLION = 1_000_000.0
PSEUDOCOUNT, LEGACY_PSEUDOCOUNT = 0.5, 1.0
_INV_LN2 = 1 / math.log(2)
#: Coefficients of the rational erf fit used for the normal distribution.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: The ten-coefficient erfc fit of the dashboard's tests.
ERFC_C = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def check_pseudocount(p: float) -> float:
    if not math.isfinite(p) or p <= 0:
        raise ValueError("the pseudocount must be a finite number above 0")
    return p


def inverse(x: Column) -> Column:
    """1 / x, infinite at 0 (Spark would raise)."""
    return F.when(x == 0, F.lit(float("inf"))).otherwise(1.0 / x)


def rpm(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total * MILLION).otherwise(F.lit(0.0))


def pseudocount_as_count(total: Column, p: float) -> Column:
    return total * check_pseudocount(p) / MILLION


def log2_rpm_ratio(c: Column, n: Column, c0: Column, n0: Column, p: float = PSEUDOCOUNT) -> Column:
    check_pseudocount(p)
    return F.log2((rpm(c, n) + p) / (rpm(c0, n0) + p))


def var_log2_rpm_ratio(c: Column, n: Column, c0: Column, n0: Column, p: float = PSEUDOCOUNT) -> Column:
    q, q0 = pseudocount_as_count(n, p), pseudocount_as_count(n0, p)
    return _INV_LN2**2 * (inverse(c + q) + inverse(n + q) + inverse(c0 + q0) + inverse(n0 + q0))


def log2_rpm_wt_ratio(c: Column, wt: Column, n: Column, c0: Column, wt0: Column, n0: Column, p: float = PSEUDOCOUNT) -> Column:
    check_pseudocount(p)
    return F.log2(((rpm(c, n) + p) / (rpm(wt, n) + p)) / ((rpm(c0, n0) + p) / (rpm(wt0, n0) + p)))


def var_log2_rpm_wt_ratio(c: Column, wt: Column, n: Column, c0: Column, wt0: Column, n0: Column, p: float = PSEUDOCOUNT) -> Column:
    q, q0 = pseudocount_as_count(n, p), pseudocount_as_count(n0, p)
    return _INV_LN2**2 * (inverse(c + q) + inverse(wt + q) + inverse(c0 + q0) + inverse(wt0 + q0))


def var_log2_ratio(c: Column, c0: Column, p: float) -> Column:
    check_pseudocount(p)
    return _INV_LN2**2 * (inverse(c + p) + inverse(c0 + p))


def var_log2_wt_ratio(c: Column, wt: Column, c0: Column, wt0: Column, p: float) -> Column:
    check_pseudocount(p)
    return _INV_LN2**2 * (inverse(c + p) + inverse(wt + p) + inverse(c0 + p) + inverse(wt0 + p))


def standard_error(var: Column) -> Column:
    return F.sqrt(var)


def normal_cdf(z: Column) -> Column:
    """Keeps the clamps of the fit: at least the smallest double, at most 1 - 2^-52."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + ERF_P * x)
    poly: Column = F.lit(ERF_A[-1])
    for a in reversed(ERF_A[:-1]):
        poly = poly * t + a
    phi = 0.5 * (1.0 + F.when(z < 0, -1.0).otherwise(1.0) * (1.0 - poly * t * F.exp(-x * x)))
    clamped = F.when(phi <= 0, F.lit(5e-324)).when(phi >= 1, F.lit(1 - 2.0**-52)).otherwise(phi)
    inf = F.lit(float("inf"))
    return F.when(F.isnan(z), 0.0).when(z == inf, 1.0).when(z == -inf, 0.0).otherwise(clamped)


def two_sided_p(z: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(F.isnan(z), F.lit(float("nan"))).when(F.abs(z) == inf, 0.0).otherwise(2.0 * (1.0 - normal_cdf(F.abs(z))))


def wald_z(score: Column, var: Column) -> Column:
    """score / max(SE, 1e-12); 0 where the variance is infinite."""
    return score / F.greatest(F.sqrt(var), F.lit(1e-12))


def neg_log10_p(p: Column) -> Column:
    return F.when(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(float("nan"))).when(p <= 0, 300.0).when(p >= 1, 0.0).otherwise(-F.log10(p))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def finite_median(x: Column) -> Column:
    """Exact median of the finite values, 0 if there are none."""
    return F.coalesce(F.median(F.when(finite(x), x)), F.lit(0.0))


def bh_fdr(df: DataFrame, p: str, q: str, family: list[str] | None = None, checked: bool = True) -> DataFrame:
    """Adds Benjamini-Hochberg q-values within each family; invalid p-values get NaN, NULL stays NULL. Unless checked,
    every p-value that isn't NULL counts, as in the dashboard's own tests.

    Equal p-values share their q, so ranks are sums over the distinct p-values of a family. Those are
    aggregated on the map side; only they pass through the ordered windows, never the rows themselves.
    """
    family = family or []
    valid = F.col(p).between(0.0, 1.0) & ~F.isnan(p) if checked else F.col(p).isNotNull()
    counts = df.filter(valid).groupBy(*family, p).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*family).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*family).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__rank", F.sum("__n").over(up)).withColumn("__m", F.sum("__n").over(Window.partitionBy(*family)))
    adjusted = ranked.withColumn(q, F.min(F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__rank"))).over(down))
    keys = [F.col(c).alias(f"__f_{c}") for c in family]
    table = adjusted.select(*keys, F.col(p).alias("__p"), q)
    on = F.col(p) == F.col("__p")
    for c in family:
        on = on & F.col(c).eqNullSafe(F.col(f"__f_{c}"))
    joined = df.join(table, on, "left")
    missing = F.when(F.col(p).isNull(), F.lit(None).cast("double")).otherwise(F.lit(float("nan")))
    return joined.withColumn(q, F.coalesce(F.col(q), missing)).select(*df.columns, q)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly: Column = F.lit(ERFC_C[-1])
    for c in reversed(ERFC_C[:-1]):
        poly = poly * t + c
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2.0 - r)


def yates_chi2_right(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of a 2 x 2 table with Yates' correction; 1 if the first cell isn't above its expectation."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    excess = F.abs(a * d - b * c) - n / 2
    enriched = (margins > 0) & (a * n > (a + b) * (a + c)) & (excess > 0)
    return F.when(enriched, 0.5 * erfc(F.sqrt(excess * excess * n / margins / 2))).otherwise(1.0)


def log_choose(n: int, k: int) -> float:
    if k < 0 or k > n:
        return -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_right(a: int, b: int, c: int, d: int) -> float:
    """P(X >= a) of the hypergeometric distribution with the margins of the table; 1 for an empty margin.

    Each of the min(b, c) + 1 terms follows from the one before by a ratio, so only the first takes factorials."""
    import numpy as np

    row, column, n = a + b, a + c, a + b + c + d
    if not row or not column or column == n:
        return 1.0
    k = np.arange(a, min(row, column), dtype=float)
    steps = np.log((row - k) * (column - k)) - np.log((k + 1) * (n - row - column + k + 1))
    logs = log_choose(column, a) + log_choose(n - column, b) - log_choose(n, row) + np.concatenate([[0.0], np.cumsum(steps)])
    most = logs.max()
    return min(1.0, math.exp(most) * math.fsum(np.exp(logs - most)))


def fisher_series(a, b, c, d):
    """fisher_right over pandas Series; rows of NULL give NULL."""
    import pandas as pd

    rows = zip(a, b, c, d, strict=True)
    return pd.Series([None if pd.isna(x[0]) else fisher_right(*map(int, x)) for x in rows], dtype="float64")


def enrichment_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's exact test where a cell is below 5, else the corrected chi-square, which stays native."""
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    fisher = pandas_udf(on_workers(fisher_series), "double", PandasUDFType.SCALAR)
    small = F.least(a, b, c, d) < 5
    cells = [F.when(small, x.cast("long")) for x in (a, b, c, d)]
    return F.when(small, fisher(*cells)).otherwise(yates_chi2_right(a, b, c, d))
