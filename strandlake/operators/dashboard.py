"""The dashboard's aggregates over counts and matrices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import stats as S
from strandlake.tables import stage


def gini(counts: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Gini coefficient of each group. Equal counts share ranks, so the ordered window only sees distinct counts."""
    tally = counts.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = tally.withColumn("before", F.coalesce(F.sum("k").over(up), F.lit(0)))
    # The sum of ranks of k equal values after `before` smaller ones.
    weighted = F.sum((F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2) * F.col(value))
    n, total = F.sum("k"), F.sum(F.col(value) * F.col("k"))
    return placed.groupBy(*keys).agg(F.when(total > 0, 2.0 * weighted / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def ranked(counts: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc(), tie)))


def power_law(counts: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Slope of log10 value on log10 rank over the top 80 % of ranks; 0 for fewer than 3 points."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    top = ranked(counts.filter(F.col(value) > 0), keys, value, tie).withColumn("rows", n).filter(F.col("rank") <= F.floor(F.col("rows") * 0.8))
    slope = F.regr_slope(F.log10(F.col(value).cast("double")), F.log10(F.col("rank").cast("double")))
    return top.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.coalesce(slope, F.lit(0.0))).otherwise(0.0).alias("slope"))


def histogram(counts: DataFrame, keys: list[str], value: str = "n", bins: int = 24) -> DataFrame:
    """Bins of log10 counts between the smallest and the largest; a single value gets a range of one around it."""
    logs = counts.filter(F.col(value) > 0).withColumn("v", F.log10(F.col(value).cast("double")))
    edges = logs.groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    edges = edges.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1)).cast("int")
    return logs.join(F.broadcast(edges), keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n_variants"))


def normal_fit(counts: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Mean and sample deviation of log10 counts; fitted is whether there are 5 values that aren't all equal."""
    v = F.log10(F.col(value).cast("double"))
    out = counts.filter(F.col(value) > 0).groupBy(*keys).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n_values"))
    return out.withColumn("fitted", (F.col("n_values") >= 5) & (F.col("sd") > 0))


def sequence_logo(peptides: DataFrame, value: str = "n", top: int = 100, positions: int = 32, least_bits: float = 0.005) -> DataFrame:
    """position, letter, bits of the most frequent peptides that have the commonest length (of equals, the one of
    the best-ranked peptide): information content log2(20) - entropy, shared by frequency."""
    best = peptides.orderBy(F.col(value).desc(), "aa").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).desc(), "aa")))
    lengths = best.groupBy(F.length("aa").alias("len")).agg(F.count(F.lit(1)).alias("k"), F.min("rank").alias("r"))
    modal = lengths.orderBy(F.col("k").desc(), "r").limit(1).select("len")
    letters = best.join(F.broadcast(modal), F.length("aa") == F.col("len")).select(F.posexplode(F.split("aa", "")).alias("position", "letter")).filter((F.col("letter") != "") & (F.col("position") < positions))
    counted = letters.groupBy("position", "letter").agg(F.count(F.lit(1)).alias("k"))
    return _bits(counted, ["position"], "letter", "k").filter(F.col("bits") > least_bits)


def _bits(counted: DataFrame, keys: list[str], letter: str, k: str) -> DataFrame:
    share = F.col(k) / F.sum(k).over(Window.partitionBy(*keys))
    shares = counted.withColumn("share", share)
    entropy = -F.sum(F.col("share") * F.log2("share")).over(Window.partitionBy(*keys))
    return shares.withColumn("bits", F.col("share") * (F.lit(math.log2(20)) - entropy)).select(*keys, letter, "share", "bits")


def target_logo(counts: DataFrame, targets: int = 96) -> DataFrame:
    """site, aa, share and bits, weighted by reads, for the first targets by name."""
    first = counts.select("site").distinct().orderBy("site").limit(targets)
    weighted = counts.join(F.broadcast(first), "site").groupBy("site", "aa").agg(F.sum("n").alias("k")).filter("k > 0")
    return _bits(weighted, ["site"], "aa", "k")


def rank_abundance(counts: DataFrame, keys: list[str], value: str, tie: str, points: int = 201) -> DataFrame:
    """Ranks spaced evenly in their logarithm, each once, with the value there."""
    rows = ranked(counts.filter(F.col(value) > 0), keys, value, tie).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    ends = rows.groupBy(*keys).agg(F.max("rows").alias("rows"))
    exponent = F.col("i") / (points - 1) * F.log(F.col("rows").cast("double"))
    wanted = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*keys, F.floor(F.exp(exponent) + 0.5).cast("int").alias("rank")).distinct()
    return rows.join(F.broadcast(wanted), [*keys, "rank"]).select(*keys, "rank", value)


def top_bottom(matrix: DataFrame, score: str, tie: str, rows: int = 20) -> DataFrame:
    """side, place and all columns: the best rows in order and the worst ones, worst first."""
    up, down = [F.col(score).desc(), F.col(tie)], [F.col(score).asc(), F.col(tie).desc()]
    place = lambda order: F.row_number().over(Window.orderBy(*order))
    best = matrix.orderBy(*up).limit(rows).withColumn("place", place(up)).withColumn("side", F.lit("top"))
    worst = matrix.orderBy(*down).limit(rows).withColumn("place", place(down)).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def volcano(matrix: DataFrame, score: str, q: str, tie: str, points: int = 1500, top: int = 20) -> DataFrame:
    """Rows for the plot: the best, all significant ones (q < 0.05 and score > 1), and a stride of the rest."""
    order = Window.orderBy(F.col(score).desc(), tie)
    rows = matrix.withColumn("rank", F.row_number().over(order)).withColumn("significant", F.coalesce((F.col(q) < 0.05) & (F.col(score) > 1), F.lit(False)))
    keep = (F.col("rank") <= top) | F.col("significant")
    rest = F.sum(F.when(keep, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbers = rows.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("others"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("others") / F.greatest(F.lit(points) - F.col("kept"), F.lit(1))))
    picked = rows.withColumn("__keep", keep).withColumn("__rest", rest).crossJoin(F.broadcast(numbers))
    return picked.filter(F.col("__keep") | ((F.col("__rest") - 1) % stride == 0)).select(*matrix.columns, "rank", "significant", S.neg_log10_p(F.col(q)).alias("neg_log10_q"))


def scatter(counts: DataFrame, x: str, y: str, tie: str, points: int = 2000, top: int = 20) -> DataFrame:
    """Rows with a count in either round: the best by y, and every n-th of the others."""
    rows = counts.filter((F.col(x) > 0) | (F.col(y) > 0)).withColumn("rank", F.row_number().over(Window.orderBy(F.col(y).desc(), tie)))
    n = rows.agg(F.greatest(F.lit(1), F.ceil((F.count(F.lit(1)) - top) / (points - top))).alias("__stride"))
    return rows.crossJoin(F.broadcast(n)).filter((F.col("rank") <= top) | ((F.col("rank") - top - 1) % F.col("__stride") == 0)).drop("__stride")


def pairwise_tests(matrix: DataFrame, source: int, dest: int, pseudocount: float = S.PSEUDOCOUNT) -> DataFrame:
    """aa, log2fc, p, q for two rounds of a matrix (columns aa, c{i}, n{i}), where it holds no tests of its own for them:
    Fisher's exact test or the corrected chi-square for each row, and q over all rows. No rows if a round is empty."""
    a, b, na, nb = (F.col(c).cast("double") for c in (f"c{dest}", f"c{source}", f"n{dest}", f"n{source}"))
    cells = [x.cast("long") for x in (a, b, na - a, nb - b)]
    tested = matrix.filter((na > 0) & (nb > 0)).select("aa", S.log2_rpm_ratio(a, na, b, nb, pseudocount).alias("log2fc"), S.enrichment_p(*cells).alias("p"))
    return S.bh_fdr(stage(tested, "pairwise"), "p", "q", checked=False)


def count_sample(counts: DataFrame, keys: list[str], value: str, tie: str, cap: int = 30_000, top: int = 20, seed: int = 7) -> DataFrame:
    """keys, value, kind: for histograms and rank curves, the top values of each group and a sample of cap of its rows by
    seeded hash (all rows if there are no more); a row may be in both."""
    best = Window.partitionBy(*keys).orderBy(F.col(value).desc(), tie)
    drawn = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, tie), tie)
    positive = counts.filter(F.col(value) > 0)
    head = positive.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top).select(*keys, value, F.lit("top").alias("kind"))
    return head.union(positive.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= cap).select(*keys, value, F.lit("sample").alias("kind")))


def preview(matrix: DataFrame, order: list, rows: int = 200) -> DataFrame:
    """The first rows of a matrix in its final order."""
    return matrix.orderBy(*order).limit(rows)


def sankey(funnel: DataFrame, discards) -> DataFrame:
    """Links from each round to its buckets; links without reads are left out."""
    links = F.explode(F.array(*[F.struct(F.lit(d).alias("target"), F.col(d).cast("long").alias("reads")) for d in discards]))
    return funnel.select(F.col("round").alias("source"), links.alias("l")).select("source", "l.*").filter("reads > 0")


def quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum with linear interpolation."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return df.groupBy(*keys).agg(q.alias("__q")).select(*keys, *[F.get("__q", i).alias(n) for i, n in enumerate(("q_min", "q_25", "q_50", "q_75", "q_max"))])


def zero_coverage(counts: DataFrame, rounds, sites, spark) -> DataFrame:
    """Each round (and site) of the design without a counted read."""
    design = [(r, s) for r in rounds for s in (sites or [None])]
    wanted = spark.createDataFrame(design, "round string, site string")
    seen = counts.select("round", "site" if sites else F.lit(None).cast("string").alias("site")).distinct()
    same = (wanted["round"] == seen["round"]) & wanted["site"].eqNullSafe(seen["site"])
    return wanted.join(seen, same, "left_anti")
